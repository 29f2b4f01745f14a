"""Chat formatting by token-level assembly: segments are encoded one by one, reserved ids are spliced in between, and loss masks are prefix sums over where trained spans begin and end."""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Control strings and the ids reserved for them, above the vocabulary.
CONTROL = {"<|conversation|>": 50257, "<|start|>": 50258, "<|body|>": 50259, "<|end|>": 50260, "<|close|>": 50261}
ROLES = ("system", "user", "assistant", "tool")
TRAINED = ("assistant",)
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOOKS = re.compile(r"<(\\*)\|(?=(?:" + "|".join(c[2:-2] for c in CONTROL) + r")\|>)")
_ESCAPED = re.compile(r"<(\\*)\\\|(?=(?:" + "|".join(c[2:-2] for c in CONTROL) + r")\|>)")


def escape(text: str) -> str:
    """A control string in content gets a backslash, one that has backslashes already one more; ``unescape`` takes it away."""
    return _LOOKS.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@functools.lru_cache(2)
def encoder(folder: str):
    import tiktoken

    with open(os.path.join(folder, RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(turns: list[tuple[str | None, str | None]], encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids, loss mask) of one conversation. A trained turn counts from after its body marker up to and with its end marker."""
    parts, edges, at = [[CONTROL["<|conversation|>"]]], [], 1
    for role, text in turns:
        role = role or "user"
        head = [CONTROL["<|start|>"], *encode(escape(role)), CONTROL["<|body|>"]]
        body = [*encode(escape(text or "")), CONTROL["<|end|>"]]
        parts += [head, body]
        at += len(head)
        if role in TRAINED:
            edges.append((at, at + len(body)))
        at += len(body)
    parts.append([CONTROL["<|close|>"]])
    ids = np.fromiter((i for p in parts for i in p), np.int32, at + 1)
    step = np.zeros(at + 2, np.int8)
    for s, e in edges:
        step[s] += 1
        step[e] -= 1
    return ids, np.cumsum(step, dtype=np.int8)[: at + 1]


def format_chats(df: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """``(conv_id, n_turns, input_ids, loss_mask, n_trained)``, one row a conversation, its turns by (turn, role, text).

    Turns with a null conversation belong to none and are left out. A null role counts as user, roles that aren't known are
    written like others and never trained on, a null text as empty; a null turn number comes first; repeated turns stay.
    Conversations and texts of any length are taken whole; other columns are ignored.
    """
    src = df.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("n"), F.col("role").cast("string").alias("r"), F.col("text").cast("string").alias("t")).where("c is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizers).encode_ordinary
        now, turns, rows = None, [], []

        def close() -> None:
            if turns:
                ids, mask = assemble(turns, encode)
                rows.append((now, len(turns), ids, mask, int(mask.sum())))

        def batch() -> pa.RecordBatch:
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[2]) for r in rows])]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[2] for r in rows]), pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([r[3] for r in rows]), pa.int8())), pa.array([r[4] for r in rows], pa.int32())], names=["conv_id", "n_turns", "input_ids", "loss_mask", "n_trained"])

        for b in it:
            for c, r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if c != now:
                    close()
                    now, turns = c, []
                    if len(rows) >= 512:
                        yield batch()
                        rows = []
                turns.append((r, t))
        close()
        if rows:
            yield batch()

    return src.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t").mapInArrow(run, "conv_id long, n_turns int, input_ids array<int>, loss_mask array<byte>, n_trained int")


def render(ids: list[int], tokenizers: str = TOKENIZERS) -> list[tuple[str, str]]:
    """The (role, text) turns back from assembled ids."""
    enc, turns, role, held = encoder(tokenizers), [], "", []
    for i in ids:
        if i == CONTROL["<|body|>"]:
            role, held = unescape(enc.decode(held)), []
        elif i == CONTROL["<|end|>"]:
            turns.append((role, unescape(enc.decode(held))))
            held = []
        elif i in (CONTROL["<|start|>"], CONTROL["<|conversation|>"], CONTROL["<|close|>"]):
            held = []
        else:
            held.append(i)
    return turns
