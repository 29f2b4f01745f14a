"""Finding spans in texts: the scaffolding that PII, secret and license scans share."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[str, int, int, float]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("found", pa.string())])


def scan(df: DataFrame, find: Callable[[], Callable[[str], list[Span]]], gate: Callable[[Column], Column] | None, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, kind, start, end, score, found)`` of all that a finder sees in each text; a gate, if there is one, runs in the JVM, so that most texts never reach Python."""
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        see = find()
        for b in it:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                rows += [(i, k, s, e, v, t[s:e]) for k, s, e, v in see(t)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return (src.where(gate(F.col("text"))) if gate else src).mapInArrow(run, "doc_id long, kind string, start long, end long, score double, found string")


def disjoint(spans: list[Span]) -> list[Span]:
    """Best score first, then the longer, then the earlier; what overlaps one already taken goes. Sorted by start."""
    taken: list[Span] = []
    starts: list[int] = []
    for s in sorted(spans, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
        k = bisect_right(starts, s[1])  # of what is taken, in order of start, only the neighbours can overlap
        if (k and taken[k - 1][2] > s[1]) or (k < len(taken) and taken[k][1] < s[2]):
            continue
        starts.insert(k, s[1])
        taken.insert(k, s)
    return taken


def lowered(text: str) -> str:
    """Small letters, each in its place: where the small form of a letter is longer, the letter stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
