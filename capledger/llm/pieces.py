"""SentencePiece encoding with sampled segmentations, and lossless decoding.

The pieces of a published model span a lattice over the text. Going forward, each position gets the summed weight of all
paths to it; going backward from the end, each piece is drawn in proportion to the paths it completes: an exact sample of
whole segmentations, P(path) ~ product of (rank + SHIFT) ** -alpha, with the model's own order of pieces as ranks.
No piece holds a space after another character, so every path is cut before each run of spaces, and lattices of single
words, built once per distinct word, give the same distribution as one over the whole text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.common import GOLDEN, batches_by_chars, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.25
SEED = 17
SHIFT = 2.7
U = np.uint64
_CHARS = 1_000_000
_SLICE = 200_000
_EDGES = 2_000_000
_WORD = re.compile(" *[^ ]+")


@functools.lru_cache(2)
def _vocabulary(path: str) -> tuple[dict[str, int], list[int], list[bytes]]:
    """(id by piece text with plain spaces, the 256 byte pieces, bytes by id)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, raw = {}, [0] * 256, [b""] * sp.get_piece_size()
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
            raw[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            t = p.replace("▁", " ")
            raw[i] = t.encode()
            if not re.search("[^ ] ", t):
                ids[t] = i
    return ids, byte_ids, raw


class Lattices:
    """Backward tables of distinct words in flat arrays. A state is an end position in a word; its edges lie together, each with a piece, the characters it spans and the cumulative probability."""

    def __init__(self, path: str, alpha: float):
        ids, self.bytes, _ = _vocabulary(path)
        chars = {c for c in ids if len(c) == 1}
        usable = {p: i for p, i in ids.items() if all(c in chars for c in p)}
        self.longest = max(map(len, usable))
        inner = "".join(re.escape(c) for c in sorted(chars - {" "}))
        self.units = re.compile(f" *[{inner}]+| +|[^ {inner}]+")
        self.known = chars
        text = np.array([ord(c) for p in usable for c in p], np.int64)
        size = np.array([len(p) for p in usable])
        at = np.cumsum(size) - size
        h, live, self.tables = np.zeros(len(size), U), np.ones(len(size), bool), []
        idv, w = np.array(list(usable.values()), np.int32), (np.array(list(usable.values())) + SHIFT) ** -alpha
        for k in range(self.longest):  # by length: hashes of prefixes that go on, and pieces
            live &= size > k
            h[live] = self._next(h[live], text[at[live] + k])
            whole = live & (size == k + 1)
            u, first = np.unique(h[live], return_index=True)
            piece = np.full(len(u), -1, np.int32)
            weight = np.zeros(len(u))
            spot = np.searchsorted(u, h[whole])
            piece[spot], weight[spot] = idv[whole], w[whole]
            self.tables.append((u, piece, weight))
        self.clear()

    @property
    def edges(self) -> int:
        return self._size["cum"]

    @staticmethod
    def _next(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(h + c.astype(U) * GOLDEN + U(1))

    def clear(self) -> None:
        """No words. Arrays have room for what they hold at most, save with very long words; pages not written yet take no memory."""
        self.index: dict[str, int] = {}
        room = _EDGES + _EDGES // 4
        for name, kind in (("base", np.int64), ("length", np.int64), ("first", np.int64), ("cum", np.float32), ("piece", np.int32), ("span", np.int8)):
            if len(getattr(self, name, ())) != room:
                setattr(self, name, np.empty(room, kind))
        self._size = dict.fromkeys(("base", "length", "first", "cum", "piece", "span"), 0)

    def _put(self, name: str, *values: np.ndarray) -> None:
        """Append in place, so that no second copy of a whole array is made."""
        a, n = getattr(self, name), self._size[name]
        to = n + sum(map(len, values))
        if to > len(a):
            grown = np.empty(to + to // 4, a.dtype)
            grown[:n] = a[:n]
            setattr(self, name, a := grown)
        np.concatenate(values, out=a[n:to], casting="same_kind")
        self._size[name] = to

    def add(self, words: list[str]) -> None:
        """Tables of new words, all at once: one round a piece length to find edges, one a position to weigh them."""
        plain, odd = [w for w in words if w[0] in self.known], [w for w in words if w[0] not in self.known]
        n0 = self._size["base"]
        for k, w in enumerate(plain + odd):
            self.index[w] = n0 + k
        size = np.array([len(w) for w in plain], np.int64)
        start = np.cumsum(size) - size
        total = int(size.sum())
        code = np.frombuffer("".join(plain).encode("utf-32-le"), np.uint32).astype(np.int64)
        rest = np.repeat(start + size, size) - np.arange(total)
        h, at = np.zeros(total, U), np.arange(total)
        ends, spans, pieces, weights = [], [], [], []
        for k in range(self.longest):
            keep = rest[at] > k
            h, at = h[keep], at[keep]
            if not len(at):
                break
            h = self._next(h, code[at + k])
            u, piece, weight = self.tables[k]
            spot = np.minimum(np.searchsorted(u, h), len(u) - 1)
            live = u[spot] == h
            h, at, spot = h[live], at[live], spot[live]
            hit = piece[spot] >= 0
            ends.append(at[hit] + k)
            spans.append(np.full(int(hit.sum()), k + 1, np.int8))
            pieces.append(piece[spot[hit]])
            weights.append(weight[spot[hit]])
        end, span, piece, weight = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((ends, np.int64), (spans, np.int8), (pieces, np.int32), (weights, float)))
        where = end - np.repeat(start, size)[end] if total else end  # position in the word
        o = np.lexsort((end, where))
        end, span, piece, weight, where = end[o], span[o], piece[o], weight[o], where[o]
        f = np.ones(total + 1)  # weight of all paths to a position; at a word's start it is 1
        value = np.zeros(len(end))
        cut = np.searchsorted(where, np.arange(int(size.max(initial=0)) + 1))
        for e in range(len(cut) - 1):
            s, t = cut[e], cut[e + 1]
            came = end[s:t] - span[s:t]
            v = weight[s:t] * np.where(span[s:t] == e + 1, 1.0, f[came])
            own = end[s:t]
            head = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums = np.add.reduceat(v, head)
            if e % 48 == 47:  # long words: only ratios count, and only within a piece's reach
                for back in range(1, min(self.longest, e + 1)):
                    f[own[head] - back] /= sums
                sums_at = np.ones(len(sums))
            else:
                sums_at = sums
            f[own[head]] = sums_at
            many = np.diff(np.append(head, len(v)))
            value[s:t] = v / np.repeat(sums, many)
        o = np.argsort(end, kind="stable")
        end, span, piece, value = end[o], span[o], piece[o], value[o]
        head = np.searchsorted(end, np.arange(total))
        cum = np.cumsum(value)
        many = np.diff(np.append(head, len(end)))
        cum -= np.repeat(np.concatenate([[0.0], cum])[head], many)
        cum[np.append(head[1:], len(end)) - 1] = 2.0  # the last edge takes what is left
        raw = [w.encode("utf-8", "surrogatepass") for w in odd]
        spell = np.array([self.bytes[b] for r in raw for b in r], np.int32)
        states, edges = self._size["first"], self.edges
        rsize = np.array([len(r) for r in raw], np.int64)
        self._put("base", states + start, states + total + np.cumsum(rsize) - rsize)
        self._put("length", size, rsize)
        self._put("first", edges + head, edges + len(end) + np.arange(len(spell)))
        self._put("cum", cum, np.full(len(spell), 2, np.float32))
        self._put("piece", piece, spell)
        self._put("span", span, np.ones(len(spell), np.int8))

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, number of each)."""
        outs, total, passed = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for rows, parts in slices(texts, _SLICE):
            out, n, units = self._draw(parts, seeds[rows], passed[rows])
            outs.append(out)
            total[rows] += n
            passed[rows] += units
        return np.concatenate(outs), total

    def _draw(self, parts: list[str], seeds: np.ndarray, passed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids of parts of texts, number of each, words of each). passed: words of the text before the part."""
        units = [self.units.findall(p) for p in parts]
        counts = np.array([len(u) for u in units], np.int64)
        if self.edges > _EDGES:
            self.clear()
        new = set(chain.from_iterable(units)).difference(self.index)
        if new:
            self.add(sorted(new))
        word = np.fromiter(map(self.index.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(len(parts)), counts)
        begin = np.cumsum(counts) - counts
        with np.errstate(over="ignore"):
            seed = mix(seeds[text] + (np.arange(len(word)) - begin[text] + passed[text]).astype(U) * GOLDEN)
        at, left, state0 = np.arange(len(word)), self.length[word], self.base[word] - 1
        drawn, step, taken = [], 0, np.zeros(len(word), np.int64)
        while len(at):
            with np.errstate(over="ignore"):
                u = ((mix(seed + U(step) * U(0xD1342543DE82EF95)) >> U(40)).astype(np.float32)) * np.float32(2.0**-24)
            edge = self.first[state0 + left]
            more = np.flatnonzero(self.cum[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[self.cum[edge[more]] <= u[more]]
            drawn.append((at, self.piece[edge]))
            taken[at] += 1
            left = left - self.span[edge]
            go = left > 0
            at, left, state0, seed, step = at[go], left[go], state0[go], seed[go], step + 1
        end = np.cumsum(taken)
        out = np.empty(int(end[-1]), np.int32)
        for k, (a, p) in enumerate(drawn):
            out[end[a] - 1 - k] = p
        return out, np.add.reduceat(taken, begin), counts


def slices(texts: list[str], limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, their texts with the space before): ``limit`` characters at most. A longer text comes in parts, one at a time, cut before runs of spaces as paths are; only a longer word makes a longer part."""
    rows, parts, size = [], [], 0
    for k, t in enumerate(texts):
        if not t:
            continue
        t, at = " " + t, 0
        if parts and size + len(t) > limit:
            yield rows, parts
            rows, parts, size = [], [], 0
        while len(t) - at > limit:
            to = at + len(t[at : max(at, t.rfind(" ", at, at + limit + 1))].rstrip(" "))
            if to == at:  # a run of spaces or a word is longer
                to = m.end() if (m := _WORD.match(t, at)) else len(t)
            yield [k], [t[at:to]]
            at = to
        if at < len(t):
            rows.append(k)
            parts.append(t[at:])
            size += len(t) - at
    if parts:
        yield rows, parts


_OPEN: dict[tuple, Lattices] = {}


def _lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _OPEN:
        _OPEN[path, alpha] = Lattices(path, alpha)
    return _OPEN[path, alpha]


def sample_pieces(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_pieces, pieces)``: one segmentation of every text, drawn with the row's key as seed.

    The same key, text and seed always give the same pieces, wherever the row lies; repeated rows so repeat. A null
    key seeds like 0. A null text has null pieces, an empty one none. A space is put before a text that isn't empty, as the
    model expects. Characters no piece has become byte pieces, so ``decode`` gives every text back unchanged. Whole
    texts of any length; other columns are ignored.
    """
    src = df.select(F.col(f"`{key_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattices(model, alpha)
        for b in it:
            for s, e in batches_by_chars(b, 1, _CHARS):
                ids = b.column(0).slice(s, e - s)
                texts = b.column(1).slice(s, e - s).to_pylist()
                with np.errstate(over="ignore"):
                    seeds = mix(np.array([x or 0 for x in ids.to_pylist()], np.int64).astype(U) + U(seed) * GOLDEN)
                out, n = lat.sample([t or "" for t in texts], seeds)
                null = np.array([t is None for t in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), pa.int32(), mask=np.append(null, False))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32), pa.int32(), mask=null), pa.ListArray.from_arrays(offsets, pa.array(out, pa.int32()))], names=["doc_id", "n_pieces", "pieces"])
            b = ids = None  # before the next batch is read

    return src.mapInArrow(run, "doc_id long, n_pieces int, pieces array<int>")


def decode_ids(ids: list[int], model: str = MODEL) -> str:
    raw = _vocabulary(model)[2]
    b = b"".join([raw[i] for i in ids])
    return (b[1:] if b[:1] == b" " else b).decode("utf-8", "surrogatepass")


def decode(df: DataFrame, key_col: str = "doc_id", pieces_col: str = "pieces", model: str = MODEL) -> DataFrame:
    """``(doc_id, text)``: the texts back from their pieces; null pieces give a null text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if p is None else decode_ids(p, model) for p in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return df.select(F.col(f"`{key_col}`").cast("long").alias("doc_id"), F.col(f"`{pieces_col}`").alias("pieces")).mapInArrow(run, "doc_id long, text string")
