"""N-gram Jaccard join: exact join of documents whose word n-gram sets have Jaccard similarity >= threshold.

Jaccard distance is a metric, and the join divides that space among pivots: Voronoi cells, into which windows of the
triangle inequality replicate boundary documents, divided again until a part fits in one task, where it is joined exactly.

Nearly every document is at distance exactly 1 from a randomly drawn one, and with a radius of 0.4 the window of twice
the radius lets nearly all of these in, so pivots drawn at random separate nothing at the first level. There the pivots are documents
that *hold* the n-grams: of each document a prefix of its n-grams in an order common to all is looked at, so long that any
two documents within the radius have ``k`` of them in common. The order puts n-grams of rare words first, by the words' counts in a
bounded sample: of those of common words, more and more occur in unrelated documents as the corpus grows, and their votes would bring all together. Each n-gram that two documents have there elects one
pivot among its holders. A document lies in the regions of the pivots it votes for, weightiest pivots first, in so many that the votes
left out are fewer than ``k``: a pair within the radius meets for certain. Regions too large for a task are divided by
pivots of their own as Spark jobs (`divide`), with triangle windows; a region that pivots can't separate, as all of it
lies within one window, is joined in tiles over many tasks. No task holds more than a bounded part of a region.

Documents with one n-gram set are one point of the space, found by a 64-bit fingerprint of the set; n-grams are compared by 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.common import GOLDEN, batches_by_chars, input_bytes, materialize, mix

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15 | 1)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_CHARS = 1_000_000
_FLUSH = 2_000_000
LEAF = 768
KEEP = 6  # bytes kept of an n-gram's hash
VOTES = 0.25  # of a document's n-grams that must be shared within the prefixes
PART_BYTES, MAX_PARTS = 24_000_000, 1 << 20  # beyond so many parts they grow, with the same results
ROWS, GRAMS = 8192, 4_000_000  # the most of a region in one task
PIVOTS, DEPTH = 32, 8
SAMPLE_BYTES, SAMPLE_ROWS = 32_000_000, 16_384  # of the texts whose words are counted; rows where the optimizer knows no size
WORD_BITS = 18


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts and the text each is of. A word is a run of letters and digits, case folded; all non-ASCII counts as letters."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    lens = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    buf = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
    is_word = _WORD[buf]
    edge = np.diff(is_word.astype(np.int8), prepend=0)
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, U), np.zeros(0, np.int64)
    ends = np.flatnonzero(edge == -1)
    size = ends - starts
    at = np.flatnonzero(is_word)
    first = np.cumsum(size) - size
    pos = np.arange(len(at)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(size.max()), _STEP, U))
        h = mix(np.add.reduceat(_BYTE[buf[at]] * powers[pos], first) + size.astype(U) * GOLDEN)
    return h, np.searchsorted(np.cumsum(lens), starts, side="right")


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of the distinct word n-grams, by text, then hash. A text of fewer than n words has one n-gram: all its words; one without words has none."""
    return weighed_sets(texts, n, np.zeros(1 << WORD_BITS, np.uint8))[:2]


def weighed_sets(texts: list[str], n: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``gram_sets``, and how common the words of each n-gram are: the sum of their levels."""
    h, doc = _words(texts)
    if not len(h):
        return h, doc, np.zeros(0, U)
    level = levels[h >> U(64 - WORD_BITS)].astype(U)
    count = np.bincount(doc, minlength=len(texts))
    with np.errstate(over="ignore"):
        m = len(h) - n + 1
        g = np.zeros(max(m, 0), U)
        for k in range(n) if m > 0 else ():
            g = mix(g + h[k : k + m] * (GOLDEN * U(2 * k + 1)) + U(k))
        ok = doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)
        common = sum((level[k : k + m] for k in range(n)), np.zeros(max(m, 0), U)) if m > 0 else g
        g, d, common = g[ok], doc[:m][ok], common[ok]
        few = np.flatnonzero((count > 0) & (count < n))
        if len(few):
            start = np.searchsorted(doc, few)
            extra = np.array([np.bitwise_xor.reduce(mix(h[s : s + c] + np.arange(c, dtype=U) * GOLDEN)) for s, c in zip(start, count[few])], U)
            g, d, common = np.concatenate([g, mix(extra + U(77))]), np.concatenate([d, few]), np.concatenate([common, np.zeros(len(few), U)])
    o = np.lexsort((g, d))
    g, d, common = g[o], d[o], common[o]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], d[new], common[new]


def word_levels(src: DataFrame, size: int | None) -> np.ndarray:
    """How common words are, by 18 bits of their hash: eight times the binary logarithm of their count in a sample of 32 MB of the rows ``(i, t)``. It decides what is quick, and nothing of the result."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << WORD_BITS, np.int64)
        for batch in it:
            for s, e in batches_by_chars(batch, 0, _CHARS):
                h, _ = _words([x or "" for x in batch.column(0).slice(s, e - s).to_pylist()])
                total += np.bincount((h >> U(64 - WORD_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["w", "n"])

    rows = src.select("t").limit(SAMPLE_ROWS) if size is None else src.select("t").sample(min(1.0, SAMPLE_BYTES / max(size, 1)), 5)
    got = rows.mapInArrow(count, "w int, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << WORD_BITS, np.uint8)
    levels[np.asarray(got.column(0))] = np.minimum(255, 8 * np.log2(np.asarray(got.column(1)) + 1.0))
    return levels


def _pack(h: np.ndarray) -> bytes:
    return np.ascontiguousarray((h >> U(64 - 8 * KEEP)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEEP]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    a = np.frombuffer(b, np.uint8).reshape(-1, KEEP)
    out = np.zeros((len(a), 8), np.uint8)
    out[:, :KEEP] = a
    return out.view("<u8").ravel().astype(U)


def _need(size, t: float):
    """The fewest n-grams that a document of this size has in common with any other within the radius."""
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def _longer(size, t: float):
    """By how many n-grams a prefix is longer than one that has one n-gram in common with any document within the radius."""
    return np.maximum(1, np.floor(np.asarray(size) * min(VOTES, t))).astype(np.int64)


def _votes(size, t: float):
    """``k``: the fewest n-grams that a document's prefix has in common with that of any other within the radius.

    Two sets of sizes b <= a have o >= t (a + b) / (1 + t) n-grams in common; their prefixes have the first ``longer + o - need`` of these, each
    its own number. That of the larger is at least ``longer(a)``; that of the smaller, without rounding, v b + o - t b >= v a where v <= t. Rounding takes less than 2.
    """
    return np.maximum(1, np.floor(np.asarray(size) * min(VOTES, t)) - 2).astype(np.int64)


#: Sizes fall into classes, each 5 % above the last; the last one is open.
_GROWTH = np.log(1.05)


def _class(size) -> np.ndarray:
    return np.minimum(255, np.floor(np.log(np.maximum(size, 1)) / _GROWTH + 1e-9)).astype(np.uint8)


def _gap(t: float) -> int:
    """The most that the classes of two sizes within reach can differ by."""
    return int(np.floor(1 - np.log(t) / _GROWTH + 1e-6)) + 1


def _fingerprints(g: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(g ^ GOLDEN), first) + size.astype(U) * GOLDEN)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


_PACKED = "part int, batch long, a binary, b binary, c binary, d binary"
_PACKED_ARROW = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])


def _packed(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKED_ARROW)], schema=_PACKED_ARROW)


def _index(n: int, t: float, bits: int, levels):
    """Text rows to packed rows. For each part of the hash space that occurs: 32 bits of the n-grams of the documents' prefixes, the document of each within the batch, and the class of its size. And, in parts from 2**bits on, the batch's documents: fingerprints, sizes, the rows' ids and the document of each."""
    parts = 1 << bits

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        ids, of, g, d, key, size, order = (np.concatenate([x[i] for x in held]) for i in range(7))
        with np.errstate(over="ignore"):
            at = np.arange(len(ids), dtype=U)
            batch = mix(np.bitwise_xor.reduce(mix(mix(ids.astype(U)) + key[of] + at * GOLDEN)) + U(len(ids)))
        u, first, inv = np.unique(key, return_index=True, return_inverse=True)  # one document a set
        o = np.lexsort((u, size[first]))  # numbered by size, so that classes come in order and take no room
        u, first, inv = u[o], first[o], np.argsort(o)[inv]
        kinds = _class(size[first])
        keep = np.zeros(len(key), bool)
        keep[first] = True
        m = keep[d]
        g, d, order = g[m], inv[d[m]], order[m]
        rows = [(parts + int(batch >> U(64 - bits) if bits else 0), batch.view(np.int64), u.tobytes(), size[first].astype("<u4").tobytes(), ids.astype("<i8").tobytes(), inv[of].astype("<u2").tobytes())]
        if len(g):
            o = np.lexsort((order, d))  # equal ones stay in the order of their hashes, as in any document
            g, d = g[o], d[o]
            start = _runs(d)
            many = np.diff(np.append(start, len(d)))
            rank = np.arange(len(d)) - np.repeat(start, many)
            m = rank < np.repeat(np.minimum(many, many - _need(many, t) + _longer(many, t)), many)
            g, d = g[m], d[m]
            part = (g >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(g), np.int64)
            o = np.argsort(part, kind="stable")
            low, d, part = ((g >> U(32 - bits)) & U(0xFFFFFFFF)).astype("<u4")[o], d[o].astype("<u2"), part[o]
            cut = np.append(_runs(part), len(part))
            rows += [(int(part[s]), batch.view(np.int64), low[s:e].tobytes(), d[s:e].tobytes(), kinds[d[s:e]].tobytes(), b"") for s, e in zip(cut, cut[1:])]
        yield _packed(rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams, docs = [], 0, 0
        for batch in it:
            for s, e in batches_by_chars(batch, 1, _CHARS):
                for lo in range(s, e, 8192):
                    hi = min(e, lo + 8192)
                    ids = np.asarray(batch.column(0).slice(lo, hi - lo), dtype=np.int64)
                    g, d, common = weighed_sets([x or "" for x in batch.column(1).slice(lo, hi - lo).to_pylist()], n, levels.value)
                    size = np.bincount(d, minlength=len(ids))
                    key = np.zeros(len(ids), U)  # of texts without a word
                    have = np.flatnonzero(size)
                    if len(have):
                        key[have] = _fingerprints(g, np.searchsorted(d, have), size[have])
                    held.append((ids, np.arange(len(ids)) + docs, g, d + docs, key, size, (common << U(48)) | (mix(g) >> U(16))))
                    grams, docs = grams + len(g), docs + len(ids)
                    if grams >= _FLUSH or docs > 50_000:
                        yield from flush(held)
                        held, grams, docs = [], 0, 0
        if held:
            yield from flush(held)

    return run


def _elect(t_: float, bits: int):
    """One part of the index: each n-gram that two or more documents hold elects one of them, the same for all whose sizes are within reach; documents are told for whom their n-grams vote, and how often.

    Holders in order of size fall into chains of neighbours within reach, each of which elects for itself.
    """
    parts, gap = 1 << bits, _gap(t_)

    def run(t: pa.Table) -> pa.Table:
        part = t.column(0)[0].as_py()
        if part >= parts:
            return pa.table([pa.array([part - parts] * t.num_rows, pa.int32()), *t.columns[1:]], schema=_PACKED_ARROW)
        batches = np.asarray(t.column(1)).astype(U)
        many = np.asarray(pc.binary_length(t.column(3)), dtype=np.int64) // 2
        g = np.frombuffer(b"".join(t.column(2).to_pylist()), "<u4")
        doc = np.frombuffer(b"".join(t.column(3).to_pylist()), "<u2").astype(U)
        name, of = np.unique(batches, return_inverse=True)
        kind = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8)
        who = (np.repeat(of, many).astype(U) << U(16)) | doc
        place = (g.astype(U) << U(8)) | kind
        o = np.lexsort((who, place))
        place, who = place[o], who[o]
        once = _runs(place, who)  # a batch of the same rows may have been read twice
        g, kind, who = place[once] >> U(8), (place[once] & U(255)).astype(np.int16), who[once]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (kind[1:] - kind[:-1] > gap)
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(g)))
        held = np.repeat(many > 1, many)
        if not held.any():
            return _PACKED_ARROW.empty_table()
        with np.errstate(over="ignore"):
            rank = mix(name[who >> U(16)] + (who & U(0xFFFF)) * GOLDEN)
        pivot = np.repeat(np.minimum.reduceat(rank, first), many)[held]
        who = who[held]
        o = np.lexsort((pivot, who))
        who, pivot = who[o], pivot[o]
        first = _runs(who, pivot)
        count = np.diff(np.append(first, len(who)))
        who, pivot = who[first], pivot[first]
        cut = np.append(_runs(who >> U(16)), len(who))
        rows = []
        for s, e in zip(cut, cut[1:]):
            batch = name[who[s] >> U(16)]
            rows.append((int(batch >> U(64 - bits) if bits else 0), batch.view(np.int64), (who[s:e] & U(0xFFFF)).astype("<u2").tobytes(), _pack(pivot[s:e]), count[s:e].astype("<u4").tobytes(), b""))
        return pa.Table.from_batches([_packed(rows)])

    return run


_DOC = "key long, doc long, size int, pivots array<long>, counts array<int>"
_DOC_ARROW = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("size", pa.int32()), ("pivots", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def _documents(t_: float):
    """One bucket of batches: a row for each row of text; those whose votes can reach a pair have, once a set, whom they voted for."""
    return lambda t: _voters(t, t_)


def _voters(t: pa.Table, t_: float) -> pa.Table:
    info: dict[int, tuple] = {}
    votes: dict[int, list] = {}
    for batch, a, b, c, d in zip(*(c.to_pylist() for c in t.columns[1:])):
        if d:
            info[batch] = (np.frombuffer(a, U), np.frombuffer(b, "<u4").astype(np.int64), np.frombuffer(c, "<i8"), np.frombuffer(d, "<u2"))
        else:
            votes.setdefault(batch, []).append((np.frombuffer(a, "<u2"), _unpack(b), np.frombuffer(c, "<u4").astype(np.int64)))
    cols: list[list] = [[] for _ in _DOC_ARROW]
    for batch, (key, size, ids, of) in info.items():
        sure: dict[int, tuple] = {}
        if batch in votes:
            doc, pivot, count = (np.concatenate([v[i] for v in votes[batch]]) for i in range(3))
            o = np.lexsort((pivot, doc))
            doc, pivot, count = doc[o], pivot[o], count[o]
            first = _runs(doc, pivot)
            doc, pivot, count = doc[first], pivot[first], np.add.reduceat(count, first)
            start = _runs(doc)
            total = np.add.reduceat(count, start)
            end = np.append(start[1:], len(doc))
            for i in np.flatnonzero(total >= _votes(size[doc[start]], t_)):
                s, e = start[i], end[i]
                sure[int(doc[s])] = (pivot[s:e].view(np.int64).tolist(), count[s:e].tolist())
        for c, v in zip(cols, (key[of].view(np.int64).tolist(), ids.tolist(), size[of].tolist())):
            c.extend(v)
        for d in of.tolist():
            p = sure.pop(d, (None, None))
            cols[3].append(p[0])
            cols[4].append(p[1])
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _DOC_ARROW)], schema=_DOC_ARROW)


def overlaps(col: np.ndarray, ptr: np.ndarray, width: int, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many columns each of rows has in common with each of others: by products of 0/1 blocks, and pair by pair for columns that few of them have."""
    out = np.zeros((len(rows), len(others)), np.float32)

    def entries(which):
        size = ptr[which + 1] - ptr[which]
        at = np.repeat(ptr[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.arange(len(which)), size), col[at]

    ra, ca = entries(rows)
    rb, cb = entries(others)
    na, nb = np.bincount(ca, minlength=width), np.bincount(cb, minlength=width)
    many = na * nb
    few = (many > 0) & (many * 512 <= out.size)
    if few.any():
        a, b = few[ca], few[cb]
        x, y, c = ra[a], rb[b], ca[a]
        o = np.argsort(cb[b], kind="stable")
        n = np.where(few, nb, 0)
        first = np.cumsum(n) - n
        for lo in range(0, len(x), 65536):
            k = c[lo : lo + 65536]
            size = n[k]
            at = np.repeat(first[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(out.reshape(-1), np.repeat(x[lo : lo + 65536], size) * len(others) + y[o[at]], np.float32(1))
    dense = (many > 0) & ~few
    name, width = np.cumsum(dense) - 1, int(dense.sum())
    a, b = dense[ca], dense[cb]
    ra, ca, rb, cb = ra[a], name[ca[a]], rb[b], name[cb[b]]
    step = 4096
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for lo in range(0, width, step):
        n = min(step, width - lo)
        sa, ea = np.searchsorted(ca, (lo, lo + n))
        sb, eb = np.searchsorted(cb, (lo, lo + n))
        x, y = np.zeros((len(rows), n), np.float32), np.zeros((len(others), n), np.float32)
        x[ra[sa:ea], ca[sa:ea] - lo] = 1
        y[rb[sb:eb], cb[sb:eb] - lo] = 1
        out += x @ y.T
    return out


def space(sets: list[np.ndarray]):
    """A function that gives the overlaps of some of the sets with others."""
    u, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    name = np.cumsum(df > 1) - 1
    keep = (df > 1)[inv]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep], minlength=len(sets)))])
    col, width = name[inv[keep]], int((df > 1).sum())
    return lambda rows, others: overlaps(col, ptr, width, rows, others)


def _distances(o: np.ndarray, size: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return 1 - o / (size[rows][:, None] + size[others][None, :] - o)


def _close(rows, others, size, common, t, met) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) of those of rows and of others that reach t and haven't met elsewhere."""
    o = common(rows, others)
    both = (size[rows][:, None] + size[others][None, :]).astype(np.float32)
    x, y = np.nonzero(o * np.float32(1 + t) >= both * np.float32(t * (1 - 1e-5)) - np.float32(1e-3))
    if len(x) and met is not None:
        new = met(rows, others)[x, y] == 0
        x, y = x[new], y[new]
    have = o[x, y].astype(np.float64)
    x, y = rows[x], others[y]
    v = have / (size[x] + size[y] - have)
    hit = v >= t - 1e-12
    return x[hit], y[hit], v[hit]


def _gathered(join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found: list[tuple] = []
    join(lambda *f: found.append(f))
    i, j, v = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
    return i.astype(np.int64), j.astype(np.int64), v


def join_sides(size: np.ndarray, sets: list[np.ndarray], t: float, left: np.ndarray, right: np.ndarray, emit=None, met=None):
    """As ``join_region``, for pairs of one of left and one of right."""
    if emit is None:
        return _gathered(lambda emit: join_sides(size, sets, t, left, right, emit, met))
    cross(left, right, size, space(sets), emit, t, met)


def join_region(size: np.ndarray, sets: list[np.ndarray], t: float, leaf: int = LEAF, emit=None, met=None):
    """All (i, j, jaccard), i < j, of one region that reach t, exactly; or emit takes them, block by block. size: of the whole sets; sets: the n-grams that can be in common; met: gives a number but 0 for pairs to be left out."""
    if emit is None:
        return _gathered(lambda emit: join_region(size, sets, t, leaf, emit, met))
    if len(size) == 2:
        o = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        j = o / (size[0] + size[1] - o)
        if j >= t - 1e-12 and (met is None or not met(np.zeros(1, np.int64), np.ones(1, np.int64))[0, 0]):
            emit(np.zeros(1, np.int64), np.ones(1, np.int64), np.full(1, j))
        return None
    common = space(sets)

    def exact(mine: np.ndarray) -> None:
        for lo in range(0, len(mine), 1024):
            for lo2 in range(lo, len(mine), 1024):
                x, y, v = _close(mine[lo : lo + 1024], mine[lo2 : lo2 + 1024], size, common, t, met)
                ok = x < y if lo == lo2 else np.ones(len(x), bool)
                if ok.any():
                    emit(np.minimum(x, y)[ok], np.maximum(x, y)[ok], v[ok])

    def divide(mine: np.ndarray, depth: int) -> list[tuple]:
        """Voronoi cells of pivots among mine, each with the boundary documents of earlier cells that a window of twice the radius lets in."""
        order = mine[np.argsort(mix(mine.astype(U) + U(depth + 1)), kind="stable")]
        pivots = order[: max(2, len(mine) // leaf * 2)]
        d = _distances(common(mine, pivots), size, mine, pivots)
        home = d.argmin(1)
        near = d[np.arange(len(mine)), home]
        reach = d <= near[:, None] + 2 * (1 - t) + 1e-6
        cells = []
        for k in range(len(pivots)):
            own = home == k
            if own.any():
                cells.append((mine[own], mine[reach[:, k] & (home < k)]))
        return cells

    todo = [(np.arange(len(size)), np.zeros(0, np.int64), 0)]
    while todo:
        own, edge, depth = todo.pop()
        if len(edge):
            cross(own, edge, size, common, emit, t, met)
        if len(own) <= leaf:
            exact(own)
            continue
        cells = divide(own, depth)
        if len(cells) == 1 or max(len(c[0]) for c in cells) > 0.9 * len(own):
            exact(own)
            continue
        todo += [(c, e, depth + 1) for c, e in cells]


def cross(own, edge, size, common, emit, t, met) -> None:
    """Pairs of a cell's own documents with the boundary documents replicated to it."""
    for lo in range(0, len(own), 1024):
        for lo2 in range(0, len(edge), 1024):
            x, y, v = _close(own[lo : lo + 1024], edge[lo2 : lo2 + 1024], size, common, t, met)
            if len(x):
                emit(np.minimum(x, y), np.maximum(x, y), v)


def _components(m: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(m)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _places(t: float, docs: DataFrame) -> DataFrame:
    """``(key, size, region, places)``: the regions of each n-gram set, weightiest pivots first, until the votes left out are too few; and all of a set's regions beside each."""
    once = docs.where("pivots is not null").groupBy("key").agg(F.first("size").alias("size"), F.first("pivots").alias("pivots"), F.first("counts").alias("counts"))
    vote = once.select("key", "size", F.explode(F.arrays_zip("pivots", "counts")).alias("p")).select("key", "size", F.col("p.pivots").alias("pivot"), F.col("p.counts").alias("c"))
    weight = vote.groupBy("pivot").agg(F.avg("c").alias("near"), F.count("*").alias("voters")).where("voters > 1")
    mine = Window.partitionBy("key")
    ranked = vote.join(weight, "pivot").withColumns({"before": F.sum("c").over(mine.orderBy(F.desc("near"), "pivot").rowsBetween(Window.unboundedPreceding, -1)), "total": F.sum("c").over(mine)})
    need = F.greatest(F.lit(1), F.floor(F.col("size") * F.lit(min(VOTES, t))) - 2)
    near = ranked.where(F.col("total") - F.coalesce("before", F.lit(0)) >= need).select("key", "size", F.col("pivot").alias("region"))
    shared = near.groupBy("region").agg(F.count("*").alias("rows"), F.sum("size").alias("grams_")).where("rows > 1")
    return near.join(shared, "region").withColumn("places", F.collect_list("region").over(mine))


def _bits_of(ids: np.ndarray, size: int) -> np.ndarray:
    return mix(ids.astype(U) + GOLDEN) & U(size - 1)


def _filter(ids: DataFrame, most: int = 1 << 28):
    """A bitmap of 16 bits an id, 32 MB at most, for passing over rows that need no second look; where it is full, it passes over fewer."""
    spark = ids.sparkSession
    size = min(most, 1 << max(10, (16 * ids.count()).bit_length()))

    def words(it):
        for b in it:
            at = _bits_of(np.asarray(b.column(0)), size)
            w, inv = np.unique((at >> U(6)).astype(np.int64), return_inverse=True)
            bits = np.zeros(len(w), U)
            np.bitwise_or.at(bits, inv, U(1) << (at & U(63)))
            yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(bits.view(np.int64))], names=["w", "bits"])

    got = ids.mapInArrow(words, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size >> 6, U)
    table[np.asarray(got.column(0))] = np.asarray(got.column(1)).view(U)
    return spark.sparkContext.broadcast(table)


def _sets(n: int, seen):
    """Text rows whose id is in the bitmap to (key, size, n-grams), once a set in each batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = seen.value
        for batch in it:
            at = _bits_of(np.asarray(batch.column(0)), len(table) << 6)
            batch = batch.filter(pa.array((table[at >> U(6)] >> (at & U(63))) & U(1) == 1))
            for s, e in batches_by_chars(batch, 1, _CHARS):
                g, d = gram_sets([x or "" for x in batch.column(1).slice(s, e - s).to_pylist()], n)
                if not len(g):
                    continue
                first = _runs(d)
                size = np.diff(np.append(first, len(d)))
                key, at = np.unique(_fingerprints(g, first, size), return_index=True)
                blobs = [_pack(g[first[i] : first[i] + size[i]]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(size[at], pa.int32()), pa.array(blobs, pa.binary())], names=["key", "size", "grams"])

    return run


_UNIT = ["unit", "side", "crossed", "home", "key", "size", "copies", "places", "grams"]
_CELL = "unit long, home long, key long, size int, copies long, places array<long>, grams binary, cell int, near array<int>"
_CELL_ARROW = pa.schema([("unit", pa.int64()), ("home", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("copies", pa.int64()), ("places", pa.list_(pa.int64())), ("grams", pa.binary()), ("cell", pa.int32()), ("near", pa.list_(pa.int32()))])


def _cells(t: float):
    """Part of a region and all its pivots: the Voronoi cell of each row, and the later cells whose window (twice the radius) lets it in."""

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _CELL_ARROW.empty_table()
        pivots = pivots.sort_by("pivot")
        sets = [_unpack(b) for b in [*rows.column("grams").to_pylist(), *pivots.column("pivot_grams").to_pylist()]]
        size = np.concatenate([np.asarray(rows.column("size")), np.asarray(pivots.column("pivot_size"))]).astype(np.int64)
        m = rows.num_rows
        common = space(sets)
        home, near = np.zeros(m, np.int32), []
        for lo in range(0, m, 1024):
            which = np.arange(lo, min(m, lo + 1024)), np.arange(m, len(size))
            d = _distances(common(*which), size, *which)
            k = d.argmin(1)
            home[lo : lo + len(k)] = k
            in_ = (d <= d.min(1)[:, None] + 2 * (1 - t) + 1e-6) & (np.arange(d.shape[1])[None, :] > k[:, None])
            near += [np.flatnonzero(x).tolist() for x in in_]
        cols = [rows.column(f.name) for f in list(_CELL_ARROW)[:7]]
        return pa.table([*cols, pa.array(home, pa.int32()), pa.array(near, pa.list_(pa.int32()))], schema=_CELL_ARROW)

    return run


def _blocks(rows: str, grams: str, most: int, most_grams: int):
    """Into how many blocks so much is to be cut, so that any two fit in a task."""
    return F.greatest(F.lit(1), F.ceil(F.col(rows) * 2 / most), F.ceil(F.col(grams) * 2 / most_grams)).cast("int")


def _tiles(rows: DataFrame, stats: DataFrame, most: int, most_grams: int) -> DataFrame:
    """All of each unit against all, block by block: each row goes to the tiles of its block."""
    cut = rows.join(stats.select("unit", _blocks("rows", "grams_", most, most_grams).alias("n_")), "unit")
    cut = cut.withColumn("b_", F.pmod(F.xxhash64("key", F.lit(7)), F.col("n_")).cast("int")).withColumn("j_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    lo, hi = F.least("b_", "j_"), F.greatest("b_", "j_")
    return cut.select(F.xxhash64("unit", F.lit("tile"), lo, hi).alias("unit"), F.when((lo < hi) & (F.col("b_") == hi), 1).otherwise(0).alias("side"), (lo < hi).alias("crossed"), *_UNIT[3:])


def divide(rows: DataFrame, t: float, most: int = ROWS, most_grams: int = GRAMS, n_pivots: int = PIVOTS, depth: int = DEPTH) -> DataFrame:
    """Units for tasks out of regions too large for one: Voronoi cells of n_pivots pivots a region, cells against the rows their windows let in, and again for what is still too large.

    A pair within the radius meets in one unit. Where cells and windows would spare less than half of all comparisons (pivots separate nothing) the region is cut into tiles.
    rows: ``unit, home, key, size, copies, places, grams``. The columns of the result are those of ``_UNIT``.
    """
    done: list[DataFrame] = []
    stats = rows.groupBy("unit").agg(F.count("*").alias("rows"), F.sum("size").alias("grams_"))
    for level in range(depth + 1):
        if level == depth:
            done.append(_tiles(rows, stats, most, most_grams))
            break
        first = Window.partitionBy("unit").orderBy(F.xxhash64("key", F.lit(level)), "key")
        pivots = rows.withColumn("r_", F.row_number().over(first)).where(F.col("r_") <= n_pivots).select(F.col("unit").alias("of"), F.col("key").alias("pivot"), F.col("size").alias("pivot_size"), F.col("grams").alias("pivot_grams"))
        salts = stats.select("unit", _blocks("rows", "grams_", 2 * most, 2 * most_grams).alias("n_"))
        left = rows.join(salts, "unit").withColumn("salt", F.pmod(F.xxhash64("key", F.lit(3)), F.col("n_")).cast("int")).drop("n_")
        right = pivots.join(salts.withColumnsRenamed({"unit": "of", "n_": "m_"}), "of").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m_") - 1))).drop("m_")
        cells = materialize(left.groupBy("unit", "salt").cogroup(right.groupBy("of", "part")).applyInArrow(_cells(t), _CELL), "ngram-cells")
        own = cells.groupBy("unit", "cell").agg(F.count("*").alias("rows"), F.sum("size").alias("grams_"))
        edges = cells.select("unit", F.explode("near").alias("cell"), "size").groupBy("unit", "cell").agg(F.count("*").alias("edges"), F.sum("size").alias("edge_grams"))
        per, whole = Window.partitionBy("unit"), F.sum("rows").over(Window.partitionBy("unit"))
        work = F.sum(F.col("rows") * (F.col("rows") / 2 + F.col("edges"))).over(per)
        # Tables of a few rows a region, whose true sizes the optimizer knows when it joins them to the rows.
        plan = materialize(
            own.join(edges, ["unit", "cell"], "left").fillna(0, ["edges", "edge_grams"])
            .withColumns({"stuck": work > whole * whole / 4, "large": (F.col("rows") > most) | (F.col("grams_") > most_grams), "own_": _blocks("rows", "grams_", most, most_grams), "edge_": _blocks("edges", "edge_grams", most, most_grams)}),
            "ngram-plan",
        )
        stuck = materialize(plan.where("stuck").groupBy("unit").agg(F.sum("rows").alias("rows"), F.sum("grams_").alias("grams_")), "ngram-stuck")
        free = materialize(plan.where("not stuck").select("unit", "cell", "large", "edges", "own_", "edge_"), "ngram-free")
        done.append(_tiles(cells, stuck, most, most_grams))
        cell = F.xxhash64("unit", F.lit("cell"), "cell")
        mine = cells.join(free, ["unit", "cell"]).withColumn("unit", cell)
        done.append(mine.where("not large").select("unit", F.lit(0).alias("side"), F.lit(False).alias("crossed"), *_UNIT[3:]))
        others = cells.withColumn("cell", F.explode("near")).join(free, ["unit", "cell"]).withColumn("unit", cell)
        for side, who, n, m in ((0, mine.where("edges > 0"), "own_", "edge_"), (1, others, "edge_", "own_")):
            x = who.withColumn("a_", F.pmod(F.xxhash64("key", F.lit(5)), F.col(n)).cast("int")).withColumn("b_", F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
            at = ("a_", "b_") if side == 0 else ("b_", "a_")
            done.append(x.select(F.xxhash64("unit", F.lit("edge"), *at).alias("unit"), F.lit(side).alias("side"), F.lit(True).alias("crossed"), *_UNIT[3:]))
        if free.where("large").isEmpty():
            break
        rows = materialize(mine.where("large").select("unit", *_UNIT[3:]), "ngram-large")
        stats = rows.groupBy("unit").agg(F.count("*").alias("rows"), F.sum("size").alias("grams_"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


_FOUND = "a long, b long, jaccard double, links long"
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("links", pa.int64())])


def _joined(t: float, pairs: bool):
    """Rows sorted by unit to pairs of sets; or, without pairs, to one link from each set to the first of its component in the unit (a, b) and the number of documents that each has within the radius (a, links). A pair that meets in several regions is that of the smallest."""

    def unit(home: int, crossed: bool, side, key, size, copies, places, blobs) -> list[tuple]:
        _, once = np.unique(np.stack([side.astype(np.int64), key]), axis=1, return_index=True)
        side, key, size, copies = (x[once] for x in (side, key, size, copies))
        if len(key) < 2:
            return []
        sets = [_unpack(blobs[i]) for i in once.tolist()]
        before = [np.array([r for r in places[i] if r < home], np.int64) for i in once.tolist()]
        met = space(before) if any(map(len, before)) else None
        join = lambda emit: join_sides(size, sets, t, np.flatnonzero(side == 0), np.flatnonzero(side == 1), emit, met) if crossed else join_region(size, sets, t, emit=emit, met=met)
        none = lambda n, kind: pa.nulls(n, kind)
        if pairs:
            i, j, v = _gathered(join)
            return [(np.minimum(key[i], key[j]), pa.array(np.maximum(key[i], key[j])), pa.array(v), none(len(i), pa.int64()))] if len(i) else []
        root, links, every = np.arange(len(key)), np.zeros(len(key)), np.arange(len(key))

        def count(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
            """The pairs of a block are counted and forgotten: a dense cluster has tens of millions of them."""
            nonlocal root, links
            links = links + np.bincount(i, copies[j], len(key)) + np.bincount(j, copies[i], len(key))
            apart = root[i] != root[j]
            if apart.any():
                root = _components(len(key), np.concatenate([every, i[apart]]), np.concatenate([root, j[apart]]))

        join(count)
        moved, some = np.flatnonzero(root != every), np.flatnonzero(links)
        if not len(some):
            return []
        return [(key[moved], pa.array(key[root[moved]]), none(len(moved), pa.float64()), none(len(moved), pa.int64())), (key[some], none(len(some), pa.int64()), none(len(some), pa.float64()), pa.array(links[some].astype(np.int64)))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out, n = None, [], [], 0

        def close() -> None:
            if sum(len(h[2]) for h in held) > 1:
                cols = [np.concatenate([h[k] for h in held]) for k in (2, 3, 4, 5)]
                out.extend(unit(int(held[0][0]), bool(held[0][1]), *cols, [x for h in held for x in h[6]], [x for h in held for x in h[7]]))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out])), *(pa.concat_arrays([o[k] for o in out]) for k in (1, 2, 3))], schema=_FOUND_ARROW)

        for b in it:
            if not b.num_rows:
                continue
            c = {name: b.column(k) for k, name in enumerate(_UNIT)}
            u = np.asarray(c["unit"])
            side, key, size, copies = np.asarray(c["side"]), np.asarray(c["key"]), np.asarray(c["size"]).astype(np.int64), np.asarray(c["copies"]).astype(np.float64)
            cuts = np.append(_runs(u), len(u))
            for s, e in zip(cuts.tolist(), cuts[1:].tolist()):
                if u[s] != now:
                    close()
                    now, held = u[s], []
                held.append((c["home"][s].as_py(), c["crossed"][s].as_py(), side[s:e], key[s:e], size[s:e], copies[s:e], c["places"].slice(s, e - s).to_pylist(), c["grams"].slice(s, e - s).to_pylist()))
            if sum(len(o[0]) for o in out) > 50_000:
                yield batch()
                out.clear()
        close()
        if out:
            yield batch()

    return run


def _near(df: DataFrame, id_col: str, text_col: str, n: int, t: float, pairs: bool, most: int, most_grams: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what ``_joined`` finds, a row for each row of text, ``(key, copies, first)``: how many ids each n-gram set has and the least)."""
    spark = df.sparkSession
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i is not null")
    if "Exchange" in src._jdf.queryExecution().executedPlan().toString():
        src = materialize(src, "ngram-texts")  # batches name rows by their place, which a shuffle that is read again may change
    size = input_bytes(df)
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))) if size is None else min(MAX_PARTS, max(8, size // PART_BYTES))
    bits = int(parts - 1).bit_length()
    levels = spark.sparkContext.broadcast(word_levels(src, size))
    elected = src.mapInArrow(_index(n, t, bits, levels), _PACKED).groupBy("part").applyInArrow(_elect(t, bits), _PACKED)
    docs = materialize(elected.groupBy("part").applyInArrow(_documents(t), _DOC), "ngram-docs")
    held = docs.where("size > 0").select("key", "doc").distinct().groupBy("key").agg(F.count("*").alias("copies"), F.min("doc").alias("first"))
    places = materialize(_places(t, docs).join(held, "key"), "ngram-places")
    seen = _filter(places.select("first").distinct())
    sets = src.mapInArrow(_sets(n, seen), "key long, size int, grams binary").groupBy("key").agg(F.first("grams").alias("grams"))
    rows = places.join(sets, "key").withColumns({"unit": F.col("region"), "home": F.col("region"), "large": (F.col("rows") > most) | (F.col("grams_") > most_grams)})
    units = rows.where("not large").select("unit", F.lit(0).alias("side"), F.lit(False).alias("crossed"), *_UNIT[3:])
    if not places.where((F.col("rows") > most) | (F.col("grams_") > most_grams)).isEmpty():
        units = units.unionByName(divide(materialize(rows.where("large").select("unit", *_UNIT[3:]), "ngram-large"), t, most, most_grams))
    found = units.select(_UNIT).repartition("unit").sortWithinPartitions("unit").mapInArrow(_joined(t, pairs), _FOUND)
    return found, docs, held


def ngram_jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.6, rows_a_task: int = ROWS, grams_a_task: int = GRAMS) -> DataFrame:
    """``(doc_a, doc_b, jaccard)`` for documents with Jaccard similarity of their word n-gram sets >= threshold: a row for each pair of sets, named by the smallest ids that have them, and for every other id with a set a row (smallest id, id, 1).

    doc_a < doc_b, but that of an id with several texts a pair may name the ids in either order of its sets. Rows with a null id and texts without a word take part in no
    pair. A text of fewer than n words has one n-gram, all its words. Rows that repeat an id with the same n-grams are one document; an id's different texts are
    points of their own, and never paired under one id. Texts are taken whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    found, docs, held = _near(df, id_col, text_col, n, threshold, True, rows_a_task, grams_a_task)
    name = held.select("key", "first")
    pairs = found.join(name.withColumnsRenamed({"key": "a", "first": "x"}), "a").join(name.withColumnsRenamed({"key": "b", "first": "y"}), "b").where("x <> y")
    copies = docs.where("size > 0").select("key", "doc").distinct().join(held.where("copies > 1"), "key").where("doc <> first")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard").unionByName(copies.select(F.col("first").alias("doc_a"), F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard")))


def _classes(df: DataFrame, id_col: str, text_col: str, n: int, threshold: float, most: int, most_grams: int) -> tuple[DataFrame, DataFrame]:
    """(rows of text with key, doc and size; ``(key, class, links)`` of the sets that have copies or anything within the radius, where class is a struct of the least doc and its key)."""
    found, docs, held = _near(df, id_col, text_col, n, threshold, False, most, most_grams)
    found = materialize(found, "ngram-found")
    roots = connected_components(found.where("b is not null").select("a", "b"))
    links = found.where("links is not null").groupBy("a").agg(F.sum("links").alias("links"))
    k = held.join(links, F.col("key") == F.col("a"), "left").join(roots, F.col("key") == F.col("id"), "left").where("copies > 1 or links is not null")
    k = k.select("key", F.coalesce("root", "key").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.struct("first", "key").alias("it"))
    least = k.groupBy("root").agg(F.min("it").alias("class"))
    return docs, k.join(least, "root").select("key", "class", "links")


def document_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.6, rows_a_task: int = ROWS, grams_a_task: int = GRAMS) -> DataFrame:
    """``(doc_id, class_id, links)``, a row for each id: the smallest id of all documents that are linked with it, directly or over others, by Jaccard similarity >= threshold, and the number of documents that it is linked with directly, exact copies among them.

    A document without links is its own class, so are null texts and texts without a word. A text of fewer than n words has one n-gram, all its words. Rows with a null id
    are in no result, as nothing names them. Rows that repeat an id with the same n-grams are one document; an id with different texts has the links of all of them,
    and the smallest of their classes. Texts are taken whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    docs, k = _classes(df, id_col, text_col, n, threshold, rows_a_task, grams_a_task)
    rows = docs.select("doc", F.when(F.col("size") > 0, F.col("key")).alias("key")).distinct().join(k, "key", "left")
    return rows.groupBy("doc").agg(F.min(F.coalesce("class.first", "doc")).alias("class_id"), F.sum(F.coalesce("links", F.lit(0))).alias("links")).select(F.col("doc").alias("doc_id"), "class_id", "links")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` with the smallest id of each component of edges (a, b) as its root, for ids other than roots; large-star and small-star rounds until nothing changes."""
    e = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b")
        e = materialize(small.where("a <> b").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = tuple(state)

def _keyed(n: int, text_at: int):
    """Rows with the fingerprint of their n-gram set (0 without a word) as a last column."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s, e in batches_by_chars(b, text_at, _CHARS):
                g, d = gram_sets([x or "" for x in b.column(text_at).slice(s, e - s).to_pylist()], n)
                key = np.zeros(e - s, U)
                if len(g):
                    first = _runs(d)
                    key[d[first]] = _fingerprints(g, first, np.diff(np.append(first, len(d))))
                yield pa.RecordBatch.from_arrays([*b.slice(s, e - s).columns, pa.array(key.view(np.int64))], schema=pa.schema([*(pa.field(f"c{k}", c.type) for k, c in enumerate(b.columns)), pa.field("key", pa.int64())]))

    return run


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, threshold: float = 0.6, rows_a_task: int = ROWS, grams_a_task: int = GRAMS) -> DataFrame:
    """The rows of df without near copies: of each group of texts linked by pairs within the radius, the one with the smallest id stays, whole and unchanged.

    Of rows repeating an id with one n-gram set, one stays (any). Where an id has different texts, each is judged by itself. Rows with a null id or text, or without a word, stay all.
    Columns may have any names.
    """
    docs, k = _classes(df, id_col, text_col, n, threshold, rows_a_task, grams_a_task)
    rows = docs.where("size > 0").select("doc", "key").join(k, "key")
    gone = rows.where((F.col("doc") != F.col("class.first")) | (F.col("key") != F.col("class.key"))).select("doc", "key").distinct()
    again = docs.where("size > 0").groupBy("doc", "key").count().where("count > 1").select("doc", "key")
    several = docs.groupBy("doc").agg(F.count_distinct("key").alias("n")).where("n > 1").select("doc")
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    i, t = (f"c{[x.lower() for x in df.columns].index(c.lower())}" for c in (id_col, text_col))
    odd = materialize(again.select("doc").unionByName(several).distinct(), "ngram-odd")
    if odd.isEmpty():
        return plain.join(gone.select("doc"), F.col(i).cast("long") == F.col("doc"), "left_anti").toDF(*df.columns)
    usual = plain.join(gone.select("doc").join(odd, "doc", "left_anti").unionByName(odd), F.col(i).cast("long") == F.col("doc"), "left_anti")
    rest = plain.join(odd, F.col(i).cast("long") == F.col("doc"), "left_semi")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest.schema) + ", key long"
    rest = rest.mapInArrow(_keyed(n, int(t[1:])), kind)
    rest = rest.join(gone, (F.col(i).cast("long") == F.col("doc")) & (rest["key"] == gone["key"]), "left_anti")
    wordless = rest.where("key = 0").drop("key")
    return usual.unionByName(wordless).unionByName(rest.where("key <> 0").dropDuplicates([i, "key"]).drop("key")).toDF(*df.columns)


def classes_sql(n: int = 3, threshold: float = 0.6) -> str:
    """``document_classes`` for DuckDB: an inverted list of the n-grams themselves, and the closure of the links."""
    return f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < {n} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' ')) END) AS gram FROM w),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT doc_a, doc_b FROM p JOIN s x ON x.doc_id = doc_a JOIN s y ON y.doc_id = doc_b WHERE o >= {threshold} * (x.n + y.n - o) - 1e-12),
r AS (SELECT doc_a AS a, doc_b AS b FROM e UNION SELECT r.a, e.doc_b FROM r JOIN e ON r.b = e.doc_a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
l AS (SELECT doc_a, count(*) AS n FROM e GROUP BY doc_a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.b, d.doc_id)) AS class_id, coalesce(l.n, 0)::BIGINT AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN c ON c.a = d.doc_id LEFT JOIN l ON l.doc_a = d.doc_id
"""
