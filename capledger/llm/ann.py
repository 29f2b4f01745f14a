"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are turned by a seeded random rotation and stored in column blocks; k-means lists are probed in order of
their centroids' distance; within a list a candidate's squared distance is summed block by block, and after each block a
hypothesis test at a given significance decides whether its distance can still be below the query's k-th best: if not, it is
abandoned. Queries are the rows whose id is divisible by EVERY, against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.common import materialize, mix

K = 10
LIST_SIZE = 256
#: So many lists are probed that of the true neighbours of SAMPLE rows, found by brute force, this share lies in them.
TARGET = 0.96
SAMPLE = 256
#: Vectors that lie together in one task: lists are grouped, and a query goes once to each group it probes.
GROUP = 65536
BLOCK = 16
#: Candidates are abandoned beyond (1 + EPSILON / sqrt(dimensions read)) times the limit.
EPSILON = 2.1
ROUNDS = 4
#: Lists there are at most, and rows and bytes that they are fitted on: bounds on what the driver holds and every executor gets. Beyond, lists are longer.
MAX_LISTS, FIT_ROWS, FIT_BYTES = 4096, 65536, 64 << 20
EVERY = 100
SEED = 5
_ROLES = ["unit", "role", "id", "x", "lim", "lists"]


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float32).reshape(-1, dim)


def _nearest(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The nearest centroids of each row, nearest first."""
    out = []
    for s in range(0, len(x), 2048):
        d = (c * c).sum(1)[None, :] - 2 * x[s : s + 2048] @ c.T
        p = np.argpartition(d, probes - 1, axis=1)[:, :probes] if probes < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        o = np.take_along_axis(d, p, 1).argsort(1, kind="stable")
        out.append(np.take_along_axis(p, o, 1))
    return np.concatenate(out) if out else np.zeros((0, probes), np.int64)


def fit(x: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd rounds over a sample, on the driver, from its first rows."""
    c = x[:lists].copy()
    for _ in range(ROUNDS):
        home = _nearest(x, c, 1)[:, 0]
        total, n = np.zeros(c.shape), np.bincount(home, minlength=len(c))
        np.add.at(total, home, x)
        c[n > 0] = (total[n > 0] / n[n > 0][:, None]).astype(np.float32)
    return c


def scan_list(q: np.ndarray, limit: np.ndarray, x: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, squared distance) of the candidates no block's test abandons. limit: each query's squared k-th best so far.

    While most of a tile's candidates go on, a block is added for all of them by a matrix product; once few are left, for these alone.
    """
    out = []
    for s in range(0, len(q), 256):
        a, lim = q[s : s + 256], limit[s : s + 256].astype(np.float32)
        total, width, i = np.zeros((len(a), len(x)), np.float32), 0, None
        j = d = None
        while width < dim and (i is None or len(i)):
            to = min(width + BLOCK, dim)
            bound = lim * np.float32((1 + EPSILON / np.sqrt(to)) ** 2 * to / dim if to < dim else 1)
            if i is None:
                u, v = a[:, width:to], x[:, width:to]
                total += (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T)
                on = total <= bound[:, None]
                if to == dim or on.mean() < 0.06:
                    i, j = np.nonzero(on)
                    d = total[i, j]
                elif to + BLOCK < dim or not on.all():
                    total[~on] = np.inf
            else:
                d = d + ((a[i, width:to] - x[j, width:to]) ** 2).sum(1)
                ok = d <= bound[i]
                i, j, d = i[ok], j[ok], d[ok]
            width = to
        if len(i):
            d = ((a[i] - x[j]) ** 2).sum(1)  # what is left is few: exact, without the products' rounding
        out.append((i + s, j, d))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, int),) * 3


_FOUND = "id long, other long, d double"


def _best(a: np.ndarray, c: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k nearest of each query, ties by id; sorted by query."""
    o = np.lexsort((c, d, a))
    q = a[o]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    return o[np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k]


def _search(dim: int, k: int):
    """Rows sorted by unit: members first, each with its list, then queries, each with its lists and the k-th best found before."""

    def answer(part: pa.RecordBatch, lists: dict) -> pa.RecordBatch | None:
        ids, x, lim = np.asarray(part.column(2)), _matrix(part.column(3), dim), np.asarray(part.column(4))
        of = part.column(5)
        row = np.repeat(np.arange(len(ids)), np.diff(np.asarray(of.offsets)))
        wanted = np.asarray(of.flatten())
        o = np.argsort(wanted, kind="stable")
        row, wanted = row[o], wanted[o]
        out = []
        cuts = np.append(np.flatnonzero(np.concatenate([[True], wanted[1:] != wanted[:-1]])), len(wanted))
        for s, e in zip(cuts, cuts[1:]):
            if (held := lists.get(int(wanted[s]))) is not None:
                r = row[s:e]
                a, c, d = scan_list(x[r], lim[r], held[1], dim)
                a, c = ids[r[a]], held[0][c]
                out.append((a[a != c], c[a != c], d[a != c]))
        if not out:
            return None
        a, c, d = (np.concatenate([z[n] for z in out]) for n in range(3))
        top = _best(a, c, d, k)
        return pa.RecordBatch.from_arrays([pa.array(a[top], pa.int64()), pa.array(c[top], pa.int64()), pa.array(d[top].astype(np.float64), pa.float64())], names=["id", "other", "d"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, lists = None, [], None
        for b in it:
            if not b.num_rows:
                continue
            group, role = np.asarray(b.column(0)), np.asarray(b.column(1))
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (role[1:] != role[:-1])) + 1).tolist(), len(group)]
            for s, e in zip(cuts, cuts[1:]):
                if group[s] != now:
                    now, held = group[s], []
                if role[s] == 0:
                    part = b.slice(s, e - s)
                    held.append((np.asarray(part.column(2)), _matrix(part.column(3), dim), np.asarray(part.column(5).flatten())))
                    lists = None
                    continue
                if not held:
                    continue
                if lists is None:
                    ids, xs, ls = (np.concatenate([h[n] for h in held]) for n in range(3))
                    lists = {int(v): (ids[ls == v], xs[ls == v]) for v in np.unique(ls)}
                for at in range(s, e, 2048):
                    if (found := answer(b.slice(at, min(2048, e - at)), lists)) is not None:
                        yield found

    return run


def _probes(index: DataFrame, asks: DataFrame, centroids: np.ndarray, dim: int, k: int) -> int:
    """The fewest lists that hold TARGET of the true neighbours of a seeded sample of the queries."""
    ask = asks.orderBy(F.xxhash64(F.lit(SEED + 1), "id"), "id").limit(SAMPLE).select("id", "x").toArrow()
    if not ask.num_rows:
        return 1
    q_id, q = np.asarray(ask["id"]), _matrix(ask["x"].combine_chunks(), dim)

    def brute(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, x, home = np.asarray(b.column(0)), _matrix(b.column(1), dim), np.asarray(b.column(2))
            for s in range(0, len(x), 8192):
                d = ((q * q).sum(1)[:, None] + (x[s : s + 8192] ** 2).sum(1)[None, :] - 2 * q @ x[s : s + 8192].T).clip(0)
                d[q_id[:, None] == ids[None, s : s + 8192]] = np.inf
                n = min(k, d.shape[1])
                j = np.argpartition(d, n - 1, axis=1)[:, :n]
                i = np.repeat(np.arange(len(q)), n)
                j = j.ravel()
                ok = np.isfinite(d[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(q_id[i[ok]], pa.int64()), pa.array(home[s + j[ok]], pa.int32()), pa.array(d[i[ok], j[ok]].astype(float))], names=["id", "list", "d"])

    near = index.mapInArrow(brute, "id long, list int, d double")
    got = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "list"))).where(F.col("r") <= k).select("id", "list").toArrow()
    rank = np.argsort(_nearest(q, centroids, len(centroids)), axis=1)
    at = {int(i): n for n, i in enumerate(q_id)}
    ranks = np.sort([rank[at[i], v] for i, v in zip(got["id"].to_pylist(), got["list"].to_pylist())])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(TARGET * len(ranks))))]) + 1 if len(ranks) else 1


def units(sizes: np.ndarray, order: np.ndarray, least: int, most: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each list, first unit of each group, units of each group): neighbouring lists share a group while they hold few enough members; the members of a group that holds more go to several units by their ids."""
    room = max(1, min(most, int(sizes.sum()) // max(1, least)))
    group, held, g = np.zeros(len(sizes), np.int64), 0, 0
    total = [0]
    for v in order.tolist():
        if held and held + sizes[v] > room:
            g, held = g + 1, 0
            total.append(0)
        group[v] = g
        held += int(sizes[v])
        total[g] = held
    many = np.maximum(1, -(-np.array(total) // most))
    return group, np.cumsum(many) - many, many


def nearest_neighbours(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, list_size: int = LIST_SIZE, every: int = EVERY, sample_rows: int = FIT_ROWS, unit_rows: int = GROUP) -> DataFrame:
    """``(vec_id, neighbour_id, rank, distance)``: about the k nearest other vectors (Euclidean), among all rows, of every row whose id is divisible by ``every``, nearest first, ties by id.

    The lists are fitted on about ``sample_rows`` rows, chosen by a hash of their ids; every row is in the index. Rows with a null id, a null vector, a null, NaN or infinite component, or another length than the table's most common one
    neither ask nor answer. Rows repeating an id count once, with the smallest vector. Fewer than k others give fewer
    rows. Components of any finite size are taken: where one exceeds 1e15, all are scaled down together, and single precision holds relative to the largest. Distances are rounded to 5 places; other columns are ignored, whatever their names; ids are integers.
    """
    spark = df.sparkSession
    x = F.col(f"`{vector_col}`").cast("array<float>")
    good = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), x.alias("x")).where("id is not null and x is not null and size(x) > 0").where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= 3.4028235e38)))
    facts = good.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(F.greatest(F.abs(F.array_min("x")), F.abs(F.array_max("x")))).alias("most")).orderBy(F.desc("n"), "dim").first()
    if facts is None:
        return spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, distance double")
    dim, n, scale = facts["dim"], facts["n"], min(1.0, 1e15 / max(facts["most"], 1e-30))
    turn = rotation(dim).astype(np.float64) * scale
    good = good.where(F.size("x") == dim)

    def turned(col: pa.Array) -> np.ndarray:
        return (np.asarray(col.flatten(), np.float64).reshape(-1, dim) @ turn).astype(np.float32)

    least = min(1.0, min(sample_rows, FIT_BYTES // (4 * dim)) / n)
    drawn = good.where(F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "id"), 11) < F.lit(int(least * (1 << 53)))).groupBy("id").agg(F.min("x").alias("x")).toArrow()
    drawn = drawn.take(np.argsort(np.asarray(drawn["id"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable"))
    sample = turned(drawn["x"].combine_chunks()) if drawn.num_rows else turned(good.limit(1).toArrow()["x"].combine_chunks())
    c = fit(sample, max(1, min(round(n / list_size), MAX_LISTS, len(sample))))
    shared = spark.sparkContext.broadcast(c)  # MAX_LISTS rows at most

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m = turned(b.column(1))
            home = _nearest(m, shared.value, 1)[:, 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(m.ravel(), pa.float32()), dim).cast(pa.list_(pa.float32())), pa.array(home)], names=["id", "x", "home"])

    index = materialize(good.groupBy("id").agg(F.min("x").alias("x")).mapInArrow(place, "id long, x array<float>, home int"), "vectors")
    asks = index.where(F.col("id") % every == 0)
    near = _probes(index, asks, c, dim, k)
    sizes = np.zeros(len(c), np.int64)
    held = index.groupBy("home").count().toArrow()
    sizes[np.asarray(held["home"])] = np.asarray(held["count"])
    # Lists whose centroids lie in the same direction share a group.
    axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0] if len(c) > 1 else np.ones(dim)
    group, first, many = units(sizes, np.argsort(c @ axis, kind="stable"), int(spark.conf.get("spark.sql.shuffle.partitions", "200")), unit_rows)

    def member(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            home = np.asarray(b.column(2))
            g = group[home]
            unit = first[g] + (mix(np.asarray(b.column(0)).astype(np.uint64)) % many[g].astype(np.uint64)).astype(np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(home, pa.int32()), 1).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), pa.array(np.zeros(len(home), np.int32)), b.column(0), b.column(1), pa.array(np.zeros(len(home))), lists], names=_ROLES)

    def asker(lo: int, hi: int):
        """Each query once for every unit of a group that holds some of its lists from the lo-th on."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for s in range(0, b.num_rows, 512):
                    part = b.slice(s, 512)
                    p = _nearest(_matrix(part.column(1), dim), shared.value, hi)[:, lo:]
                    row = np.repeat(np.arange(len(p)), p.shape[1])
                    flat = p.ravel()
                    g = group[flat]
                    o = np.lexsort((flat, g, row))
                    row, flat, g = row[o], flat[o], g[o]
                    start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (g[1:] != g[:-1])])) if len(row) else np.zeros(0, int)
                    count = np.diff(np.append(start, len(row)))
                    copies = many[g[start]]
                    at = np.repeat(np.arange(len(start)), copies)
                    nth = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
                    size = count[at]
                    value = flat[np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(value, pa.int32()))
                    who = pa.array(row[start[at]])
                    yield pa.RecordBatch.from_arrays([pa.array(first[g[start[at]]] + nth, pa.int32()), pa.array(np.ones(len(at), np.int32)), part.column(0).take(who), part.column(1).take(who), part.column(2).take(who), lists], names=_ROLES)

        return run

    roles = "unit int, role int, id long, x array<float>, lim double, lists array<int>"
    members = index.mapInArrow(member, roles)

    def answers(queries: DataFrame, lo: int, hi: int) -> DataFrame:
        rows = queries.mapInArrow(asker(lo, hi), roles)
        return members.unionByName(rows).repartition("unit").sortWithinPartitions("unit", "role").mapInArrow(_search(dim, k), _FOUND)

    # The two nearest lists give each query a limit, which the tests in its other lists are held against.
    best = Window.partitionBy("id").orderBy("d", "other")
    home = materialize(answers(asks.select("id", "x", F.lit(3.4e38).alias("lim")), 0, min(2, len(c))), "home")
    found = home
    if near > 2:
        limit = home.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("id", F.col("d").alias("lim"))
        found = home.unionByName(answers(asks.join(limit, "id", "left").select("id", "x", F.coalesce("lim", F.lit(3.4e38)).alias("lim")), 2, near))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), F.col("other").alias("neighbour_id"), "rank", F.round(F.sqrt("d") / scale, 5).alias("distance"))
