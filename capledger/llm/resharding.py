"""Minimum-cost-flow resharding: which blocks leave which shard, so that shards keep to new capacities and the fewest bytes move; then the files of the shards that give something up are rewritten."""

from __future__ import annotations

import heapq
import math
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.llm.common import local_table, materialize, scratch

#: Blocks a shard of average size is cut into; larger ones are cut into more, of the same size.
BLOCKS = 64
SLACK = 0.05


class Flow:
    """Successive shortest paths with potentials; costs may not be negative."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, s: int, t: int) -> tuple[int, int]:
        """(amount, cost) of the cheapest largest flow."""
        n, amount, price = len(self.out), 0, 0
        height = [0] * n
        while True:
            far = [math.inf] * n
            by = [-1] * n
            far[s] = 0
            heap = [(0, s)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] and (v := d + self.cost[e] + height[x] - height[y]) < far[y]:
                        far[y], by[y] = v, e
                        heapq.heappush(heap, (v, y))
            if far[t] == math.inf:
                return amount, price
            height = [h + f if f < math.inf else h for h, f in zip(height, far)]
            x, push = t, math.inf
            while x != s:
                push = min(push, self.room[by[x]])
                x = self.to[by[x] ^ 1]
            x = t
            while x != s:
                self.room[by[x]] -= push
                self.room[by[x] ^ 1] += push
                price += push * self.cost[by[x]]
                x = self.to[by[x] ^ 1]
            amount += push


def transfers(old: dict[str, int], capacity: dict[str, int]) -> dict[tuple[str, str], int]:
    """Bytes to move from shard to shard, the fewest in all. Staying is free, moving costs a unit a byte; moves go through one hub, so arcs are as many as shards."""
    if sum(old.values()) > sum(capacity.values()):
        raise ValueError("the new capacities hold less than there is")
    names = sorted(old.keys() | capacity.keys())
    k = len(names)
    src, hub, end = 2 * k, 2 * k + 1, 2 * k + 2
    f = Flow(2 * k + 3)
    leave, enter = {}, {}
    for i, n in enumerate(names):
        f.arc(src, i, old.get(n, 0), 0)
        f.arc(i, k + i, old.get(n, 0), 0)
        leave[n] = f.arc(i, hub, old.get(n, 0), 1)
        enter[n] = f.arc(hub, k + i, capacity.get(n, 0), 0)
        f.arc(k + i, end, capacity.get(n, 0), 0)
    f.solve(src, end)
    gives = [[n, f.room[leave[n] ^ 1]] for n in names if f.room[leave[n] ^ 1]]
    takes = [[n, f.room[enter[n] ^ 1]] for n in names if f.room[enter[n] ^ 1]]
    out: dict[tuple[str, str], int] = {}
    while gives and takes:
        a, b = gives[-1], takes[-1]
        x = min(a[1], b[1])
        if a[0] != b[0]:
            out[a[0], b[0]] = out.get((a[0], b[0]), 0) + x
        a[1] -= x
        b[1] -= x
        if not a[1]:
            gives.pop()
        if not b[1]:
            takes.pop()
    return out


#: Sums that lie nearer to one another than this part of what is due count as one where there are more of them.
FINE, SUMS = 1 << 12, 1 << 13


def covers(sizes: list[int], due: int, most: int = 64) -> list[list[int]]:
    """Sets of places in sizes whose sums reach due, those of the smallest sums first.

    Sums up to due are built block by block; exact up to SUMS of them, beyond which sums within due / FINE of one another are taken for one,
    so that a cover exceeds the smallest by a part of 1 / FINE for each block at most.
    """
    below: dict[int, tuple] = {0: ()}
    over: dict[int, tuple] = {}
    for k, size in enumerate(sizes):
        new: dict[int, tuple] = {}
        for total, chain in below.items():
            x = total + size
            if x >= due:
                if x not in over:
                    over[x] = (k, chain)
            elif x not in below:
                new[x] = (k, chain)
        below |= new
        if len(over) > 4 * most:
            over = dict(sorted(over.items())[:most])
        if len(below) > SUMS:
            step, kept = max(1, due // FINE), {}
            for total in sorted(below, reverse=True):
                kept.setdefault(total // step, total)
            below = {t: below[t] for t in kept.values()}
    out = []
    for _, chain in sorted(over.items())[:most]:
        places = []
        while chain:
            places.append(chain[0])
            chain = chain[1]
        out.append(places)
    return out


def placed(moved: list[tuple[int, str, int]], arcs: dict[tuple[str, str], int], room: dict[str, int]) -> dict[tuple[str, int], str] | None:
    """A taker for each block: along the arcs of the flow as long as these last, largest blocks first, else where the most room is left; None where some block finds no room."""
    left, room, out, rest = dict(arcs), dict(room), {}, []
    for size, giver, b in sorted(moved, reverse=True):
        arc = max(((n, t) for (g, t), n in left.items() if g == giver and n >= size and room.get(t, 0) >= size), default=None)
        if arc is None:
            rest.append((size, giver, b))
            continue
        out[giver, b] = arc[1]
        left[giver, arc[1]] -= size
        room[arc[1]] -= size
    heap = [(-r, n) for n, r in room.items() if r > 0]
    heapq.heapify(heap)
    for size, giver, b in rest:
        if not heap or -heap[0][0] < size:
            return None
        r, n = heapq.heappop(heap)
        out[giver, b] = n
        heapq.heappush(heap, (r + size, n))
    return out


def choose(blocks: dict[str, dict[int, int]], capacity: dict[str, int]) -> dict[tuple[str, int], str] | None:
    """Whole blocks for the flow: of each giver those of the smallest sum that covers what it must give, along the flow's arcs. Where these can't all be placed, the next larger covers are tried; None where none can."""
    old = {n: sum(b.values()) for n, b in blocks.items()}
    arcs = transfers(old, capacity)
    room = {n: c - old.get(n, 0) for n, c in capacity.items()}
    due = {n: size - capacity.get(n, 0) for n, size in old.items() if size > capacity.get(n, 0)}
    ways: dict[str, list[list[tuple[int, str, int]]]] = {}
    for giver in sorted(due):
        own = sorted(((size, b) for b, size in blocks[giver].items() if size), reverse=True)
        ways[giver] = [[(own[k][0], giver, own[k][1]) for k in places] for places in covers([size for size, _ in own], due[giver])]
    at = dict.fromkeys(ways, 0)
    while True:
        found = placed([m for g, w in ways.items() for m in w[at[g]]], arcs, room)
        if found is not None:
            return found
        # The next in order of what it adds.
        more = [(sum(x[0] for x in w[at[g] + 1]) - sum(x[0] for x in w[at[g]]), g) for g, w in ways.items() if at[g] + 1 < len(w)]
        if not more:
            return None
        at[min(more)[1]] += 1


def choose_what_fits(blocks: dict[str, dict[int, int]], capacity: dict[str, int]) -> dict[tuple[str, int], str]:
    """As ``choose``, but a block that finds no room stays where it is, so that its shard may keep more than its capacity."""
    old = {n: sum(b.values()) for n, b in blocks.items()}
    heap = [(old.get(n, 0) - c, n) for n, c in capacity.items() if c > old.get(n, 0)]
    heapq.heapify(heap)
    due = {n: size - capacity.get(n, 0) for n, size in old.items() if size > capacity.get(n, 0)}
    out: dict[tuple[str, int], str] = {}

    def move(size: int, giver: str, b: int) -> None:
        r, n = heapq.heappop(heap)
        out[giver, b] = n
        due[giver] -= size
        heapq.heappush(heap, (r + size, n))

    for size, giver, b in sorted(((size, n, b) for n in due for b, size in blocks[n].items() if size), reverse=True):
        if heap and size <= min(due[giver], -heap[0][0]):
            move(size, giver, b)
    for giver in sorted(due):
        if due[giver] > 0 and heap:
            cover = [(size, b) for b, size in blocks[giver].items() if due[giver] <= size <= -heap[0][0] and (giver, b) not in out]
            if cover:
                size, b = min(cover)
                move(size, giver, b)
    return out


def _size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def _free(names: list[str], wanted: str) -> str:
    """wanted, with as many underscores as tell it from the names."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Bytes of a file that is written.
FILE_BYTES = 256 << 20


def reshard(df: DataFrame, capacity: dict[str, int] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "source", slack: float = SLACK) -> tuple[DataFrame, DataFrame, str]:
    """(assignment of every row, transfers, folder of the rewritten rows).

    The assignment is ``(doc_id, old_shard, new_shard, n_bytes, moved)``. A shard is a value of ``shard_col`` (null is the
    shard ``unknown``), its size the UTF-8 bytes of its texts (0 for null ones). Without capacities every shard gets an equal
    part of the whole and ``slack``; capacities that hold less than there is are a ValueError. Rows that are equal in all columns (maps aside) move together. A row larger than what any
    taker has free stays where it is, and a warning says by how many bytes its shard exceeds its capacity. In the folder lie, partitioned by
    ``new_shard``, all rows of the shards that give something up, with all their columns and ``old_shard``, ``new_shard`` and ``n_bytes``
    (with underscores at the end where columns have these names); other shards' files need not be touched, and what
    they receive is added beside them. An empty table has no shards. Columns may have any names.
    """
    spark, names = df.sparkSession, df.columns
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))
    where = {n.lower(): f"c{k}" for k, n in enumerate(names)}
    i, text, shard = F.col(where[id_col.lower()]), F.col(where[text_col.lower()]), F.coalesce(F.col(where[shard_col.lower()]).cast("string"), F.lit("unknown"))
    whole = [F.col(f.name) for f in plain.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    spot = F.xxhash64(*whole).bitwiseAND(F.lit((1 << 40) - 1))
    narrow = materialize(plain.select(i.alias("id"), shard.alias("old"), _size(text).alias("bytes"), spot.alias("spot")), "reshard")
    sizes = {r["old"]: r["n"] for r in narrow.groupBy("old").agg(F.sum("bytes").alias("n")).collect()}
    total = sum(sizes.values())
    if capacity is None:
        capacity = {n: math.ceil(total * (1 + slack) / len(sizes)) for n in sizes}
    moves, per, cuts, after = {}, BLOCKS, {}, dict(sizes)
    givers = sorted({a for a, _ in transfers(sizes, capacity)})
    while givers:
        # Blocks of about one size; their number is that of the shards times BLOCKS, whatever the data's size.
        cuts = {n: max(1, round(sizes[n] * per * len(sizes) / max(total, 1))) for n in givers}
        table = local_table(spark, list(cuts.items()), "old string, cuts long")
        blocks: dict[str, dict[int, int]] = {n: {} if n in cuts else {0: size} for n, size in sizes.items()}
        for r in narrow.join(table, "old").groupBy("old", F.expr("spot % cuts").alias("block")).agg(F.sum("bytes").alias("n")).collect():
            blocks[r["old"]][r["block"]] = r["n"]
        found = choose(blocks, capacity)
        if found is None and per <= BLOCKS << 8:
            per *= 4
            continue
        moves = choose_what_fits(blocks, capacity) if found is None else found
        for (a, b), n in moves.items():
            after[a] -= blocks[a][b]
            after[n] = after.get(n, 0) + blocks[a][b]
        over = {n: size - capacity.get(n, 0) for n, size in sorted(after.items()) if size > capacity.get(n, 0)}
        if over:
            warnings.warn(f"rows find no room elsewhere; bytes over capacity by shard: {over}", stacklevel=2)
        break
    givers = sorted({a for a, _ in moves})
    plan = local_table(spark, [(a, int(b), c) for (a, b), c in moves.items()], "old string, block long, new string")
    flow = plan.groupBy("old", "new").agg(F.count("*").alias("blocks"))
    cut = local_table(spark, [(g, cuts[g]) for g in givers], "old string, cuts long")
    path = scratch(spark, "shards")
    kept = narrow.where(~F.col("old").isin(*givers) if givers else F.lit(True)).select(F.col("id").alias("doc_id"), F.col("old").alias("old_shard"), F.col("old").alias("new_shard"), F.col("bytes").alias("n_bytes"), F.lit(False).alias("moved"))
    if not givers:
        return kept, flow, path
    slices = local_table(spark, [(n, -(-size // FILE_BYTES) or 1) for n, size in after.items()], "new string, slices long")
    rows = plain.where(shard.isin(*givers)).withColumns({"old": shard, "bytes": _size(text), "spot": spot}).join(cut, "old")
    rows = rows.withColumn("block", F.expr("spot % cuts")).join(plan, ["old", "block"], "left").withColumn("new", F.coalesce("new", "old")).join(slices, "new")
    o, w, z = (_free(names, x) for x in ("old_shard", "new_shard", "n_bytes"))
    done = rows.repartition("new", F.expr("(spot div 64) % slices")).select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), F.col("old").alias(o), F.col("bytes").alias(z), F.col("new").alias(w))
    done.write.partitionBy(w).parquet(path)
    back = spark.read.schema(done.schema).parquet(path).toDF(*(f"c{k}" for k in range(len(names))), "old_shard", "n_bytes", "new_shard").withColumn("new_shard", F.coalesce("new_shard", F.lit("")))  # what a file's path has for an empty name is read as null
    return kept.unionByName(back.select(F.col(where[id_col.lower()]).alias("doc_id"), "old_shard", "new_shard", "n_bytes", (F.col("old_shard") != F.col("new_shard")).alias("moved"))), flow, path


def resharded(df: DataFrame, **kw) -> DataFrame:
    return reshard(df, **kw)[0]
