"""Resharding by minimum-cost flow.

Documents lie in old shards, which differ in size. From the old sizes and the new
capacities a flow network is solved: bytes that stay in their shard cost nothing,
bytes that move cost one each. The flow says how many bytes of each old shard go to
which new one. Documents larger than a fixed share of the capacity (there can only be so
many of them) can't be parted, so that they are dealt to the flow's shares one by one, and the
flow is solved again for what is left. Within an old shard the other documents are ordered by
a hash of their id and text, copies by their row; the shares are cut from that order as block
transfers. The places of the cuts come from histograms, refined until a cut falls between two
rows, so that no shard is ever sorted or gathered as a whole. Then the files of shards that gain or
lose a document are rewritten, and no others.

Law: ``bytes``, sizes near equal: each cut misses its place by half a document at most, one that
is not dealt alone and so under a 400th of a shard, unless a single larger document exceeds a shard's share. Bytes moved exceed the least possible by
less than one such large document for each shard. The driver holds one number for each old
shard, new shard and bin that a cut falls into, and fewer than ``16 * LARGE_PART`` large documents.

Defined results: a null text has size 1; equal rows may come to different shards and have
slots of their own; a null doc_id is placed like the empty id; an empty table gives an empty
table; further columns, whatever their names, are ignored by ``resharded`` and kept by ``rewrite``,
whose partition column gets underscores before its name while an input column has it. Equal
texts are not kept together: a group of copies may exceed a shard's capacity.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, unused, written

SHARDS = 16
#: Documents above capacity / LARGE_PART are placed one by one; fewer than SHARDS * LARGE_PART exist.
LARGE_PART = 400
#: Of a position the upper bits are a hash of id and text, the lower ones of the row; bits that one histogram resolves.
HASHED, COPIED, BITS = 36, 26, 12
WIDTH = HASHED + COPIED


def old_shard(docs: DataFrame, old: int = 12) -> Column:
    """The layout that resharding starts from where the input names none: by source, and so uneven."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(old)).cast("int")


class Network:
    """A flow network with costs, solved for the least cost by shortest paths, a blocking flow for each length."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Add an arc and its residual; returns the arc's number, whose flow is the room of the next number."""
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def distances(self, source: int) -> list[float]:
        far = [float("inf")] * len(self.arcs)
        far[source] = 0
        queue, queued = deque([source]), {source}
        while queue:
            a = queue.popleft()
            queued.discard(a)
            for e in self.arcs[a]:
                b = self.to[e]
                if self.room[e] and far[a] + self.cost[e] < far[b]:
                    far[b] = far[a] + self.cost[e]
                    if b not in queued:
                        queued.add(b)
                        queue.append(b)
        return far

    def solve(self, source: int, sink: int) -> None:
        while (far := self.distances(source))[sink] < float("inf"):
            # All paths of the shortest length, one after the other; an arc that leads no further is not tried again.
            tried, path, on = [0] * len(self.arcs), [], {source}
            at = source
            while True:
                if at == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    path, at, on = [], source, {source}
                    continue
                while tried[at] < len(self.arcs[at]):
                    e = self.arcs[at][tried[at]]
                    if self.room[e] and far[at] + self.cost[e] == far[self.to[e]] and self.to[e] not in on:
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    e = path.pop()
                    on.discard(at)
                    at = self.to[e ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                at = self.to[e]
                on.add(at)


def min_cost_flow(supply: list[int], capacity: list[int], home: list[int | None]) -> dict[tuple[int, int], int]:
    """Bytes from each supply to each capacity (of equal sums) at the least cost: 0 to the supply's ``home``, 1 elsewhere.

    What moves passes through one node in the middle, which keeps the network small.
    """
    n, m = len(supply), len(capacity)
    net, source, middle, sink = Network(n + m + 3), n + m, n + m + 1, n + m + 2
    stays, leaves = {}, []
    for i, s in enumerate(supply):
        net.arc(source, i, s, 0)
        if home[i] is not None:
            stays[i] = net.arc(i, n + home[i], s, 0)
        leaves.append(net.arc(i, middle, s, 1))
    comes = [net.arc(middle, n + j, c, 0) for j, c in enumerate(capacity)]
    for j, c in enumerate(capacity):
        net.arc(n + j, sink, c, 0)
    net.solve(source, sink)
    flow = {(i, home[i]): net.room[e + 1] for i, e in stays.items() if net.room[e + 1]}
    # What passed through the middle, in order.
    out, into = [[i, net.room[e + 1]] for i, e in enumerate(leaves)], [[j, net.room[e + 1]] for j, e in enumerate(comes)]
    j = 0
    for i, left in out:
        while left:
            part = min(left, into[j][1])
            if part:
                flow[i, into[j][0]] = flow.get((i, into[j][0]), 0) + part
                left -= part
                into[j][1] -= part
            if left:
                j += 1
    return flow


def level_capacities(total: int, taken: list[int]) -> list[int]:
    """Room for each shard so that sizes come out equal, or as near as what is placed allows; the sum is what is left."""
    rest = total - sum(taken)
    order = sorted(range(len(taken)), key=lambda j: taken[j])
    room = [0] * len(taken)
    for k in range(len(order), 0, -1):
        some = order[:k]
        level, over = divmod(rest + sum(taken[j] for j in some), k)
        if level >= taken[some[-1]]:
            for r, j in enumerate(some):
                room[j] = level - taken[j] + (r < over)
            return room
    return room


def laid(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """A written table of the documents (as struct ``doc``) with row number, size, checksum, old shard and position."""
    text = F.col("text").cast("string")
    columns = [
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"), (old_shard(docs) if old is None else old).cast("int").alias("old_shard"),
    ]
    hashed = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32"), 64 - HASHED)
    copied = F.shiftrightunsigned(F.xxhash64("row"), 64 - COPIED)
    return written(docs.select(*columns).withColumn("position", F.shiftleft(hashed, COPIED).bitwiseOR(copied)), "laid")


def _cuts(rows: DataFrame, goals: list[dict]) -> None:
    """Give each goal (old shard, bytes before it) its place: the first position after the cut, as ``lo``.

    Each round counts the bins that still hold a cut with finer steps, until such a bin holds one row.
    """
    width = WIDTH
    open_ = goals
    while open_ and width:
        step = min(BITS, width)
        spark = rows.sparkSession
        wanted = sorted({(g["old"], g["lo"] >> width) for g in open_})
        bins_ = F.broadcast(spark.createDataFrame(wanted, "old_shard int, prefix long"))  # as many as cuts at most
        inside = rows.withColumn("prefix", F.shiftright("position", width)).join(bins_, ["old_shard", "prefix"])
        width -= step
        counted = inside.groupBy("old_shard", F.shiftright("position", width).alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        bins: dict = {}
        for o, b, size, n in sorted(tuple(r) for r in counted):
            bins.setdefault((o, b >> step), []).append((b, size, n))
        following = []
        for g in open_:
            found = bins.get((g["old"], g["lo"] >> (width + step)), [])
            at = g["before"]
            for b, size, n in found:
                if at + size > g["goal"]:
                    break
                at += size
            else:  # the cut is at the bin's end
                g["lo"] = ((g["lo"] >> (width + step)) + 1) << (width + step)
                continue
            g["lo"], g["before"] = b << width, at
            if n > 1 and width:
                following.append(g)
            elif 2 * (g["goal"] - at) > size:  # the row goes to the nearer side
                g["lo"] = (b + 1) << width
        open_ = following


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
    """New shards of large documents by row, and the cuts of each old shard: (first position after the cut, new shard), in order."""
    sums = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    total = sum(sums.values())
    if not total:
        return {}, {}
    share = max(1, total // shards // LARGE_PART)
    large = sorted(((r.size, r.position, r.row, r.old_shard) for r in rows.where(F.col("size") > share).select("size", "position", "row", "old_shard").collect()), key=lambda r: (-r[0], *r[1:]))
    olds = sorted(sums)
    home = [o if 0 <= o < shards else None for o in olds]
    place = {o: i for i, o in enumerate(olds)}
    flow = min_cost_flow([sums[o] for o in olds], level_capacities(total, [0] * shards), home)
    shares = [{j: flow.get((i, j), 0) for j in range(shards)} for i in range(len(olds))]
    taken, placed = [0] * shards, {}
    room = level_capacities(total, [0] * shards)
    for size, _, row, old in large:
        i = place[old]
        # Where the flow still sends as much; else where it sends most; else where most room is left.
        fits = [j for j in range(shards) if shares[i][j] >= size and room[j] >= size]
        j = home[i] if home[i] in fits else max(fits or range(shards), key=lambda j: (min(shares[i][j], room[j]) if fits else room[j], -j))
        shares[i][j] -= size
        room[j] -= size
        taken[j] += size
        sums[old] -= size
        placed[row] = j
    flow = min_cost_flow([sums[o] for o in olds], level_capacities(total, taken), home)
    goals = []
    for i, o in enumerate(olds):
        parts = sorted((j, f) for (a, j), f in flow.items() if a == i)
        at = 0
        for j, f in parts[:-1]:
            at += f
            goals.append({"old": o, "goal": at, "lo": 0, "before": 0, "shard": j})
    _cuts(rows.where(F.col("size") <= share), goals)
    cuts = {}
    for i, o in enumerate(olds):
        last = max((j for (a, j) in flow if a == i), default=o % shards)
        cuts[o] = [*((g["lo"], g["shard"]) for g in goals if g["old"] == o), (1 << 62, last)]
    return placed, cuts


def assigned(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` of ``laid`` with their new shard. Both tables of the plan are of bounded size and broadcast, so that nothing is shuffled."""
    spark = rows.sparkSession
    placed, cuts = plan(rows, shards)
    by_old = spark.createDataFrame([(o, [c[0] for c in parts], [c[1] for c in parts]) for o, parts in cuts.items()], "old_shard int, ends array<long>, to array<int>")
    by_row = spark.createDataFrame(list(placed.items()), "row long, alone int")
    passed = F.size(F.filter("ends", lambda end: end <= F.col("position")))
    shard = F.coalesce("alone", F.element_at("to", passed + 1))
    return rows.join(F.broadcast(by_old), "old_shard").join(F.broadcast(by_row), "row", "left").withColumn("shard", shard).drop("ends", "to", "alone")


def slotted(rows: DataFrame) -> DataFrame:
    """``rows`` with a gapless number within their shard, by way of 1,024 bins of a shard."""
    rows = rows.withColumn("bin", F.pmod(F.xxhash64("row"), F.lit(1024)))
    counts = rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bin", (F.sum("n").over(Window.partitionBy("shard").orderBy("bin")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("row"))
    return rows.withColumn("place", place).join(F.broadcast(before), ["shard", "bin"]).withColumn("slot", (F.col("before") + F.col("place") - 1).cast("long"))


def changes(rows: DataFrame) -> dict[int, bool]:
    """Every shard, old or new, and whether it gains or loses a document. One row for each pair that a block passes between."""
    moves = [(r.old_shard, r.shard) for r in rows.select("old_shard", "shard").distinct().collect()]
    changed = {x for a, b in moves if a != b for x in (a, b)}
    return {s: s in changed for s in sorted({x for pair in moves for x in pair})}


def _rewritten(rows: DataFrame, target: str, partition: str, *more: str) -> dict[int, bool]:
    """Write the files of changed shards under ``target``; returns ``changes``."""
    found = changes(rows)
    rows.where(F.col("shard").isin([s for s, c in found.items() if c])).select("doc.*", *more, F.col("shard").alias(partition)).write.partitionBy(partition).mode("append").parquet(target)
    return found


def rewrite(spark: SparkSession, source: str, target: str, old: Column, shards: int = SHARDS) -> DataFrame:
    """Write the documents of ``source`` that lie in changed shards as ``target/shard=N``; (shard, changed) for all shards, old or new.

    A shard that neither gains nor loses a document is left alone: its rows are those of its
    old shard. A changed shard without files is one that loses everything. Rows are told apart by
    themselves, so that repeated rows stay as many.
    """
    docs = spark.read.parquet(source)
    found = _rewritten(assigned(laid(docs, old), shards), target, unused("shard", docs.columns))
    return spark.createDataFrame(list(found.items()), "shard int, changed boolean")


def resharded(docs: DataFrame, old: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    The files of changed shards are rewritten in the shared folder, and size and checksum come from what
    is read back of them; rows of other shards come from where they lie.
    """
    spark = docs.sparkSession
    rows = assigned(laid(docs.select("doc_id", "text", "source") if old is None else docs, old))
    target = shared_path(spark, "resharded")
    found = _rewritten(rows.select("old_shard", "shard", F.struct("doc_id", F.col("doc.text").cast("string").alias("text")).alias("doc"), "row"), target, "shard", "row", "old_shard")
    text = F.col("text").cast("string")
    kept = rows.where(~F.col("shard").isin([s for s, c in found.items() if c])).select("doc_id", "size", "text_crc32", "row", "old_shard", "shard")
    if any(found.values()):
        back = spark.read.schema("doc_id long, text string, row long, old_shard int, shard int").parquet(target)
        read = back.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).cast("long").alias("text_crc32"), "row", "old_shard", "shard")
        kept = kept.unionByName(read)
    return slotted(kept).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
