"""Approximate nearest neighbours by shifted space-filling curves.

Every distinct vector gets a place on many Hilbert curves: each projects the unit
vectors to a few dimensions with a rotation of its own, shifts and quantises them, and
takes the index along the curve. Spark sorts by range of that index, which gives every
vector a rank on each curve. A curve carries the vector's id and its direction in one byte for each
component, not the vector. Queries are dealt to the blocks of ranks that their window reaches into, so that a
block lies in one place however many queries there are; a query looks at the ranks of its window and
no others, and takes the best of them by those bytes. What the windows of all curves give is merged by
id, and the best are ranked once by the cosine of the original vectors.

How wide windows must be depends on the data. For a bounded sample of queries the true
neighbours are found by brute force; the window is the width within which ``REACHED`` of
those pairs meet on one curve or another, and a tenth more. On clustered vectors that
is narrow. Vectors without structure in 64 dimensions are hard for any index: windows must then
hold a share of the index that shrinks only slowly as it grows, see the README for figures.

Copies are indexed once, with the six least of their ids: five answers never need more.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as
query or as candidate; a query's candidates are the vectors of its own length; components of any
finite size are scaled by a power of two first; a null vec_id takes no part; repeated rows count once; ties go
to the smaller vec_id; with fewer candidates than five all are returned; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, grouped, spread, written

CURVES, DIMENSIONS, BITS = 48, 8, 7
TOP = 5
BLOCK = 8192  # ranks of a curve that one task holds
TAKEN, RANKED = 12, 24  # a query's best of a window; of all windows
SAMPLE = 64  # queries by which windows are measured
REACHED = 0.95


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of rows of cell numbers below 2**bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns of each level, from the coarsest
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) > 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b) & 1
    return key


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, its greatest component below 1, so that no square leaves the range of a double."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True, initial=0))[1])


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Index of each vector on each curve."""
    d = vectors.shape[1]
    x = scaled(vectors)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.zeros((len(vectors), CURVES), np.int64)
    for c in range(CURVES):
        rng = np.random.Generator(np.random.PCG64(1000 + c))
        k = min(d, DIMENSIONS)
        turn = np.linalg.qr(rng.normal(size=(d, k)))[0]
        spread = unit @ turn * np.sqrt(d) / 6 + 0.5 + rng.uniform(-0.08, 0.08, k)  # three deviations to either side
        cells = np.clip(spread * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        out[:, c] = hilbert(cells, BITS)
    return out


def codes(vectors: np.ndarray) -> list[bytes]:
    """Direction of each vector, one byte for each component."""
    x = scaled(vectors)
    return [r.tobytes() for r in np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)]


def directions(held: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(held), np.int8).reshape(len(held), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each summed alone, so that a pair's value is the same wherever it is computed."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best(queries: np.ndarray, vectors: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, cosine) of the ``top`` nearest of each query by brute force."""
    q, x = scaled(queries), scaled(vectors)
    q, x = q / np.linalg.norm(q, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    rows, cols = [], []
    for lo in range(0, len(q), 256):
        near = q[lo : lo + 256] @ x.T
        k = min(top, near.shape[1])
        edge = np.partition(near, near.shape[1] - k, axis=1)[:, -k] - 1e-9
        r, c = np.nonzero(near >= edge[:, None])
        rows.append(r + lo)
        cols.append(c)
    r, c = np.concatenate(rows), np.concatenate(cols)
    score = cosine(queries[r], vectors[c])
    order = np.lexsort((c, -score, r))
    r, c, score = r[order], c[order], score[order]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < top
    return r[keep], c[keep], score[keep]


def distinct_vectors(table: DataFrame) -> DataFrame:
    """gid (least vec_id), ids (the six least) and embedding of each distinct vector that takes part."""
    e = F.col("embedding").cast("array<double>")
    rows = table.select(F.col("vec_id").cast("long"), e.alias("embedding")).where("vec_id is not null and embedding is not null")
    sound = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = rows.where(sound).distinct()
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= TOP + 1)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("gid"), "ids", "embedding")


def arrays(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows) of a list column, one for each length."""
    lists = column.combine_chunks()
    length = lists.value_lengths().to_numpy()
    flat, begin = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(length) - length
    out = []
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        out.append((at, flat[begin[at][:, None] + np.arange(n)]))
    return out


def ranked(vectors: DataFrame) -> DataFrame:
    """A row for each vector and curve: lane (the curve among vectors of one length), rank on it, gid and code."""

    def run(batches):
        for table in grouped(batches, 1 << 20):
            gid = table["gid"].to_numpy()
            for at, x in arrays(table["embedding"]):
                keys, held = curve_keys(x), pa.array(codes(x), pa.binary())
                lane = np.tile(x.shape[1] * CURVES + np.arange(CURVES), len(at))
                yield pa.RecordBatch.from_arrays([pa.array(lane), pa.array(keys.ravel()), pa.array(np.repeat(gid[at], CURVES)), held.take(pa.array(np.repeat(np.arange(len(at)), CURVES)))], ["lane", "key", "gid", "code"])

    laid = spread(vectors, "gid").mapInArrow(run, "lane long, key long, gid long, code binary")
    spark = vectors.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = ["lane", "key", "gid"]
    lined = written(laid.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()).drop("key"), "curves")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    # One row for each partition and lane in it: where the lane begins there, and how many of the lane lie before.
    sizes = sorted(tuple(r) for r in lined.groupBy("lane", part.alias("part")).agg(F.min(inside), F.count("*")).collect())
    starts, at, last = [], 0, None
    for lane, p, begin, n in sizes:
        at = at if lane == last else 0
        starts.append((lane, p, at - begin))
        at, last = at + n, lane
    shift = spark.createDataFrame(starts, "lane long, part long, shift long")
    return lined.withColumn("part", part).join(F.broadcast(shift), ["lane", "part"]).select("lane", (inside + F.col("shift")).alias("rank"), "gid", "code")


def window_width(order: DataFrame, vectors: DataFrame, queries: DataFrame) -> int:
    """Ranks to either side within which the sample's true neighbours are met on some curve."""
    sample = queries.orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).select("gid", "embedding").toArrow()
    asked = {x.shape[1]: (sample["gid"].to_numpy()[at], x) for at, x in arrays(sample["embedding"])} if sample.num_rows else {}

    def run(batches):
        for table in grouped(batches, 4 << 20):
            gid = table["gid"].to_numpy()
            for at, x in arrays(table["embedding"]):
                if x.shape[1] in asked:
                    names, q = asked[x.shape[1]]
                    r, c, score = best(q, x, TOP + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(gid[at][c]), pa.array(score)], ["q", "v", "score"])

    near = vectors.select("gid", "embedding").mapInArrow(run, "q long, v long, score double")
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "v"))).where(F.col("n") <= TOP + 1).where("q <> v").select("q", "v")
    places = order.select("lane", "gid", "rank")
    pairs = places.join(F.broadcast(top), F.col("gid") == F.col("v")).select("lane", "q", "v", F.col("rank").alias("rv"))
    own = places.where(F.col("gid").isin([int(g) for names, _ in asked.values() for g in names])).select(F.col("lane").alias("lane2"), F.col("gid").alias("q2"), F.col("rank").alias("rq"))
    apart = pairs.join(F.broadcast(own), (F.col("lane") == F.col("lane2")) & (F.col("q") == F.col("q2"))).groupBy("q", "v").agg(F.min(F.abs(F.col("rv") - F.col("rq"))).alias("d"))
    d = np.array([r["d"] for r in apart.collect()])  # SAMPLE * TOP at most
    return int(np.quantile(d, REACHED) * 1.1 + 16) if len(d) else BLOCK


def windows(order: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(q, gid, near): the best of each window by their codes."""
    block = lambda rank: F.floor(rank / BLOCK)
    rows = order.select((F.col("lane") + 0).alias("lane"), block(F.col("rank")).alias("block"), (F.col("rank") + 0).alias("rank"), (F.col("gid") + 0).alias("gid"), F.concat("code").alias("code"))
    reach = F.sequence(block(F.greatest(F.lit(0), F.col("rank") - width)), block(F.col("rank") + width))
    dealt = order.join(wanted, "gid").select("lane", F.explode(reach).alias("block"), F.col("rank").alias("rank"), F.col("gid").alias("q"), F.col("code").alias("asked"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("rank")
            rank, gid, x = left["rank"].to_numpy(), left["gid"].to_numpy(), directions(left["code"].to_pylist())
            asked, at, names = directions(right["asked"].to_pylist()), right["rank"].to_numpy(), right["q"].to_numpy()
            for i, (lo, hi) in enumerate(zip(np.searchsorted(rank, at - width), np.searchsorted(rank, at + width, side="right"), strict=True)):
                near = x[lo:hi] @ asked[i]
                k = min(TAKEN, len(near))
                some = np.argpartition(-near, k - 1)[:k] if k < len(near) else np.arange(len(near))
                out.append((np.full(k, names[i]), gid[lo + some], near[some]))
        q, v, near = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"q": pa.array(q, pa.int64()), "gid": pa.array(v, pa.int64()), "near": pa.array(near, pa.float32())})

    by = ["lane", "block"]
    return rows.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(meet, "q long, gid long, near float")


def nearest(table: DataFrame, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for queries whose vec_id is divisible by ``every``."""
    spark = table.sparkSession
    with batch_rows(spark, 2000):
        vectors = written(distinct_vectors(table), "vectors")
        order = written(ranked(vectors), "order")
        members = table.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.pmod("query_id", F.lit(every)) == 0).distinct()
        asked = written(members.join(vectors.select("gid", "embedding"), "embedding").select("query_id", "gid"), "queries")
        wanted = asked.select("gid").distinct()
        width = window_width(order, vectors, vectors.join(wanted, "gid"))
        merged = windows(order, wanted, width).groupBy("q", "gid").agg(F.max("near").alias("near"))
        first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "gid"))
        few = written(merged.withColumn("n", first).where(F.col("n") <= RANKED).select("q", "gid"), "near")
    found = few.join(vectors, "gid").join(vectors.select(F.col("gid").alias("q"), F.col("embedding").alias("asked")), "q")

    def rerank(batches):
        for part in grouped(batches, 4 << 20):
            score = np.zeros(part.num_rows)
            for (at, x), (_, y) in zip(arrays(part["asked"]), arrays(part["embedding"]), strict=True):
                score[at] = cosine(x, y)
            yield pa.RecordBatch.from_arrays([part["q"].combine_chunks(), part["gid"].combine_chunks(), part["ids"].combine_chunks(), pa.array(score)], ["q", "gid", "ids", "score"])

    exact = found.select("q", "gid", "ids", "asked", "embedding").mapInArrow(rerank, "q long, gid long, ids array<long>, score double")
    top = exact.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "gid"))).where(F.col("n") <= TOP + 1)
    answers = asked.join(top, asked["gid"] == top["q"]).select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= TOP).select("query_id", "rank", "vec_id", "score")
