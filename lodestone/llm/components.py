"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, shared_path


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of the edges (u, v); label is the component's least node.

    Alternating stars: first each node's larger neighbours are tied to its least
    neighbour, then its smaller ones; the number of edges never grows, and rounds
    grow with the logarithm of a component's size. Every round is written to the
    shared folder, so that a lost executor costs one round at most. Self-loops and
    repeated edges do no harm; an empty table gives an empty table.
    """
    spark = edges.sparkSession
    path = shared_path(spark, "edges")
    edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().write.parquet(path)
    mark = None
    for _ in range(most_rounds):
        e = spark.read.schema("u long, v long").parquet(path)
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        following = shared_path(spark, "edges")
        out.write.parquet(following)
        e = spark.read.schema("u long, v long").parquet(following)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, path)
        path = following
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    tied = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return tied.union(tied.select(F.col("label").alias("node"), "label").distinct())
