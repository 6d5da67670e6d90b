"""The passage index: one Parquet table in versioned folders, and a pointer to the current one."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class IndexNotBuilt(RuntimeError):
    pass


class IndexCorrupt(IndexNotBuilt):
    pass


def save(chunks: DataFrame, folder: str) -> int:
    """Write a new version and then point to it, so that a failed write leaves the old one; returns its number of chunks."""
    spark = chunks.sparkSession
    if chunks.isEmpty():
        raise ValueError("nothing to index")
    version = f"v{time.time_ns()}"
    chunks.write.parquet(f"{folder}/{version}")
    n = spark.read.parquet(f"{folder}/{version}").count()
    spark.createDataFrame([(version, n, time.time_ns())], "version string, n long, at long").coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return n


def load(spark: SparkSession, folder: str, dimension: int | None = None) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        at = spark.read.parquet(f"{folder}/current").orderBy(F.desc("at")).first()
        found = spark.read.parquet(f"{folder}/{at['version']}")
    except AnalysisException as e:
        raise IndexNotBuilt(f"no index in {folder}") from e
    if found.count() != at["n"] or dimension and found.where(F.col("vector").isNull() | (F.size("vector") != dimension)).limit(1).count():
        raise IndexCorrupt(f"the index in {folder} is not what was written")
    return found


def generation(spark: SparkSession, folder: str) -> int:
    """How many versions were written so far; answers kept for an older one are stale."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{folder}/current").count()
    except AnalysisException:
        return 0


def size(spark: SparkSession, folder: str) -> int:
    try:
        return load(spark, folder).count()
    except IndexNotBuilt:
        return 0


def fingerprint(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and a SHA-256 over the sums of their own, which doesn't depend on their order."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(chunks.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    n = F.count("*")
    return chunks.agg(n.alias("n"), F.sha2(F.concat_ws("|", n.cast("string"), *parts), 256).alias("fingerprint"))
