"""Helpers that every operator of this package shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Records in one Arrow batch sent to Python. Small, so that a run of very long
#: texts stays within a worker's memory; ``grouped`` joins small batches again.
ARROW_RECORDS = 256


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of texts that Spark sends to Python workers, for the rest of the session, since frames run later."""
    spark.conf.set(BATCH, str(ARROW_RECORDS))


@contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Other batches for what runs inside, such as rows of a few numbers."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(n))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def grouped(batches: Iterable[pa.RecordBatch], target: int = 8 << 20) -> Iterator[pa.Table]:
    """Join Arrow batches until they hold ``target`` bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= target:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


#: Bytes by which words (digits, lower-case letters, all beyond ASCII) are told from what lies between them.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain_words(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.translate(_PLAIN).split() if text else []


def shards(column: pa.Array, target: int = 8 << 20) -> Iterator[list[bytes | None]]:
    """A binary column cut into lists of some ``target`` bytes, each of one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + target, "right")))
        yield column.slice(begin, end - begin).to_pylist()
        begin = end


#: Folders made for this process's applications, by their ids, where none is named.
_made: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``, or by ``setCheckpointDir``. Where both are missing a local
    folder serves if driver and executors are one process, as in tests; else it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _made.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="lodestone-")
        _made[context.applicationId] = folder
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


#: Tables of this process in the shared folder, in the order in which they were begun.
_paths: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which ends its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def begun() -> int:
    """How many tables have been begun so far; for ``discard``."""
    return len(_paths)


def discard(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Remove the tables begun after the first ``since``, other than those that ``keep`` reads."""
    kept = "\n".join(keep.inputFiles())
    for path in _paths[since:]:
        if path.rpartition("/")[2] not in kept:
            remove(spark, path)
            _paths.remove(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over as many partitions as a shuffle has, however small it is, for work that makes many rows of each."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def unused(name: str, columns: Iterable[str]) -> str:
    """``name``, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``shared_path`` through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fold(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n``; a null doc_id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
