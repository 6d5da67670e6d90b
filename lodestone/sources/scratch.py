"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Folders made where none is named, by application.
_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder, named by the setting or by ``setCheckpointDir``; a local one is made only where driver and executors are one process."""
    context = spark.sparkContext
    named = spark.conf.get(SETTING, None) or context.getCheckpointDir() or _made.get(context.applicationId)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {SETTING} to a folder that driver and executors share")
        named = _made[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return named.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, so that what follows reads it and a lost executor costs no more than a part of one step."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
