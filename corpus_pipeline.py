"""A corpus pipeline: from raw documents to token ids.

Toxic documents go, then poor ones, then near copies; sources are mixed to their target
weights, and what is left is encoded. Each stage's result is written to the shared folder
and read again as the next one's input, so that a lost executor costs part of one stage;
tables that only served earlier stages are removed.

Stages keep columns as they are, extra ones too. Null and empty texts score as texts without
insults, are judged by the quality classifier like any other, and all texts without words
are copies of each other. Rows are told apart by themselves: different texts under one doc_id, or
under none, are different documents; repeated rows are copies. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, quality, sentencepiece_codec, simhash, token_counts, toxicity
from lodestone.llm.common import begun, discard, read, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, read(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, read(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encoded(docs, token_counts.model_bytes()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_classifier", drop_poor),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The classifiers and fingerprints can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    since = begun()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        discard(spark, since, docs)
    return docs
