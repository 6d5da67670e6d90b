"""Queries of this package: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontamination, html_text, media, mixing, quality, resampling, sentencepiece_codec, sharding, simhash, token_counts, toxicity
from .common import read


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(read(spark, sf_dir, "documents"), token_counts.model_bytes())


def op2_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(read(spark, sf_dir, "documents"), files=True)


def op3_space_filling_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"))


def op4_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.resharded(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), token_counts.model_bytes())


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_media_chunks, op3_space_filling_curves, op4_block_labeller, op5_toxicity, op6_quality, op7_min_cost_flow_resharding, op8_simhash, op9_mixing, op10_token_counts, op11_decontamination, op12_importance_resampling)}

#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {"op9_mixing": mixing.SQL, "op11_decontamination": decontamination.SQL, "op12_importance_resampling": resampling.SQL}
