"""Ask a question bank of all documents and judge what is found.

    python -m jobs.evaluate_bank DOCUMENTS BANK OUT [--config jobs/evaluate_bank.json]

Every question of BANK (item_id, text) is searched in DOCUMENTS (doc_id, text, source); its needles, texts that a right
passage holds, are the first stretches of what it asks. OUT/hits gets a row for each hit with the question's verdict,
partitioned by that (all, some or none of the needles found); a question without hits has one row without a
hit. OUT/log gets the run's counts as JSON. Both are overwritten whole, so that a rerun on the same tables gives the same output.

Documents shorter than ``row_chars`` stand for table rows. Null texts count as empty; rows with a null or repeated id are
told apart by nothing, so the bank's and the documents' ids must be unique: others are refused.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import evaluation, retrieval
from lodestone.sources.scratch import kept

from .common import command

log = logging.getLogger("evaluate_bank")
HITS = "qid long, rank long, chunk_id long, doc string, similarity double, bm25 double, rrf double, needles long, first_rank long, verdict string"


@dataclass(frozen=True)
class Config:
    top_k: int = 8
    needle_chars: int = 40
    needles: int = 2
    row_chars: int = 600
    rerank: bool = False


def _unique(table: DataFrame, key: str, what: str) -> int:
    """How many rows there are; an error if ids are null or repeated."""
    n, bad = table.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count_if((F.col("n") > 1) | F.col(key).isNull()).alias("bad")).first()
    if bad:
        raise ValueError(f"{bad} ids of {what} are null or repeated")
    return n or 0


def needles_of(questions: DataFrame, config: Config) -> DataFrame:
    """(qid, needle): the first stretches of each question's text, in lower case; none that are blank."""
    n = config.needle_chars
    cut = F.transform(F.sequence(F.lit(0), F.lit(config.needles - 1)), lambda i: F.lower(F.trim(F.substring(F.col("question"), i * n + 1, F.lit(n)))))
    return questions.select("qid", F.explode(F.array_distinct(cut)).alias("needle")).where("needle <> ''")


def judged_hits(questions: DataFrame, chunks: DataFrame, config: Config = Config()) -> DataFrame:
    """A row for each question and hit with the question's verdict."""
    settings = Settings(top_k=config.top_k, use_reranker=config.rerank)
    texts = chunks.select("chunk_id", "text")
    found = retrieval.search(questions, chunks, settings).select("qid", "rank", "chunk_id", "doc", "similarity", "bm25", "rrf")
    needles = needles_of(questions, config)
    # Written, since hits and verdicts both read it, so that the documents are read once.
    hits = kept(evaluation.needle_hits(found.join(retrieval.of_found(texts, found), "chunk_id").select("qid", "rank", "text"), needles), "needle_hits")
    per_hit = hits.groupBy("qid", "rank").agg(F.count("*").alias("needles"))
    verdict = F.when(F.col("all_hit"), "all").when(F.col("any_hit"), "some").otherwise("none")
    judged = evaluation.judged(needles, hits).select("qid", F.col("first_rank").cast("long").alias("first_rank"), verdict.alias("verdict"))
    rows = questions.select("qid").join(found, "qid", "left").join(per_hit, ["qid", "rank"], "left").join(judged, "qid", "left")
    return rows.select("qid", "rank", "chunk_id", "doc", "similarity", "bm25", "rrf", F.coalesce("needles", F.lit(0)).cast("long").alias("needles"), "first_rank", F.coalesce("verdict", F.lit("none")).alias("verdict"))


def run(spark: SparkSession, documents: str, bank: str, out: str, config: Config = Config()) -> dict:
    """Judge the whole bank over all documents; returns the counts that are logged."""
    text = F.coalesce("text", F.lit(""))
    table = spark.read.parquet(documents)
    chunks = table.select(F.col("doc_id").cast("long").alias("chunk_id"), F.col("source").alias("doc"), text.alias("text"), (F.length(text) < config.row_chars).alias("is_row"), F.lit("").alias("fiscal_period"), F.lit("").alias("statement_type"))
    questions = spark.read.parquet(bank).select(F.col("item_id").cast("long").alias("qid"), text.alias("question"))
    read = {"documents": _unique(chunks, "chunk_id", documents), "questions": _unique(questions, "qid", bank)}
    log.info("read %d documents of %s and %d questions of %s", read["documents"], documents, read["questions"], bank)
    judged_hits(questions, chunks, config).repartition("verdict").write.mode("overwrite").partitionBy("verdict").parquet(f"{out}/hits")
    rows = output(spark, out)
    wrote = rows.agg(F.count("rank").alias("hits"), F.countDistinct(F.when(F.col("verdict") != "none", F.col("qid"))).alias("passed"), F.countDistinct(F.when(F.col("verdict") == "all", F.col("qid"))).alias("complete")).first().asDict()
    spark.createDataFrame([tuple({**read, **wrote}.values())], ", ".join(f"{k} long" for k in {**read, **wrote})).coalesce(1).write.mode("overwrite").json(f"{out}/log")
    log.info("wrote %d hits to %s; of %d questions %d pass, %d with all their needles", wrote["hits"], out, read["questions"], wrote["passed"], wrote["complete"])
    return {**read, **wrote}


def output(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(HITS).parquet(f"{out}/hits")


if __name__ == "__main__":
    sys.exit(command("evaluate_bank", ["documents", "bank", "out"], Config, run))
