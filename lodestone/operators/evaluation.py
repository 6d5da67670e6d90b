"""Scores of retrieval and answers."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import kept

#: Bytes of needles that a task holds at once.
BLOCK_BYTES = 8 << 20


def plain(text: Column) -> Column:
    """A text as needles are looked for in it: case and white space don't matter."""
    return F.lower(T.one_spaced(text))


@lru_cache(maxsize=1)
def automaton(needles: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, needle in enumerate(needles):
        made.add_word(needle, i)
    made.make_automaton()
    return made


def corpus_hits(documents: DataFrame, needles: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, needle) of all documents that hold a needle, each once; needles are as ``plain`` makes them, blank ones are none.

    One automaton finds all needles in one reading of a text. Tasks hold a block of needles, whose bytes are summed first; more
    needles than a block takes are looked for block by block.
    """
    some = kept(needles.select(plain(F.col("needle")).alias("needle")).where("needle <> ''").distinct(), "needles")
    blocks = max(1, -(-(some.agg(F.sum(F.octet_length("needle") + 64)).first()[0] or 0) // block_bytes))
    out = None
    for k in range(blocks):
        part = some if blocks == 1 else some.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == k)
        held = documents.sparkSession.sparkContext.broadcast(tuple(sorted(r["needle"] for r in part.toLocalIterator())))
        found = documents.select("doc_id", F.explode(_finder(held)(plain(F.col("text")))).alias("needle"))
        out = found if out is None else out.unionAll(found)
    return out


def _finder(held):
    def find(texts: pa.Array) -> pa.Array:
        made = automaton(held.value) if held.value else None
        return pa.array([sorted({held.value[i] for _, i in made.iter(t)}) if made and t else [] for t in (x.as_py() for x in texts)], pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")


def needle_hits(found: DataFrame, needles: DataFrame) -> DataFrame:
    """(qid, needle, rank) of retrieved texts that hold a question's needle; case and white space don't matter."""
    return found.join(needles, "qid").where(F.contains(plain(F.col("text")), plain(F.col("needle")))).select("qid", "needle", "rank")


def judged(needles: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, any_hit, all_hit, first_rank)."""
    best = hits.groupBy("qid", "needle").agg(F.min("rank").alias("rank"))
    joined = needles.join(best, ["qid", "needle"], "left")
    return joined.groupBy("qid").agg(F.bool_or(F.col("rank").isNotNull()).alias("any_hit"), F.bool_and(F.col("rank").isNotNull()).alias("all_hit"), F.min("rank").alias("first_rank"))


def enough_from(found: DataFrame, documents: list[str], least: int = 1) -> DataFrame:
    """(qid, n, enough): how many of a question's passages come from the documents, and whether ``least`` do."""
    n = F.count_if(F.col("doc").isin(documents))
    return found.groupBy("qid").agg(n.alias("n"), (n >= least).alias("enough"))


def recall(judged_: DataFrame) -> DataFrame:
    """passed, asked and their share; questions to be declined (``decline``) aren't counted."""
    counted = judged_.where(~F.coalesce("decline", F.lit(False))) if "decline" in judged_.columns else judged_
    return counted.agg(F.count_if("any_hit").alias("passed"), F.count("*").alias("asked")).withColumn("recall", F.round(F.col("passed") / F.col("asked"), 6))


def verdicts(results: DataFrame) -> DataFrame:
    """Counts of PASS, WRONG and FAIL among results that weren't skipped."""
    kept = results.where(~F.coalesce("skipped", F.lit(False)))
    return kept.agg(*(F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("PASS", "WRONG", "FAIL")))
