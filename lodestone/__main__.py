"""Commands: index a folder, ask, run a batch of questions, measure retrieval.

    python -m lodestone ingest FOLDER INDEX [--pattern *.txt] [--stats]
    python -m lodestone ask INDEX QUESTION [--doc NAME] [--k N] [--no-hybrid] [--full]
    python -m lodestone presets INDEX PRESETS.json ANSWERS    rows of preset, question
    python -m lodestone batch INDEX QUESTIONS.json RESULTS     rows of qid, question, expected, must
    python -m lodestone harness INDEX QUESTIONS.json [--rerank]    rows of qid, question, needles, decline

Files are read as text with form feeds between pages; parsers for other kinds are plugged in by calling ``sources.pages.corpus``.
"""

from __future__ import annotations

import argparse
import dataclasses
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .operators import evaluation, pages, retrieval, serving
from .sources import index
from .sources import pages as page_sources


def ingest(spark: SparkSession, folder: str, target: str, pattern: str = "*.txt", stats: bool = False, settings: Settings = Settings()) -> int:
    """Index the folder's files, or show the passages' sizes only; returns 0, or 1 if there is nothing to index."""
    try:
        found = page_sources.corpus(spark, folder, page_sources.plain_text, pattern=pattern, settings=settings)
    except (FileNotFoundError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1
    pages.pages_per_document(found).orderBy("doc").show(1000, truncate=False)
    chunks = pages.chunks(pages.tagged(found), settings)
    pages.token_stats(chunks).show()
    if not stats:
        keyed = chunks.withColumn("chunk_id", F.conv(F.substring(F.md5("id"), 1, 15), 16, 10).cast("long")).withColumn("is_row", F.col("chunk_type") == "row")
        print(index.save(retrieval.indexed(keyed), target), "passages indexed")
    return 0


def ask(spark: SparkSession, folder: str, question: str, doc: str | None = None, full: bool = False, settings: Settings = Settings()) -> int:
    """Print the answer and its sources; with ``full`` their texts as well."""
    chunks = index.load(spark, folder)
    asked = spark.createDataFrame([(1, question, doc)], "qid long, question string, doc string")
    for r in serving.respond(asked, chunks, settings).collect():
        print(r["answer"])
        for s in r["sources"] or []:
            print(f"- {s['doc']}, page {s['page']} ({s['similarity']:.2f})")
            if full:
                print(s["snippet"])
    return 0


def presets(spark: SparkSession, folder: str, asked: str, target: str, settings: Settings = Settings()) -> int:
    """Answer the presets ahead and keep the answers."""
    found = serving.build_presets(spark.read.schema("preset string, question string").json(asked), index.load(spark, folder), target, settings)
    print(found.count(), "presets answered")
    return 0


def batch(spark: SparkSession, folder: str, questions: str, target: str, settings: Settings = Settings()) -> int:
    asked = spark.read.schema("qid long, question string, expected string, must array<string>").json(questions)
    said = serving.respond(asked.select("qid", "question"), index.load(spark, folder), settings)
    print(serving.save_results(serving.judged_answers(said, asked), target))
    return 0


def harness(spark: SparkSession, folder: str, questions: str, rerank: bool = False, settings: Settings = Settings()) -> int:
    """Share of questions whose needles are found; questions to be declined are listed by their best similarity, not counted."""
    settings = dataclasses.replace(settings, use_reranker=rerank)
    asked = spark.read.schema("qid long, question string, needles array<string>, decline boolean").json(questions)
    chunks = index.load(spark, folder)
    found = retrieval.search(asked.select("qid", "question"), chunks, settings)
    texts = found.select("qid", "chunk_id", "rank", "similarity").join(chunks.select("chunk_id", "text"), "chunk_id")
    needles = asked.select("qid", F.explode("needles").alias("needle"))
    judged = evaluation.judged(needles, evaluation.needle_hits(texts, needles)).join(asked.select("qid", "decline"), "qid")
    judged.orderBy("qid").show(1000)
    texts.join(asked.where("decline"), "qid").groupBy("qid").agg(F.max("similarity").alias("top_similarity")).show()
    evaluation.recall(judged).show()
    return 0


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="lodestone")
    kinds = top.add_subparsers(dest="command", required=True)
    for name, places in (("ingest", ["folder", "index"]), ("ask", ["index", "question"]), ("batch", ["index", "questions", "results"]), ("harness", ["index", "questions"]), ("presets", ["index", "asked", "answers"])):
        one = kinds.add_parser(name)
        for p in places:
            one.add_argument(p)
    kinds.choices["ingest"].add_argument("--pattern", default="*.txt")
    kinds.choices["ingest"].add_argument("--stats", action="store_true")
    kinds.choices["ask"].add_argument("--doc")
    kinds.choices["ask"].add_argument("--k", type=int)
    kinds.choices["ask"].add_argument("--no-hybrid", action="store_true")
    kinds.choices["ask"].add_argument("--full", action="store_true")
    kinds.choices["harness"].add_argument("--rerank", action="store_true")
    a = top.parse_args(args)
    spark, settings = SparkSession.builder.getOrCreate(), Settings.from_env()
    if a.command == "ingest":
        return ingest(spark, a.folder, a.index, a.pattern, a.stats, settings)
    if a.command == "ask":
        settings = dataclasses.replace(settings, top_k=a.k or settings.top_k, use_hybrid=settings.use_hybrid and not a.no_hybrid)
        return ask(spark, a.index, a.question, a.doc, a.full, settings)
    if a.command == "presets":
        return presets(spark, a.index, a.asked, a.answers, settings)
    if a.command == "batch":
        return batch(spark, a.index, a.questions, a.results, settings)
    return harness(spark, a.index, a.questions, a.rerank, settings)


if __name__ == "__main__":
    sys.exit(main())
