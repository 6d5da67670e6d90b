"""Gates, prompts, answers and citations, for batches of questions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..sources.scratch import kept

REFUSAL = "The documents that were searched don't hold an answer to this question."
INSTRUCTIONS = (
    "Answer from the numbered passages only. Reply with one JSON object: not_covered (true if no passage mentions "
    "what is asked), answer (empty if not covered) and used_passages (the numbers of the passages used)."
)


def parsed(raw: Column) -> Column:
    """The model's JSON object as a variant: the whole text, else from the first brace to the last; null if neither is an object."""
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    whole = F.try_parse_json(F.trim(raw))
    inner = F.try_parse_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))
    return F.when(whole.isNotNull(), F.when(is_object(whole), whole)).when(is_object(inner), inner)


def field(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def kind_of(v: Column, name: str) -> Column:
    return F.schema_of_variant(field(v, name, "variant"))


def flag(v: Column, name: str) -> Column:
    """True for JSON true and the string "true" only."""
    kind = kind_of(v, name)
    return F.coalesce(F.when(kind.isin("BOOLEAN", "STRING"), F.lower(F.trim(field(v, name, "string"))) == "true"), F.lit(False))


def used_passages(v: Column) -> Column:
    """Distinct passage numbers from integers and strings of digits; anything else is ignored."""
    kind = kind_of(v, "used_passages")
    items = F.try_variant_get(v, "$.used_passages", "array<variant>")
    good = F.filter(items, lambda x: F.coalesce((F.schema_of_variant(x) == "BIGINT") | ((F.schema_of_variant(x) == "STRING") & F.try_variant_get(x, "$", "string").rlike(r"^\s*[0-9]+\s*$")), F.lit(False)))
    many = F.transform(good, lambda x: F.trim(F.try_variant_get(x, "$", "string")).try_cast("bigint"))
    one = F.array(field(v, "used_passages", "bigint"))
    none = F.array().cast("array<bigint>")
    return F.array_sort(F.array_distinct(F.when(kind == "BIGINT", one).when(kind.startswith("ARRAY"), F.coalesce(many, none)).otherwise(none)))


def outcome(cached: Column, preset: Column, refused: Column, best: Column, floor: Column) -> Column:
    return F.when(preset.isNotNull(), "preset").when(cached, "cache").when(refused & (best < floor), "gate 1").when(refused, "gate 2").otherwise("live")


def passages(found: DataFrame) -> DataFrame:
    """Retrieved chunks numbered in the order of the documents."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("doc", "chunk_index"))
    return found.withColumn("passage_no", place.cast("long"))


def contexts(numbered: DataFrame) -> DataFrame:
    """(qid, context): a question's passages as one block of text."""
    kind = F.when(F.col("chunk_type") == "row", " (one row of a table; every figure names its column)").when(F.col("chunk_type") == "table", " (a table; figures stand in the order of its heading)").otherwise("")
    label = F.when(F.col("doc_label") != "", F.concat(F.lit(" — "), F.col("doc_label"))).otherwise("")
    block = F.concat(F.lit("["), F.col("passage_no"), F.lit("] "), F.col("doc"), F.lit(", page "), F.col("page"), label, kind, F.lit("\n"), F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("passage_no", block.alias("block")))), lambda s: s["block"]), "\n\n")
    return numbered.groupBy("qid").agg(joined.alias("context"))


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("PASSAGES:\n"), context, F.lit("\n\nQUESTION: "), question)


def extractive(prompts: pd.Series) -> pd.Series:
    """Offline stand-in for a language model: cites the first passage and repeats its first line."""
    import json

    def one(p: str) -> str:
        body = p.partition("PASSAGES:\n")[2].rpartition("\n\nQUESTION: ")[0]
        lines = body.split("\n")
        text = lines[1] if len(lines) > 1 else ""
        return json.dumps({"not_covered": not text.strip(), "answer": text[:200], "used_passages": [1] if text.strip() else []})

    return prompts.map(one)


def with_gate(found: DataFrame, questions: DataFrame, floor: float) -> DataFrame:
    """Questions with top_similarity and whether anything near enough was found."""
    best = found.groupBy("qid").agg(F.max("similarity").alias("top_similarity"))
    out = questions.join(best, "qid", "left").withColumn("top_similarity", F.coalesce("top_similarity", F.lit(0.0)))
    return out.withColumn("passed", (F.col("top_similarity") >= floor) & (F.col("top_similarity").isNotNull()))


def cited(numbered: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, passage_no) of an answer's citations: those it names that exist, else the most similar passage."""
    named = answers.select("qid", F.explode("used").alias("passage_no")).join(numbered.select("qid", "passage_no"), ["qid", "passage_no"])
    best = numbered.groupBy("qid").agg(F.max_by("passage_no", F.struct("similarity", -F.col("rank"))).alias("passage_no"))
    return named.union(answers.select("qid").join(named.select("qid").distinct(), "qid", "left_anti").join(best, "qid").select("qid", "passage_no"))


def ask(found: DataFrame, questions: DataFrame, settings: Settings = Settings(), generate: Callable[[pd.Series], pd.Series] = extractive) -> DataFrame:
    """(qid, answer, refused, top_similarity, sources) for questions and their retrieved chunks.

    Questions that fail the first gate never reach the generator.
    """
    gated = with_gate(found, questions, settings.min_similarity)
    numbered = passages(found)
    open_ = gated.where("passed").join(contexts(numbered), "qid")
    model = F.pandas_udf(generate, "string").asNondeterministic()
    # Written, so that the branches below share one call of the generator for each question.
    called = kept(open_.select("qid", "top_similarity", model(prompt(F.col("context"), F.col("question"))).alias("raw")), "answers")
    raw = called.withColumn("v", parsed(F.col("raw")))
    text = F.trim(F.coalesce(field(F.col("v"), "answer", "string"), F.lit("")))
    read = raw.select("qid", "top_similarity", text.alias("answer"), (F.col("v").isNull() | flag(F.col("v"), "not_covered") | (text == "")).alias("refused"), used_passages(F.col("v")).alias("used"))
    good = read.where(~F.col("refused"))
    links = cited(numbered, good).join(numbered, ["qid", "passage_no"])
    sources = links.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("passage_no", "doc", "page", F.col("text").alias("snippet"), "similarity"))).alias("sources"))
    fields_ = ["qid", "answer", "refused", "top_similarity"]
    answered = good.select(*fields_).join(sources, "qid", "left")
    refused = read.where("refused").select("qid", "top_similarity").union(gated.where("not passed").select("qid", "top_similarity"))
    return answered.unionByName(refused.select("qid", F.lit(REFUSAL).alias("answer"), F.lit(True).alias("refused"), "top_similarity"), allowMissingColumns=True)


def shown(found: DataFrame) -> DataFrame:
    """Retrieved chunks as a response shows them: rounded scores and short texts."""
    return found.select("qid", "chunk_id", F.bround("similarity", 4).alias("cosine"), F.bround("bm25", 3).alias("bm25"), F.bround("rrf", 5).alias("rrf"), "vec_rank", "bm25_rank", T.snippet(F.col("text")).alias("snippet"))


def copied(answer: Column, sources: Column) -> Column:
    """An answer as plain text to paste: itself, then a line for each source."""
    line = lambda x: F.concat(F.lit("- "), x["doc"], F.lit(", page "), x["page"].cast("string"))
    lines = F.array_join(F.transform(sources, line), "\n")
    return F.when(F.size(F.coalesce(sources, F.array())) > 0, F.concat(F.trim(answer), F.lit("\n\nSources:\n"), lines)).otherwise(F.trim(answer))


def cited_flags(numbered: DataFrame, citations: DataFrame) -> DataFrame:
    """Passages with ``cited``: whether an answer names them."""
    marked = citations.select("qid", "passage_no").distinct().withColumn("cited", F.lit(True))
    return numbered.join(marked, ["qid", "passage_no"], "left").withColumn("cited", F.coalesce("cited", F.lit(False)))


def bars(found: DataFrame, least: float = 4.0) -> DataFrame:
    """What was found with ``bar``: its score as a share of the question's best, in percent, ``least`` or more."""
    best = F.max("rrf").over(Window.partitionBy("qid"))
    return found.withColumn("bar", F.round(F.greatest(F.lit(least), F.col("rrf") / best * 100), 4))
