"""Serving by batches: the order in which requests are decided, stored answers, errors, and what a server would report.

There is no HTTP server here; each of its parts is a function over DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..sources import index
from ..sources.scratch import kept
from . import admission, answers, evaluation, pages, retrieval

# --- Errors -----------------------------------------------------------------------------------------------------------------

#: Kinds of failure with the status that a client gets and a text that is safe to show.
ERRORS: dict[str, tuple[int, str]] = {
    "rate limit": (429, "The language model is busy or its quota is used up; ask again later."),
    "quota": (429, "The share of live questions is used up; ask again later."),
    "no key": (503, "The server has no key for a language model."),
    "no index": (503, "The passages have not been indexed yet."),
    "bad model": (503, "The language model that the server is set to is not available to it."),
    "rejected": (502, "The language model's provider did not accept the server's key."),
    "unavailable": (502, "The language model can't be reached at the moment."),
    "failed": (502, "The language model gave no answer."),
    "unknown document": (404, "There is no such document."),
    "bad request": (422, "The request can't be read."),
}


def status(kind: Column) -> Column:
    """HTTP status of a kind of failure; 502 for one that isn't known, null for none."""
    pairs = [F.lit(x) for k, (code, _) in ERRORS.items() for x in (k, code)]
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(502)))


def message(kind: Column) -> Column:
    pairs = [F.lit(x) for k, (_, said) in ERRORS.items() for x in (k, said)]
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(ERRORS["failed"][1])))


def translated(error: Exception, secret: str = "") -> dict:
    """kind, retry_after and a detail for the log, without the secret, of what a model's client raised.

    Clients differ; status codes and the usual class names tell what happened.
    """
    code = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    name = type(error).__name__.lower()
    kind = "failed"
    if code == 429 or "ratelimit" in name:
        kind = "rate limit"
    elif code in (401, 403) or "authentication" in name or "permission" in name:
        kind = "rejected"
    elif code == 404 or "notfound" in name:
        kind = "bad model"
    elif code and code >= 500 or any(x in name for x in ("timeout", "connection", "internalserver")):
        kind = "unavailable"
    elif "config" in name:
        kind = "no key"
    headers = getattr(getattr(error, "response", None), "headers", None) or {}
    try:
        wait = int(float(headers.get("retry-after", ""))) if kind == "rate limit" else None
    except ValueError:
        wait = None
    detail = f"{type(error).__name__}: {error}"
    return {"kind": kind, "retry_after": wait, "detail": detail.replace(secret, "***") if secret else detail}


def guarded(generate: Callable[[pd.Series], pd.Series], secret: str = "") -> Callable[[pd.Series], pd.Series]:
    """A generator whose failures become a line that ``failure`` reads, so that one bad call costs no batch.

    A batch is given to ``generate`` whole; one that fails is halved until the prompts that fail stand alone, so that
    prompts beside a bad one are asked again.
    """

    def run(prompts: pd.Series) -> pd.Series:
        if prompts.empty:
            return prompts.astype(object)
        try:
            said = generate(prompts)
            return pd.Series(list(said), index=prompts.index, dtype=object)
        except Exception as e:  # noqa: BLE001  whatever a client raises is that question's error
            if len(prompts) == 1:
                return pd.Series([FAILED + translated(e, secret)["kind"]], index=prompts.index, dtype=object)
        half = len(prompts) // 2
        return pd.concat([run(prompts.iloc[:half]), run(prompts.iloc[half:])])

    return run


FAILED = "\x00failed:"


def failure(raw: Column) -> Column:
    """The kind of failure that a guarded generator returned, else null."""
    return F.when(F.startswith(raw, F.lit(FAILED)), F.substring(raw, len(FAILED) + 1, 100))


def has_key(key: str | None, placeholder: str = "your_") -> bool:
    """Whether a model's key is set: not blank, and not the example's."""
    return bool(key and key.strip()) and placeholder not in key


def described(detail: object, code: int) -> str:
    """A line for a reader from the detail of a failed response: a text, a list of faults, or nothing but a status."""
    if isinstance(detail, str) and detail.strip():
        return detail.strip()
    if isinstance(detail, list):
        faults = [str(x.get("msg", "")) if isinstance(x, Mapping) else str(x) for x in detail]
        if any(faults):
            return "; ".join(x for x in faults if x)
    return f"The request failed with status {code}."


# --- Requests ---------------------------------------------------------------------------------------------------------------


def preset_matches(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """Requests (question, doc, …) with ``preset``: the id of the preset (preset, question) of the same question, if all documents are asked."""
    key = T.question_key(F.col("question"))
    known = presets.groupBy(key.alias("_key")).agg(F.min("preset").alias("preset"))
    joined = requests.withColumn("_key", key).join(known, "_key", "left").drop("_key")
    return joined.withColumn("preset", F.when(F.col("doc").isNull(), F.col("preset"))) if "doc" in requests.columns else joined


def unknown_documents(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct documents (doc) that are asked for but not there."""
    return asked.select("doc").where("doc is not null").distinct().join(known.select("doc").distinct(), "doc", "left_anti")


def decided(requests: DataFrame, presets: DataFrame, documents: DataFrame, settings: Settings = Settings(), per_key: int = 15, key_window: float = 3600.0, overall: int = 800, overall_window: float = 86400.0, slices: int | None = None) -> DataFrame:
    """(event_id, outcome, status, retry_after) of a log of requests.

    ``requests`` has key (the client), event_id, at, question, doc, and what the pipeline would say: passed (the first gate)
    and refused; ``generation`` of the index counts if it is there. In order: the rate limit, presets, unknown documents (where
    there are any documents), the cache, the first gate, the quota (only calls of the model are charged), then the answer, which is kept
    unless it is a refusal. Cache and quotas are those of all clients and are walked together, in the order of times, since each depends on the other.
    """
    limited = admission.limited(requests, settings.rate_limit_per_minute, 60.0, slices).select("event_id", "admitted", F.col("retry_after").alias("rate_wait"))
    unknown = unknown_documents(requests, documents).withColumn("unknown", F.lit(not documents.isEmpty()))
    rows = preset_matches(requests, presets).join(limited, "event_id").join(unknown, "doc", "left").withColumn("unknown", F.coalesce("unknown", F.lit(False)))
    version = F.col("generation").cast("string") if "generation" in requests.columns else F.lit("")
    rows = rows.withColumn("name", F.concat_ws("\x1f", T.question_key(F.col("question")), F.coalesce("doc", F.lit("\x00")), version))
    rows = kept(rows.withColumn("open", F.col("admitted") & F.col("preset").isNull() & ~F.col("unknown")), "requests")
    walked = admission.served(rows.where("open"), settings.cache_size, per_key, key_window, overall, overall_window, slices).withColumnRenamed("retry_after", "quota_wait")
    verdict = F.when(F.col("verdict").isin("overall", "key"), "quota").otherwise(F.col("verdict"))
    outcome = F.when(~F.col("admitted"), "rate limit").when(F.col("preset").isNotNull(), "preset").when(F.col("unknown"), "unknown document").otherwise(verdict)
    bad = F.when(F.col("outcome").isin("rate limit", "unknown document", "quota"), F.col("outcome"))
    wait = F.when(F.col("outcome") == "rate limit", F.col("rate_wait")).when(F.col("outcome") == "quota", F.col("quota_wait"))
    return rows.join(walked, "event_id", "left").withColumn("outcome", outcome).select("event_id", "outcome", F.coalesce(status(bad), F.lit(200)).alias("status"), wait.alias("retry_after"))


# --- Stored answers and results ---------------------------------------------------------------------------------------------


def build_presets(presets: DataFrame, chunks: DataFrame, path: str, settings: Settings = Settings(), generate: Callable = answers.extractive) -> DataFrame:
    """Answer every preset (preset, question) from ``chunks`` and write the answers with the passages' fingerprint; returns what was written."""
    asked = presets.withColumn("qid", F.xxhash64("preset"))
    found = retrieval.search(asked, chunks, settings).select("qid", "chunk_id", "similarity", "bm25", "rrf", "vec_rank", "bm25_rank", "rank")
    facts = chunks.select("chunk_id", "doc", "page", "text", "chunk_type", "chunk_index", "doc_label")
    said = answers.ask(found.join(facts, "chunk_id"), asked, settings, generate).join(asked.select("qid", "preset"), "qid").drop("qid")
    print_ = index.fingerprint(facts).first()
    said.withColumns({"fingerprint": F.lit(print_["fingerprint"]), "chunks": F.lit(print_["n"]), "built_at": F.current_timestamp()}).write.mode("overwrite").json(path)
    return chunks.sparkSession.read.json(path)


def load_presets(spark: SparkSession, path: str, chunks: DataFrame | None = None) -> DataFrame | None:
    """The answers that were written, or None where there are none or they were made from other passages."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.json(path)
        if "preset" not in found.columns:
            return None
    except AnalysisException:
        return None
    if chunks is not None:
        now = index.fingerprint(chunks.select("chunk_id", "doc", "page", "text", "chunk_type", "chunk_index", "doc_label")).first()["fingerprint"]
        if found.where(F.col("fingerprint") != now).limit(1).count():
            return None
    return found


def load_evals(spark: SparkSession, path: str) -> DataFrame | None:
    """The evaluation summary, one JSON object with nested tables, as one row; None where there is none or it has no headline."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.option("multiLine", True).json(path)
    except AnalysisException:
        return None
    return found if "headline" in found.columns else None


def save_results(results: DataFrame, path: str) -> dict:
    """Write a batch's results (with verdict and skipped) as JSON; returns the counts by verdict."""
    results.write.mode("overwrite").json(path)
    return evaluation.verdicts(results.sparkSession.read.schema(results.schema).json(path)).first().asDict()


def judged_answers(said: DataFrame, expected: DataFrame) -> DataFrame:
    """Answers (qid, answer, refused) with ``verdict`` against (qid, expected: answer or decline, must: texts that an answer holds)."""
    plain = T.answer_key(F.coalesce("answer", F.lit("")))
    right = F.forall(F.coalesce("must", F.array().cast("array<string>")), lambda m: F.contains(plain, T.answer_key(m)))
    joined = expected.join(said, "qid", "left")
    got = F.when(F.col("refused"), "decline").otherwise("answer")
    verdict = F.when((got == F.col("expected")) & ((got == "decline") | right), "PASS").when((got == "answer") & (F.col("expected") == "answer"), "WRONG").otherwise("FAIL")
    return joined.withColumn("skipped", F.col("refused").isNull()).withColumn("verdict", F.when(~F.col("skipped"), verdict))


def health(spark: SparkSession, folder: str, key: str | None = None) -> dict:
    """Whether passages are indexed, how many, and whether a model's key is set."""
    n = index.size(spark, folder)
    return {"status": "ok" if n else "no index", "indexed_chunks": n, "model": has_key(key)}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each indexed document."""
    return pages.documents(index.load(spark, folder))


def respond(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), generate: Callable = answers.extractive, embed: retrieval.Embed | None = None) -> DataFrame:
    """(qid, answer, refused, top_similarity, sources) for questions, from search to citations. ``chunks`` may be a stored index."""
    found = retrieval.search(questions, chunks, settings, embed=embed)
    facts = chunks.select("chunk_id", "page", "text", "chunk_type", "chunk_index", "doc_label")
    return answers.ask(found.join(facts, "chunk_id"), questions, settings, generate)
