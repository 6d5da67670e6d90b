"""The jobs as queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import registry as R
from lodestone.sources import scratch

from . import evaluate_bank, ingest_pages


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch.folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job1")
    for _ in range(2):
        ingest_pages.run(spark, f"{sf_dir}/pages.parquet", f"{out}/out", f"{out}/checkpoint")
    return ingest_pages.current(spark, f"{out}/out")


def job2_evaluate_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "job2")
    for _ in range(2):
        evaluate_bank.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return evaluate_bank.output(spark, out)


JOB1_SQL = rf"""
WITH newest AS (
  SELECT coalesce(url, 'page:' || coalesce(page_id::VARCHAR, '')) AS url, page_id, coalesce(html, '') AS html FROM pages
  QUALIFY row_number() OVER (PARTITION BY coalesce(url, 'page:' || coalesce(page_id::VARCHAR, '')) ORDER BY page_id DESC NULLS LAST, md5(coalesce(html, '')) DESC) = 1
), marked AS (
  SELECT url, page_id, lower(regexp_extract(html, '<html\b[^>]*\blang=["'']?([a-z]{{2,3}})\b', 1, 'i')) AS named, {R._markup()} AS text FROM newest
), clean AS (
  SELECT url, page_id, CASE WHEN named IN ('de', 'en', 'es', 'fr') THEN named ELSE 'und' END AS lang, CASE WHEN length(trim(text)) < 50 THEN 'ocr' ELSE 'text-layer' END AS source, {R.CLEAN} AS text FROM marked
), listed AS (
  SELECT url, page_id, lang, source, {R.WORDS} AS w FROM clean
), cut AS (
  SELECT *, unnest(range(0, greatest(len(w), 1), 350)) AS i FROM listed
)
SELECT url, page_id, lang, source, i // 350 AS piece, len(w[i + 1 : i + 350])::BIGINT AS words, array_to_string(w[i + 1 : i + 350], ' ') AS text FROM cut
"""

JOB2_SQL = R.SEARCH + R._NEEDLES + r""", per_hit AS (SELECT qid, rank, count(*) AS needles FROM hits GROUP BY ALL)
SELECT q.qid, b.rank, b.chunk_id, b.doc, b.similarity, b.bm25, b.rrf, coalesce(p.needles, 0) AS needles, j.first_rank, CASE WHEN all_hit THEN 'all' WHEN any_hit THEN 'some' ELSE 'none' END AS verdict
FROM questions q LEFT JOIN best b ON b.qid = q.qid LEFT JOIN per_hit p ON p.qid = q.qid AND p.rank = b.rank LEFT JOIN judged j ON j.qid = q.qid
"""

QUERIES = {f.__name__: f for f in (job1_ingest_pages, job2_evaluate_bank)}
ORACLES = {"job1_ingest_pages": JOB1_SQL, "job2_evaluate_bank": JOB2_SQL}
