"""The shared tables as passages, filings, questions and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages; short ones stand for table rows."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc"), "text", (F.length("text") < 600).alias("is_row"), F.lit("").alias("fiscal_period"), F.lit("").alias("statement_type"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


#: Filings made from orders, for each region and quarter, with five figures in a row: the quarter, the one before, the one a
#: year before, the year so far and the last year so far. The statement is portable SQL.
FILINGS = r"""
WITH base AS (
  SELECT r_name AS doc, year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n, cast(round(sum(o_totalprice)) AS bigint) AS total
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY r_name, year(o_orderdate), quarter(o_orderdate)
), ytd AS (
  SELECT *, y * 4 + q - 1 AS k, cast(sum(n) OVER (PARTITION BY doc, y ORDER BY q) AS bigint) AS n_ytd, cast(sum(total) OVER (PARTITION BY doc, y ORDER BY q) AS bigint) AS total_ytd FROM base
), figures AS (
  SELECT a.doc, a.y, a.q, row_number() OVER (PARTITION BY a.doc ORDER BY a.k) AS page,
    a.n AS n1, coalesce(b.n, 0) AS n2, coalesce(c.n, 0) AS n3, a.n_ytd AS n4, coalesce(c.n_ytd, 0) AS n5,
    a.total AS t1, coalesce(b.total, 0) AS t2, coalesce(c.total, 0) AS t3, a.total_ytd AS t4, coalesce(c.total_ytd, 0) AS t5
  FROM ytd a LEFT JOIN ytd b ON a.doc = b.doc AND b.k = a.k - 1 LEFT JOIN ytd c ON a.doc = c.doc AND c.k = a.k - 4
), dated AS (
  SELECT *,
    CASE q WHEN 1 THEN 'March 31, ' WHEN 2 THEN 'June 30, ' WHEN 3 THEN 'September 30, ' ELSE 'December 31, ' END || cast(y AS string) AS p1,
    CASE q WHEN 1 THEN 'December 31, ' || cast(y - 1 AS string) WHEN 2 THEN 'March 31, ' || cast(y AS string) WHEN 3 THEN 'June 30, ' || cast(y AS string) ELSE 'September 30, ' || cast(y AS string) END AS p2,
    CASE q WHEN 1 THEN 'March 31, ' WHEN 2 THEN 'June 30, ' WHEN 3 THEN 'September 30, ' ELSE 'December 31, ' END || cast(y - 1 AS string) AS p3,
    CASE q WHEN 1 THEN '31.03.' WHEN 2 THEN '30.06.' WHEN 3 THEN '30.09.' ELSE '31.12.' END AS d,
    CASE q WHEN 1 THEN '31.12.' WHEN 2 THEN '31.03.' WHEN 3 THEN '30.06.' ELSE '30.09.' END AS e
  FROM figures
)
"""
FILING_PAGES = FILINGS + r"""
SELECT doc || ' ' || cast(y AS string) || ' Q' || cast(q AS string) AS doc, doc AS issuer, page AS serial, part AS page, p1, p2, p3, n1, n2, n3, n4, n5, t1, t2, t3, t4, t5,
  CASE WHEN part = 2 THEN (CASE WHEN page % 2 = 0 THEN 'STANDALONE' ELSE 'CONSOLIDATED' END) || ' FINANCIAL RESULTS FOR THE QUARTER AND YEAR ENDED ' || upper(p1) || chr(10) ELSE 'Notes of ' || lower(doc) || chr(10) END
  || 'Quarter ended Year ended' || chr(10)
  || 'Particulars ' || d || cast(y AS string) || ' ' || e || cast(CASE WHEN q = 1 THEN y - 1 ELSE y END AS string) || ' ' || d || cast(y - 1 AS string) || ' ' || d || cast(y AS string) || ' ' || d || cast(y - 1 AS string) || chr(10)
  || '1 Orders placed ' || cast(n1 AS string) || ' ' || cast(n2 AS string) || ' ' || cast(n3 AS string) || ' ' || cast(n4 AS string) || ' ' || cast(n5 AS string) || chr(10)
  || '2 Total price ' || cast(t1 AS string) || ' ' || cast(t2 AS string) || ' ' || cast(t3 AS string) || ' ' || cast(t4 AS string) || ' ' || cast(t5 AS string) || chr(10)
  || '3 Returned orders nil nil nil nil nil' AS text
FROM dated CROSS JOIN (SELECT 1 AS part UNION ALL SELECT 2 AS part) parts
"""


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages for each filing; the second names the statement kind and period."""
    names = ("orders", "customer", "nation", "region")
    sql = FILING_PAGES
    for name in names:  # the tables are given as frames, so that no view of the session is touched
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names}).withColumn("source", F.lit("text-layer"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "events"))


def as_requests(e: DataFrame) -> DataFrame:
    return e.select(F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for answers: the event's kind and value's whole part are the question."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("user"), "event_id", F.concat_ws(":", "event_type", F.pmod(F.floor(F.coalesce("value", F.lit(0.0))), F.lit(7)).cast("string")).alias("key"))



def traffic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests with what the pipeline would say of them, presets and known documents, for ``serving.decided``; made from the events."""
    e = table(spark, sf_dir, "events")
    whole = F.floor(F.coalesce("value", F.lit(0.0))).cast("long")
    rows = e.select(
        F.col("user_id").alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), F.concat_ws(" ", "event_type", F.pmod(whole, F.lit(50)).cast("string")).alias("question"),
        F.when(F.pmod("event_id", F.lit(5)) == 0, F.concat(F.lit("d"), F.pmod(whole, F.lit(3)).cast("string"))).alias("doc"), (F.pmod(whole, F.lit(11)) != 0).alias("passed"), (F.pmod(whole, F.lit(7)) == 0).alias("refused"),
    )
    presets = e.select("event_type").distinct().select(F.col("event_type").alias("preset"), F.concat_ws(" ", F.upper("event_type"), F.lit(" 4 ")).alias("question"))
    return rows, presets, spark.createDataFrame([("d0",), ("d1",)], "doc string")
