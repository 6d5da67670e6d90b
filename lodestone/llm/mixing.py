"""Mixing sources to target weights.

Sources, sorted by code point with the null source last, weigh 1, 2, 3 and so on
again. They share all words by weight; a target stops at three times its source's
words, and what is over is shared again by weight. That ends at one level for all
sources below their limit: a source gets the lesser of its limit and its weight
times the level. Each document is then taken floor(rate) times, and once more if
a number drawn from its id's hash lies below the rest of the rate.

Everything is DataFrame functions. The table of sources holds one row for each
source; words are summed before the shuffle, so that a source with most of the
rows is no burden.

Defined results: a null text has no words; a null source is a source of its own;
a null doc_id draws as the empty string; equal rows get equal rows; an empty table
gives an empty table. ``mixed`` ignores further columns, ``repeated`` keeps them.
A source without words has target 0 and its documents are not taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused, written

WEIGHTS = (1, 2, 3)
MOST = 3  # times a source's words
#: Up to so many sources their table is broadcast; beyond, it is joined by key, where Spark splits a source with most of the rows.
BROADCAST = 20_000
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target, rate from rows of source and size."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1)).cast("double"))
    # Sources in the order in which a rising level meets their limits: those before a source stand at theirs.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    per = per.withColumn("level", level).withColumn("under", F.col("weight") * F.col("level") <= MOST * F.col("source_size"))
    per = per.withColumn("final", F.max(F.when(F.col("under"), F.col("level"))).over(Window.partitionBy()))
    target = F.least(MOST * F.col("source_size").cast("double"), F.coalesce(F.col("weight") * F.col("final"), MOST * F.col("source_size").cast("double")))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _small_enough(per: DataFrame) -> DataFrame:
    """The written table of sources, to be broadcast if its counted rows are few."""
    per = written(per, "sources")
    return F.broadcast(per) if per.count() <= BROADCAST else per


def draw() -> Column:
    """A number from 0 to 1 that depends on doc_id and the seed only."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _times(rate: Column) -> Column:
    return (F.floor(rate) + (draw() < rate - F.floor(rate)).cast("long")).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, times."""
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words(F.col("text").cast("string")).alias("size"))
    per = _small_enough(targets(sized))
    joined = sized.alias("d").join(per.withColumnRenamed("source", "of"), F.col("d.source").eqNullSafe(F.col("of")))
    times = _times(F.col("rate"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def repeated(docs: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it, with its columns as they are."""
    sized = docs.select("source", words(F.col("text").cast("string")).alias("size"))
    of, rate, copy = (unused(name, docs.columns) for name in ("of", "rate", "copy"))
    per = _small_enough(targets(sized).select(F.col("source").alias(of), F.col("rate").alias(rate)))
    joined = docs.join(per, docs["source"].eqNullSafe(F.col(of)))
    copies = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), _times(F.col(rate)).cast("int"))))
    return copies.select(*docs.columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3) + 1)::DOUBLE AS weight FROM per
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)
), ended AS (
  SELECT *, max(CASE WHEN weight * level <= 3 * source_size THEN level END) OVER () AS final FROM levels
), aimed AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE, coalesce(weight * final, 3 * source_size::DOUBLE)) AS target FROM ended
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate FROM aimed
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target,
    (floor(r.rate) + (CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS times
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * times AS taken, times FROM drawn
"""
