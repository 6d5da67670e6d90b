"""Resampling documents towards a target distribution by the importance of their word runs.

Features are runs of one to ``longest`` words. A shard of texts (some megabytes) gets a dictionary
that maps its distinct words to integers; runs are tuples of these, numbered level by level as (number of
the run without its last word, last word). The bytes of each distinct tuple are put together and hashed once, and
the tuple's bucket is joined back to all its occurrences by its number. Dictionaries are of shards, not
of the corpus: a word's bucket needs no other shard, so that only counts by bucket are shuffled, at most ``BUCKETS`` rows
for each task, and memory doesn't grow with the corpus's vocabulary.

The gains are one number for each bucket, bounded by ``BUCKETS``, and go to the tasks that score documents. Ranks are
given without any window over all rows: documents are range-partitioned by score and written with their place within
their part; counts of the parts, at most as many rows as there are partitions, give the rest.

Defined results: a null or empty text has no features, weight 0 and the score of its id's draw; a null doc_id draws as the
empty string and comes last among equals; repeated rows are rows of their own, so that equal ones take
successive ranks; an empty table gives an empty one; an empty target is a target of no words. Further columns are ignored
by ``resampled`` and kept by ``drawn``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import plain_words, shards, unused, written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"


def runs(texts: list[bytes | None], longest: int, buckets: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Number of words of each text, and for each length of a run the row and the bucket of every occurrence."""
    ids: dict[bytes, int] = {}
    number = count()
    parts = []
    for text in texts:
        found = plain_words(text)
        for w in found:
            if w not in ids:
                ids[w] = next(number)
        parts.append(np.fromiter(map(ids.__getitem__, found), np.int64, len(found)))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))

    def levels() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        words, word = list(ids), np.concatenate(parts) if parts else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        start, tuples, made = np.arange(len(word)), word, words
        for n in range(1, longest + 1):
            if n > 1:
                inside = start + n - 1 < len(word)
                inside[inside] = row[start[inside] + n - 1] == row[start[inside]]
                start, tuples = start[inside], tuples[inside]
                distinct, tuples = np.unique(tuples * len(words) + word[start + n - 1], return_inverse=True)
                made = [made[t // len(words)] + b" " + words[t % len(words)] for t in distinct.tolist()]
            hashed = np.fromiter((crc32(x) % buckets for x in made), np.int64, len(made))
            yield row[start], hashed[tuples]

    return sizes, levels()


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of all runs of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in shards(batch.column(0)):
                for _, hashed in runs(texts, longest, buckets)[1]:
                    total += np.bincount(hashed, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row for each bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket 1000 times the logarithm of how much likelier it is in the target, both smoothed by one, rounded down."""
    s, t, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(b + 1) * (s + n) / (float(a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def draw() -> Column:
    """A Gumbel number by the hash of doc_id and the seed, times 1000 and rounded down."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def scored(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, weights: str = "_weights") -> DataFrame:
    """``docs`` with the struct ``weights``: n_words, n_features, weight, score."""
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weighed(column: pa.Array) -> pa.Array:
        words, features, weight = [], [], []
        for texts in shards(column):
            sizes, levels = runs(texts, longest, buckets)
            words.append(sizes)
            weight.append(np.zeros(len(texts), np.int64))
            features.append(np.zeros(len(texts), np.int64))
            for row, hashed in levels:
                # Sums of whole numbers, exact in doubles up to 2 to the 53rd.
                weight[-1] += np.bincount(row, gain[hashed], len(texts)).astype(np.int64)
                features[-1] += np.bincount(row, minlength=len(texts))
        join = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([join(words), join(features), join(weight)], ["n_words", "n_features", "weight"])

    found = docs.withColumn(weights, weighed(F.col("text").cast("binary")))
    return found.withColumn(weights, F.col(weights).withField("score", F.col(weights)["weight"] + draw()))


def ranked(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, able) with ``rank``: 1, 2, … for the best ``percent`` of those that are able, else null."""
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    # Written, since finding the ranges' ends and dealing rows out both read the scores.
    rows = written(rows, "scores")
    # The number of a row in its part, which starts at the part's number times 2 to the 33rd.
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("part").agg(F.count_if("able").alias("n"))
    whole = Window.orderBy("part")
    parts = parts.select("part", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn_ = F.col("able") & (place <= F.floor(F.col("all") * percent / 100))
    return placed.join(F.broadcast(parts), "part").select("doc_id", "n_features", "weight", "score", F.when(drawn_, place).cast("long").alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    w = F.col("_weights")
    rows = scored(plain, target, longest, buckets).select("doc_id", w["n_features"].alias("n_features"), w["weight"].alias("weight"), w["score"].alias("score"), (w["n_words"] >= least).alias("able"))
    return ranked(rows, percent)


def drawn(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The drawn documents with their columns as they are: those down to the last rank's score and id, so that rows that repeat the last one all stay."""
    last = resampled(docs, target, longest, buckets, least, percent).where("rank is not null").agg(F.max_by(F.struct("score", "doc_id"), "rank").alias("last")).first()["last"]
    if last is None:
        return docs.limit(0)
    name = unused("_weights", docs.columns)
    found = scored(docs, target, longest, buckets, name)
    w, score, of = F.col(name), F.lit(last["score"]), F.col("doc_id").cast("long")
    tied = (w["score"] == score) & (F.lit(True) if last["doc_id"] is None else F.coalesce(of <= last["doc_id"], F.lit(False)))
    return found.where((w["n_words"] >= least) & ((w["score"] > score) | tied)).drop(name)


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i))
), d AS (
  SELECT doc_id, {WORDS_SQL} AS w FROM documents
), dw AS (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL
), bw AS (
  SELECT word, count(*) AS n FROM (SELECT unnest({WORDS_SQL}) AS word FROM benchmark) GROUP BY word
), vocabulary AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)
), hashed AS (
  SELECT word, xor(4294967295::BIGINT, list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM vocabulary, crc
), s AS (
  SELECT bucket, sum(n)::DOUBLE AS s FROM dw JOIN hashed USING (word) GROUP BY bucket
), t AS (
  SELECT bucket, sum(n)::DOUBLE AS t FROM bw JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(n), 0)::DOUBLE FROM dw) + 10000) / ((coalesce(s, 0) + 1) * ((SELECT coalesce(sum(n), 0)::DOUBLE FROM bw) + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM hashed) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (doc_id)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= 20 QUALIFY rank <= floor(count(*) OVER () * 10 / 100)
)
SELECT doc_id, n_features, weight, score, rank FROM scores LEFT JOIN places USING (doc_id)
"""
