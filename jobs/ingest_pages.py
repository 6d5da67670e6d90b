"""Take new crawled pages into a table of passages, once each.

    python -m jobs.ingest_pages PAGES OUT CHECKPOINT [--config jobs/ingest_pages.json]

A stream over the Parquet files of PAGES (page_id, url, html) takes what its checkpoint hasn't seen and then ends. Each
batch of new files becomes passages of at most ``piece_words`` words, written to OUT/passages/batch=N, by language.
A batch that is run again, after a failure between writing and committing, overwrites its own folder, so that a
rerun gives the same rows. Nothing that is already there is read or rewritten: the work grows with what is new.

A url that is crawled again gets passages of its new version beside the old ones; ``current`` reads the newest version of
each (greatest page_id, then latest batch). A page without text has one row of no words, which takes its older
versions out. What was read and written is logged for each batch, also as JSON in OUT/log.

Rows without a url are named by their page_id; null html counts as empty; rows that repeat another give its passages once.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.sources import pages as page_sources

from .common import command

PAGES = "page_id long, url string, html string"
PASSAGES = "url string, page_id long, digest string, piece long, words long, text string, source string, batch long, lang string"
UNKNOWN = "und"
log = logging.getLogger("ingest_pages")


@dataclass(frozen=True)
class Config:
    piece_words: int = 350
    languages: tuple[str, ...] = ("de", "en", "es", "fr")  # partitions of the output; others go to ``und``
    files_per_batch: int = 1000


def passages(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Passages of pages, with the language that the page's markup names and where its text comes from."""
    html = F.coalesce("html", F.lit(""))
    named = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang=["']?([a-z]{2,3})\b""", 1))
    read = pages.select(
        F.coalesce("url", F.concat(F.lit("page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).alias("url"), "page_id", F.md5(html).alias("digest"),
        F.when(named.isin(*config.languages), named).otherwise(UNKNOWN).alias("lang"), page_sources.markup_text(html).alias("raw"),
    )
    cut = read.select("url", "page_id", "digest", "lang", page_sources.routed(F.col("raw")).alias("source"), F.posexplode_outer(T.word_pieces(T.cleaned(F.col("raw")), config.piece_words)).alias("piece", "text"))
    text = F.coalesce("text", F.lit(""))
    return cut.select("url", "page_id", "digest", F.coalesce("piece", F.lit(0)).cast("long").alias("piece"), T.word_count(text).alias("words"), text.alias("text"), "source", "lang")


def _only(path: str) -> str:
    """A pattern that matches this path alone: a stream given a pattern takes a single file as well as a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, pages: str, out: str, checkpoint: str, config: Config = Config()) -> dict:
    """Take the pages that are new into OUT; returns how many batches, pages and passages this run took."""
    done = {"batches": 0, "pages": 0, "passages": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        target = f"{out}/passages/batch={number}"
        passages(batch, config).write.mode("overwrite").partitionBy("lang").parquet(target)
        # Counts come from what was written, so that the batch's pages are read once.
        wrote = session.read.schema(PASSAGES).parquet(target).agg(F.count_if(F.col("piece") == 0).alias("pages"), F.count_if(F.col("words") > 0).alias("passages"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"))
        wrote = wrote.select(F.lit(pages).alias("input"), F.lit(number).alias("batch"), "*").first()
        session.createDataFrame([wrote], "input string, batch long, pages long, passages long, words long").coalesce(1).write.mode("overwrite").json(f"{out}/log/batch={number}")
        log.info("batch %d: read %d pages of %s, wrote %d passages to %s", number, wrote["pages"], pages, wrote["passages"], target)
        done["batches"] += 1
        done["pages"] += wrote["pages"]
        done["passages"] += wrote["passages"]

    new = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", config.files_per_batch).parquet(_only(pages))
    new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log.info("%s: %d new pages in %d batches, %d passages", pages, done["pages"], done["batches"], done["passages"])
    return done


def current(spark: SparkSession, out: str) -> DataFrame:
    """Passages of the newest version of each url."""
    rows = spark.read.schema(PASSAGES).parquet(f"{out}/passages")
    version = ["page_id", "batch", "digest"]
    # One row for each version of a page is enough to tell the newest; the passages themselves are dealt by url and version.
    newest = rows.where("piece = 0").groupBy("url").agg(F.max(F.struct(*version)).alias("v")).select("url", *(F.col("v")[c].alias(c) for c in version))
    same = rows.alias("r").join(newest.alias("n"), (F.col("r.url") == F.col("n.url")) & (F.col("r.batch") == F.col("n.batch")) & (F.col("r.digest") == F.col("n.digest")) & F.col("r.page_id").eqNullSafe(F.col("n.page_id")), "left_semi")
    return same.dropDuplicates(["url", "piece"]).select("url", "page_id", "lang", "source", "piece", "words", "text")


if __name__ == "__main__":
    sys.exit(command("ingest_pages", ["pages", "out", "checkpoint"], Config, run))
