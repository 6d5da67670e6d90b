"""Page sources: web pages, and files whose parser is plugged in."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, ExitStack

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from .scratch import kept

Parser = Callable[[str, bytes], Iterator[tuple[int, str]]]
#: Opens a file for recognition; the session gives the text of a page by its number.
Recogniser = Callable[[str, bytes], AbstractContextManager[Callable[[int], str]]]
log = logging.getLogger(__name__)


def routed(raw: Column, least: int = 50) -> Column:
    """Where a page's text comes from: its text layer, or recognition where that is nearly empty."""
    return F.when(F.length(F.trim(F.coalesce(raw, F.lit("")))) < least, "ocr").otherwise("text-layer")


#: Character references by name that pages often hold; others stay as they are, numbers are all read.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "copy": "©", "reg": "®", "euro": "€", "pound": "£", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·"}


def unescaped(text: Column) -> Column:
    """Character references as characters, by number and by the names of ``NAMED``; each is read once."""
    char = lambda code: F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    def one(part: Column) -> Column:  # a stretch that begins with a reference, or the text before the first
        number = F.regexp_extract(part, r"^&#(\d{1,7});", 1)
        digits = F.regexp_extract(part, r"^&#[xX]([0-9a-fA-F]{1,6});", 1)
        code = F.when(number != "", number.try_cast("long")).when(digits != "", F.conv(digits, 16, 10).try_cast("long"))
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        named = F.try_element_at(F.create_map(*(F.lit(x) for kv in {**NAMED, "amp": "&"}.items() for x in kv)), F.regexp_extract(part, r"^&([A-Za-z]+);", 1))
        rest = F.regexp_replace(part, r"^&[^;]*;", "")
        return F.when(good, F.concat(char(code), rest)).when(named.isNotNull(), F.concat(named, rest)).otherwise(part)

    return F.array_join(F.transform(F.split(text, r"(?=&#?\w{1,8};)"), one), "")


def markup_text(html: Column) -> Column:
    """Text of a web page without scripts, styles and tags; block ends become line ends."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "head"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|h[1-6]|li|ul|ol|br|article|nav|footer|table|tr)\b[^>]*>", "\n")
    return unescaped(F.regexp_replace(t, r"<[^>]*>", ""))


def from_html(pages: DataFrame) -> DataFrame:
    """(doc, page, text, source) of web pages; pages without text go, numbers stay."""
    text = T.cleaned(markup_text(F.col("html")))
    return pages.select(F.col("url").alias("doc"), F.col("page_id").alias("page"), text.alias("text"), F.lit("text-layer").alias("source")).where(F.length("text") > 0)


def from_files(spark: SparkSession, folder: str, parse: Parser, recognise: Recogniser | None = None, pattern: str = "*.pdf", settings: Settings = Settings()) -> DataFrame:
    """(doc, page, text, source, error) of files that ``parse`` takes apart page by page.

    A file that fails gives one row with its error and no page. ``recognise`` opens a session for a file whose
    text layer is nearly empty on some page, and is asked for those pages only; the session is closed whatever happens.
    """

    def texts(name: str, content: bytes) -> list[tuple]:
        with ExitStack() as session:
            read, rows = None, []
            for n, t in parse(name, content):
                poor = len(t.strip()) < settings.ocr_threshold
                if poor and recognise:
                    read = read or session.enter_context(recognise(name, content))
                    t = read(n)
                rows.append((name, n, t, "ocr" if poor else "text-layer", None))
            return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows += texts(name, bytes(content))
                except Exception as e:  # noqa: BLE001  whatever a parser raises is that file's error
                    rows.append((name, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc", "page", "raw", "source", "error"]).astype({"page": "Int64"})

    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    out = read.mapInPandas(run, "doc string, page long, raw string, source string, error string")
    return out.withColumn("text", T.cleaned(F.col("raw"))).where("error is not null or length(text) > 0").select("doc", "page", "text", "source", "error")


def corpus(spark: SparkSession, folder: str, parse: Parser, recognise: Recogniser | None = None, pattern: str = "*.pdf", settings: Settings = Settings()) -> DataFrame:
    """The pages of a folder's files, written once, without files that failed; an error if there are no files or no page has text."""
    if spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    every = kept(from_files(spark, folder, parse, recognise, pattern, settings), "pages")
    for r in every.where("error is not null").select("doc", "error").limit(20).collect():
        log.warning("%s is left out: %s", r["doc"], r["error"])
    found = every.where("error is null").drop("error")
    if found.isEmpty():
        raise RuntimeError(f"no text in the files of {folder}")
    return found


def plain_text(name: str, content: bytes) -> Iterator[tuple[int, str]]:
    """Parser of text files whose pages are parted by form feeds."""
    return enumerate(content.decode("utf-8", "replace").split("\x0c"), 1)
