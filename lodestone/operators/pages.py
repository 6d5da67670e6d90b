"""From page texts to tagged passages and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import periods as P
from ..functions import text as T
from ..functions import tokenizers as K

# The phrases by which filings name a period and a table's header.
_ENDED = rf"ended.{{0,4}}({'|'.join(P.MONTHS)})(\d{{1,2}}),?(\d{{4}})"
_PHRASE = r"(?i)(quarter|half[\s-]*year|nine[\s-]*months|year|period)\s*ended"
_PHRASE_SQUASHED = r"(?i)(quarter|halfyear|ninemonths|year|period)ended"


def detected(text: Column) -> tuple[Column, Column]:
    """Statement kind and period that a page's first ten lines name; empty where they don't, null without a results heading."""
    head = F.lower(F.regexp_replace(F.array_join(F.slice(F.split(text, "\n"), 1, 10), " "), r"\s+", ""))
    results = F.contains(head, F.lit("financialresults"))
    kind = F.when(F.contains(head, F.lit("consolidated")), "consolidated").when(F.contains(head, F.lit("standalone")), "standalone").otherwise("")
    part = lambda i: F.regexp_extract(head, _ENDED, i)
    period = F.when(part(1) != "", F.concat(F.initcap(part(1)), F.lit(" "), part(2).cast("int").cast("string"), F.lit(", "), part(3))).otherwise("")
    return F.when(results, kind), F.when(results, period)


def tagged(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text, …) with statement_type, fiscal_period and doc_label.

    The period is the document's most often detected one, the earlier page's on a tie.
    The statement kind is carried from page to page, and back to those before the first.
    """
    kind, period = detected(F.col("text"))
    found = pages.withColumn("_kind", F.nullif(kind, F.lit(""))).withColumn("_period", F.nullif(period, F.lit("")))
    counts = found.where("_period is not null").groupBy("doc", "_period").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    usual = counts.groupBy("doc").agg(F.max_by("_period", F.struct("n", -F.col("first"))).alias("_usual"))
    by_page = Window.partitionBy("doc").orderBy("page")
    before = F.last("_kind", ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("_kind", ignorenulls=True).over(by_page.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = found.join(usual, "doc", "left").withColumn("statement_type", F.coalesce(before, first, F.lit(""))).withColumn("fiscal_period", F.coalesce("_usual", F.lit("")))
    head = F.when(F.col("statement_type") != "", F.concat(F.initcap("statement_type"), F.lit(" Results"))).otherwise("Results")
    label = F.when(F.col("fiscal_period") != "", F.concat(head, F.lit(" — "), F.col("fiscal_period"))).otherwise(head)
    return out.withColumn("doc_label", label).drop("_kind", "_period", "_usual")


def header(text: Column) -> Column:
    """The column header of a period-dated table, or null.

    Lines with a period phrase or a date among the first thirty that aren't blank, up to
    where two others in a row follow such a line; two dates or a phrase are needed.
    """
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " "))), lambda x: x != ""), 1, 30)
    phrase = lambda x: x.rlike(_PHRASE) | F.regexp_replace(x, " ", "").rlike(_PHRASE_SQUASHED)
    dates = lambda x: F.regexp_count(x, F.lit(T.DATE_INSIDE))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("gap"), F.lit(False).alias("done"), F.lit(0).alias("dates"), F.lit(False).alias("phrase"))

    def step(s: Column, x: Column) -> Column:
        hit = (phrase(x) | (dates(x) >= 1)) & ~s["done"]
        gap = F.when(hit, 0).when(F.size(s["kept"]) > 0, s["gap"] + 1).otherwise(0)
        return F.struct(
            F.when(hit, F.concat(s["kept"], F.array(T.one_spaced(x)))).otherwise(s["kept"]).alias("kept"),
            gap.alias("gap"),
            (s["done"] | (gap >= 2)).alias("done"),
            F.when(hit, s["dates"] + dates(x)).otherwise(s["dates"]).alias("dates"),
            (s["phrase"] | (hit & phrase(x))).alias("phrase"),
        )

    def end(s: Column) -> Column:
        return F.when((F.size(s["kept"]) > 0) & ((s["dates"] >= 2) | s["phrase"]), F.array_join(s["kept"], " "))

    return F.aggregate(lines, start, step, end)


def table_rows(pages: DataFrame, key: list[str], least: int = 3, most_words: int = 40) -> DataFrame:
    """(key…, row, label, vals): table rows of each page's text.

    Tokens are numbers, placeholders or words. Between two words lies an island of the
    others: its leading placeholders, if ``least`` or more, are a row without numbers, else part of the
    label; the rest is a row if it has ``least`` numbers, unless all of these are dates, else part of the
    label. A bare number of one or two digits at the end of a longer row, with text after it, begins the
    next label. All of it is windows and aggregates over the token's place.
    """
    toks = F.filter(F.split(T.one_spaced(F.col("text")), " "), lambda t: t != "")
    flat = pages.select(*key, F.posexplode(toks).alias("pos", "tok"))
    kind = F.when(T.is_number(F.col("tok")), "N").when(T.is_placeholder(F.col("tok")), "P").otherwise("W")
    line = Window.partitionBy(*key).orderBy("pos")
    flat = flat.withColumn("kind", kind).withColumn("island", F.count_if(F.col("kind") == "W").over(line)).withColumn("last_pos", F.max("pos").over(Window.partitionBy(*key)))
    # Each island's tokens in order; a word is the first of its group and goes to the label by itself.
    inside = F.col("kind") != "W"
    groups = flat.groupBy(*key, "island").agg(
        F.max(F.when(~inside, F.col("tok"))).alias("word"),
        F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "kind", "tok")))), lambda s: F.struct(s["kind"].alias("kind"), s["tok"].alias("tok"))).alias("seq"),
        F.max("pos").alias("end"),
        F.max("last_pos").alias("last_pos"),
    )
    first_number = F.coalesce(F.array_position(F.transform("seq", lambda s: s["kind"]), "N"), F.lit(0)).cast("int")
    lead = F.when(first_number == 0, F.col("seq")).otherwise(F.slice("seq", 1, first_number - 1))
    rest = F.when(first_number == 0, F.slice("seq", 1, 0)).otherwise(F.slice("seq", first_number, F.size("seq")))
    names = lambda c: F.transform(c, lambda s: s["tok"])
    groups = groups.withColumn("lead", names(lead)).withColumn("rest", names(rest)).withColumn("numbers", F.size(F.filter(rest, lambda s: s["kind"] == "N")))
    cut = (F.col("numbers") >= least) & (F.col("end") < F.col("last_pos")) & (F.size("rest") > least) & F.element_at("rest", -1).rlike(T.ROW_NUMBER)
    groups = groups.withColumn("cut", F.coalesce(F.when(F.size("rest") > 0, cut), F.lit(False)))
    groups = groups.withColumn("run", F.when(F.col("cut"), F.slice("rest", 1, F.size("rest") - 1)).otherwise(F.col("rest")))
    dated = F.forall(F.filter("run", lambda t: T.is_number(t)), lambda t: t.rlike(T.DATE))
    # What each island does, in order: words to the label, perhaps a row, more words, perhaps a row.
    none = F.array().cast("array<string>")
    word = F.when(F.col("word").isNotNull(), F.array("word")).otherwise(none)
    bare = F.size("lead") >= least
    row = F.col("numbers") >= least
    steps = F.array(
        F.struct(F.lit(0).alias("k"), F.when(bare, word).otherwise(F.concat(word, "lead")).alias("words"), F.when(bare, F.col("lead")).alias("vals"), bare.alias("clear")),
        F.struct(F.lit(1).alias("k"), F.when(row, none).otherwise(F.col("rest")).alias("words"), F.when(row & ~dated, F.col("run")).alias("vals"), row.alias("clear")),
        F.struct(F.lit(2).alias("k"), F.when(F.col("cut"), F.array(F.element_at("rest", -1))).otherwise(none).alias("words"), F.lit(None).cast("array<string>").alias("vals"), F.lit(False).alias("clear")),
    )
    done = groups.select(*key, "island", F.explode(steps).alias("s")).select(*key, "island", "s.k", "s.words", "s.vals", "s.clear")
    order = Window.partitionBy(*key).orderBy("island", "k")
    done = done.withColumn("label_no", F.coalesce(F.count_if("clear").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = done.groupBy(*key, "label_no").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("island", "k", "words"))), lambda s: s["words"])).alias("words"),
        F.max("vals").alias("vals"),
    )
    label = F.slice("words", F.greatest(F.size("words") - (most_words - 1), F.lit(1)), most_words)
    kept = rows.where("vals is not null")
    return kept.select(*key, (F.row_number().over(Window.partitionBy(*key).orderBy("label_no")) - 1).cast("long").alias("row"), label.alias("label"), "vals")


def packed(text: Column, most: int = 350, overlap: int = 60, tokenizer: K.Count | None = None, counted: bool = False) -> Column:
    """Blocks packed into passages of at most ``most`` words, each begun with the last passage's tail.

    A block that is too long is cut into pieces; the last piece stays open. With a ``tokenizer``, its tokens count instead of words, and
    with ``counted`` each passage is a struct of text and n_tokens.
    """
    if tokenizer is not None:
        return K.passages(T.blocks(text), most, overlap, tokenizer, counted)
    count = T.word_count
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("out"), F.lit("").alias("cur"))

    def step(s: Column, b: Column) -> Column:
        flushed = F.when(F.trim(s["cur"]) != "", F.concat(s["out"], F.array(F.trim(s["cur"])))).otherwise(s["out"])
        pieces = T.word_pieces(b, most)
        trial = F.when(s["cur"] != "", F.trim(F.concat(s["cur"], F.lit("\n\n"), b))).otherwise(b)
        tail = F.when(F.size(flushed) > 0, T.last_words(F.element_at(flushed, -1), overlap)).otherwise("")
        seeded = F.when(tail != "", F.trim(F.concat(tail, F.lit("\n\n"), b))).otherwise(b)
        large, full = count(b) > most, count(trial) > most
        return F.struct(
            F.when(large, F.concat(flushed, F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))))).when(full, flushed).otherwise(s["out"]).alias("out"),
            F.when(large, F.element_at(pieces, -1)).when(full, seeded).otherwise(trial).alias("cur"),
        )

    return F.aggregate(T.blocks(text), start, step, lambda s: F.when(F.trim(s["cur"]) != "", F.concat(s["out"], F.array(F.trim(s["cur"])))).otherwise(s["out"]))


def chunks(pages: DataFrame, settings: Settings = Settings(), tokenizer: K.Count | None = None) -> DataFrame:
    """Passages and table rows of tagged pages: id, doc, page, text, metadata, chunk_type, chunk_index.

    Passages are measured in words, or in the tokens of ``tokenizer``, such as the embedding model's.
    """
    with_header = pages.withColumn("_header", header(F.col("text")))
    kept = ["doc", "page", "source", "statement_type", "fiscal_period", "doc_label"]
    label = F.nullif(F.col("doc_label"), F.lit(""))
    bodies = with_header.select(*kept, "_header", F.posexplode(packed(F.col("text"), settings.chunk_max_tokens, settings.chunk_overlap_tokens, tokenizer)).alias("i", "body"))
    lost = F.regexp_count("body", F.lit(T.DATE_INSIDE)) < 2
    whole = bodies.select(*kept, F.concat_ws("::", "doc", F.concat(F.lit("p"), "page"), F.concat(F.lit("c"), "i")).alias("id"), F.concat_ws("\n", label, F.when(lost, F.col("_header")), F.col("body")).alias("text"), F.when(F.col("_header").isNotNull(), "table").otherwise("prose").alias("chunk_type"), F.col("i").cast("long").alias("i"))
    if not settings.row_chunks:
        both = whole
    else:
        rows = table_rows(pages, ["doc", "page"])
        many = rows.withColumn("n", F.count("*").over(Window.partitionBy("doc", "page"))).where("n >= 2")
        joined = many.join(with_header.select(*kept, "_header"), ["doc", "page"])
        columns = P.column_labels(F.col("_header"), F.size("vals"), F.col("fiscal_period"))
        name = F.array_join("label", " ")
        labelled = F.array_join(F.concat(F.array(name), F.zip_with(columns, F.col("vals"), lambda c, v: F.concat(c, F.lit(": "), v))), " | ")
        plain = F.array_join(F.concat("label", "vals"), " ")
        text = F.when(columns.isNotNull(), F.concat_ws("\n", label, labelled)).otherwise(F.concat_ws("\n", label, F.col("_header"), plain))
        both = whole.unionByName(joined.select(*kept, F.concat_ws("::", "doc", F.concat(F.lit("p"), "page"), F.concat(F.lit("r"), "row")).alias("id"), text.alias("text"), F.lit("row").alias("chunk_type"), F.col("row").alias("i")))
    place = Window.partitionBy("doc").orderBy("page", F.col("chunk_type") == "row", "i")
    return both.withColumn("chunk_index", (F.row_number().over(place) - 1).cast("long")).drop("i")


def documents(chunks_: DataFrame) -> DataFrame:
    """One row for each document: first label and period, pages and chunks."""
    return chunks_.groupBy("doc").agg(F.min_by("doc_label", "chunk_index").alias("doc_label"), F.min_by("fiscal_period", "chunk_index").alias("fiscal_period"), F.countDistinct("page").alias("pages"), F.count("*").alias("chunks"))


def pages_per_document(pages: DataFrame) -> DataFrame:
    """(doc, n)."""
    return pages.groupBy("doc").agg(F.count("*").alias("n"))


def token_stats(chunks_: DataFrame, tokenizer: K.Count | None = None) -> DataFrame:
    """One row: least, mean and most words (or tokens of ``tokenizer``) of a passage, the mean rounded down."""
    n = T.word_count(F.col("text"))
    if tokenizer is not None:  # counted before it is summed, since Python and JVM aggregates don't mix
        chunks_ = chunks_.select(K.token_count(F.col("text"), tokenizer).alias("n"))
        n = F.col("n")
    return chunks_.agg(F.min(n).alias("least"), F.floor(F.sum(n) / F.count("*")).alias("mean"), F.max(n).alias("most"))


def sorted_documents(chunks_: DataFrame) -> DataFrame:
    """(doc, place) of the documents by name, from 1; there are as many rows as documents."""
    return chunks_.select("doc").distinct().select("doc", F.row_number().over(Window.orderBy("doc")).cast("long").alias("place"))
