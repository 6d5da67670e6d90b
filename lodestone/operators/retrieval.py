"""Keyword and vector ranking of passages for batches of questions.

``chunks`` has chunk_id, doc, text, is_row, fiscal_period, statement_type and, where rows are to be embedded by
their label words, chunk_type; ``questions`` has qid and question, and doc where it may be answered from that
document only. Corpus statistics always come from all chunks, whatever a question is restricted to.

``indexed`` reads the chunks once: terms with counts, length and vector of each. Its table can be stored
(``sources.index``) and given to every function here in place of the chunks. Questions and chunks
meet in cells, a block of questions and a block of chunks each, so that neither side is ever gathered; the
vectors' best come from each cell's best. Ranks over all candidates of a question need all their scores:
``search`` holds them as arrays in one task, some 30 bytes for each candidate. With ``wide`` no score is moved or written: each task keeps of the chunks
that it reads the few that can be among the best, and counts their ranks in a second reading; questions come to the tasks in blocks. ``ranked_candidates`` ranks a question's scores in one task up to
a number of candidates; beyond, and in ``ranks``, they are ranked in ranges over any number of tasks.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import periods as P
from ..functions import text as T
from ..sources.scratch import kept

DIMENSIONS = 128
#: Chunks and questions of a cell.
CHUNKS, QUESTIONS = 2048, 512
#: Candidates of a question that are ranked as arrays in one task, and rows of a batch that is made of them.
CANDIDATES, SLICE = 4_000_000, 100_000
#: Chunks of an index up to which a search ranks a question's scores in one task, where it isn't told otherwise.
WIDE = 100_000
K1, B, EPSILON = 1.5, 0.75, 0.25
Embed = Callable[[pd.Series], list[np.ndarray]]


#: Bytes of which a lower-cased text's tokens are runs: a-z and 0-9.
_IS_TOKEN = np.array([48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
#: Bytes of texts whose tokens are held at once; a longer text goes by itself.
HELD = 2 << 20
_LISTS = pa.struct([("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64())), ("dl", pa.int64()), ("vector", pa.list_(pa.float64()))])


@lru_cache(maxsize=1 << 16)
def _place(term: bytes) -> int:
    return int.from_bytes(md5(term).digest()[:4], "big") % DIMENSIONS


def _tokens(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-cased texts, as bytes, one after the other, and each one's text."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lowered), 0).to_numpy(zero_copy_only=False))])
    data = np.frombuffer(b"".join(x.as_py() or b"" for x in lowered), np.uint8)
    inside = _IS_TOKEN[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    some = ends[:-1][ends[:-1] < len(data)]
    begins[some] = inside[some]  # texts lie side by side without anything between them
    at = np.flatnonzero(begins)
    text = np.searchsorted(ends, at, side="right") - 1
    offsets = np.append(np.cumsum(inside)[at] - 1, inside.sum()).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return tokens, text


def counts(lowered: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different tokens of lower-cased texts, as bytes; for each text and token in it, the places of both and how often it stands there; the texts' lengths."""
    tokens, text = _tokens(lowered)
    coded = tokens.dictionary_encode()
    words = coded.dictionary
    pairs, times = np.unique(text * max(1, len(words)) + coded.indices.to_numpy(), return_counts=True)
    of, word = np.divmod(pairs, max(1, len(words)))
    return words, of, word, times, np.bincount(text, minlength=len(lowered))


def slices(lowered: pa.Array, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Where slices of ``HELD`` bytes of texts, and of ``rows`` of them at most, begin and end."""
    size = np.cumsum(pc.fill_null(pc.binary_length(lowered), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(lowered):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + HELD, side="right")))
        end = min(end, at + rows) if rows else end
        yield at, end
        at = end


def _counted_slice(lowered: pa.Array) -> pa.Array:
    words, of, word, times, dl = counts(lowered)
    place = np.fromiter((_place(w) for w in words.to_pylist()), np.int64, len(words))
    ends = pa.array(np.searchsorted(of, np.arange(len(lowered) + 1)), pa.int32())
    vectors = np.bincount(of * DIMENSIONS + place[word], weights=times, minlength=len(lowered) * DIMENSIONS)
    vector = pa.ListArray.from_arrays(pa.array(np.arange(len(lowered) + 1) * DIMENSIONS, pa.int32()), pa.array(vectors.astype(np.float64)))
    terms = words.cast(pa.binary()).cast(pa.string()).take(pa.array(word))
    lists = [pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))), pa.array(dl, pa.int64()), vector]
    return pa.StructArray.from_arrays(lists, fields=list(_LISTS))


def _counted(lowered: pa.Array) -> pa.Array:
    """Of each lower-cased text, as bytes, its terms with their counts, their sum, and how many fall into each place by their hash.

    Texts are read in slices of ``HELD`` bytes, so that no batch is held as tokens.
    """
    out = [_counted_slice(lowered.slice(at, end - at)) for at, end in slices(lowered)]
    return pa.concat_arrays(out) if out else pa.array([], _LISTS)


def counted(text: Column) -> Column:
    """struct(terms, tfs, dl, vector) of a text; of a null text that of an empty one. Lower case is Spark's, so that terms are ``T.tokens``."""
    of = F.arrow_udf(_counted, "struct<terms:array<string>,tfs:array<long>,dl:long,vector:array<double>>")
    return of(F.lower(text).cast("binary"))


def hashed_counts(table: DataFrame, key: str, text: str) -> DataFrame:
    """Default embedding (key, vector): how many of a text's tokens fall into each of 128 places by their MD5."""
    return table.select(key, counted(F.col(text))["vector"].alias("vector"))


def embedded(table: DataFrame, key: str, text: str, embed: Embed | None = None, prefix: str = "") -> DataFrame:
    """``table`` with ``vector``: by ``embed``, a model that is called once for each Arrow batch, else ``hashed_counts``.

    Models that want their questions marked get ``prefix`` put before each text.
    """
    if embed is None:
        return table.withColumn("vector", counted(F.col(text))["vector"])
    schema = table.select("*", F.lit(None).cast("array<double>").alias("vector")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(vector=embed(prefix + pdf[text]))

    return table.mapInPandas(run, schema)


def dealt(chunks: DataFrame) -> DataFrame:
    """Each text is read once where it lies; only a table of fewer parts than there are cores is dealt out."""
    cores = chunks.sparkSession.sparkContext.defaultParallelism
    return chunks.repartition(cores) if chunks.rdd.getNumPartitions() < cores else chunks


def _counting(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered, others = batch["_lowered"], batch.select(names)
            for at, end in slices(lowered):
                lists = _counted_slice(lowered.slice(at, end - at)).flatten()
                yield pa.RecordBatch.from_arrays([*others.slice(at, end - at).columns, *lists], [*names, "terms", "tfs", "dl", "_hashed"])

    return run


def _with_counts(table: DataFrame) -> DataFrame:
    """``table`` with terms, tfs, dl and ``_hashed`` of its texts in ``_lowered``; a batch's lists are given on slice by slice."""
    names = [c for c in table.columns if c != "_lowered"]
    made = ("terms", "array<string>"), ("tfs", "array<long>"), ("dl", "long"), ("_hashed", "array<double>")
    return table.mapInArrow(_counting(names), table.select(*names, *(F.lit(None).cast(kind).alias(c) for c, kind in made)).schema)


def indexed(chunks: DataFrame, embed: Embed | None = None, texts: bool = True) -> DataFrame:
    """Chunks with terms, their counts tfs, length dl, period and vector, and with ``texts`` their text; written once. An indexed table is returned as it is."""
    if {"terms", "tfs", "dl", "period", "vector"} <= set(chunks.columns):
        return chunks
    chunks, rest = dealt(chunks), [] if texts else ["text"]
    needed = texts or embed is not None or "chunk_type" in chunks.columns
    read = chunks.withColumn("period", P.period_key(F.col("fiscal_period"))).withColumn("_lowered", F.lower("text").cast("binary"))
    read = _with_counts(read if needed else read.drop("text"))
    if "chunk_type" in chunks.columns:
        words = read.withColumn("_words", T.words_for_embedding(F.col("text"), F.col("chunk_type")))
        return kept(embedded(words, "chunk_id", "_words", embed).drop("_words", "_hashed", *rest), "index")
    read = read.withColumnRenamed("_hashed", "vector") if embed is None else embedded(read.drop("_hashed"), "chunk_id", "text", embed)
    return kept(read.drop(*rest), "index")


def postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dl, term, tf)."""
    return indexed(chunks).select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("chunk_id", "dl", F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n and avgdl."""
    return indexed(chunks).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def idf(postings_: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf); terms of more than half the corpus get a quarter of the mean."""
    return with_idf(postings_.groupBy("term").agg(F.count("*").alias("df")), stats)


def with_idf(df: DataFrame, stats: DataFrame) -> DataFrame:
    """``idf`` of terms whose document frequencies (term, df, …) are known."""
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    value = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select(*df.columns, value.alias("idf"))


def bm25(chunks: DataFrame, question_terms: DataFrame) -> DataFrame:
    """(qid, chunk_id, bm25) where a question's terms occur; (qid, term) rows count as often as they are given."""
    chunks = indexed(chunks)
    post, stats = postings(chunks), corpus_stats(chunks)
    asked = question_terms.groupBy("qid", "term").agg(F.count("*").alias("times")).join(idf(post, stats), "term").select("qid", "term", (F.col("idf") * F.col("times")).alias("weight"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    # The questions' terms are few beside the postings; Spark sends them to the postings where they are small enough.
    return post.crossJoin(F.broadcast(stats.select("avgdl"))).join(asked, "term").groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 6).alias("bm25"))


def frequencies(chunks: DataFrame) -> DataFrame:
    """(term, df, plain): of how many chunks a term is, and of how many of them that aren't rows; written, since common terms and weights are told by it."""
    terms = indexed(chunks).select(F.explode("terms").alias("term"), "is_row")
    return kept(terms.groupBy("term").agg(F.count("*").alias("df"), F.count_if(~F.col("is_row")).alias("plain")), "frequencies")


def common_terms(chunks: DataFrame, ratio: float = 0.5, least: int = 50, known: DataFrame | None = None) -> DataFrame:
    """Terms of more than ``ratio`` of the passages that aren't rows; none among fewer than ``least``. ``known`` are their ``frequencies``, if there already."""
    plain = indexed(chunks).where(~F.col("is_row"))
    n = plain.agg(F.count("*").alias("n"))
    terms = plain.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")) if known is None else known.where("plain > 0").select("term", F.col("plain").alias("df"))
    return terms.crossJoin(F.broadcast(n)).where((F.col("n") >= least) & (F.col("df") / F.col("n") > ratio)).select("term", "df")


def focused(questions: DataFrame, chunks: DataFrame, ratio: float = 0.5, known: DataFrame | None = None) -> DataFrame:
    """Questions with ``focus``: the telling terms of what they ask besides periods, or all of that where none is left."""
    return focused_by(questions, common_terms(chunks, ratio, known=known))


def focused_by(questions: DataFrame, common: DataFrame) -> DataFrame:
    """``focused`` by common terms (term) that are known."""
    rest = questions.withColumn("_rest", P.query_periods(F.col("question"))["rest"])
    asked = rest.select("qid", F.posexplode(T.focus_tokens(F.col("_rest"))).alias("pos", "term"))
    left = asked.join(common, "term", "left_anti").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"]), " ").alias("focus"))
    return rest.join(left, "qid", "left").withColumn("focus", F.coalesce("focus", "_rest")).drop("_rest")


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    return np.sign(x) * np.floor(np.abs(x) * 10.0**places + 0.5) / 10.0**places


def _lengths(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy()


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, size: int) -> np.ndarray:
    """Vectors of ``size`` components as rows; one with a null or non-finite component is zero."""
    lists = column.combine_chunks()
    some = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
    out = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
    out[~np.isfinite(out).all(axis=1)] = 0
    return out


def cosines(left: pa.Table, right: pa.Table) -> np.ndarray:
    """Similarity of every question (row) with every chunk; 0 for a vector that is zero, null or broken, and for two of different lengths."""
    of, asked = _lengths(left["vector"]), _lengths(right["asked"])
    out = np.zeros((len(asked), len(of)))
    for size in np.unique(asked[asked > 0]):
        here, there = np.flatnonzero(asked == size), np.flatnonzero(of == size)
        q, x = _matrix(right["asked"], here, size), _matrix(left["vector"], there, size)
        below = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))[None, :]
        out[np.ix_(here, there)] = rounded(np.divide(q @ x.T, below, out=np.zeros_like(below), where=below > 0), 6)
    return out


def keyword_scores(left: pa.Table, right: pa.Table, average: float) -> np.ndarray:
    """BM25 of every question (row) with every chunk."""
    out = np.zeros((right.num_rows, left.num_rows))
    lists, asked = left["terms"].combine_chunks(), right["weights"].combine_chunks()
    flat = asked.flatten()
    if not len(flat) or not len(lists.flatten()):
        return out
    vocabulary = pc.unique(flat.field("term"))
    column = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    tf = left["tfs"].combine_chunks().flatten().to_numpy().astype(np.float64)
    hit = np.flatnonzero(column >= 0)
    hit = hit[np.argsort(column[hit], kind="stable")]
    row, tf, column = row[hit], tf[hit], column[hit]
    part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * left["dl"].to_numpy()[row] / average))
    begin = np.searchsorted(column, np.arange(len(vocabulary) + 1))
    which = pc.index_in(flat.field("term"), value_set=vocabulary).to_numpy(zero_copy_only=False)
    weight = flat.field("weight").to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(asked.value_lengths().to_numpy())])
    for i in range(len(out)):
        for t, w in zip(which[at[i] : at[i + 1]], weight[at[i] : at[i + 1]], strict=True):
            a, b = begin[t], begin[t + 1]
            out[i, row[a:b]] += w * part[a:b]  # a term stands once in a chunk's list
    return rounded(out, 6)


def _cells(chunks: DataFrame, questions: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str, asked: int | None = None) -> DataFrame:
    """What ``meet`` makes of every block of chunks with every block of questions (``asked`` of them, else they are counted)."""
    blocks = max(1, -(-chunks.count() // CHUNKS))
    asked = max(1, -(-(questions.count() if asked is None else asked) // QUESTIONS))
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = chunks.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int")).withColumn("of", steps(asked))
    right = questions.withColumn("of", F.pmod(F.xxhash64("qid"), F.lit(asked)).cast("int")).withColumn("block", steps(blocks))
    return left.groupBy("block", "of").cogroup(right.groupBy("block", "of")).applyInArrow(meet, schema)


def nearest(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_id, similarity, rank) of the ``k`` most similar chunks, ties to the smaller chunk_id.

    ``chunks`` has chunk_id, vector and, if a question's ``wanted`` shall restrict it, doc. Each cell gives its ``k`` best.
    """
    some = "wanted" in questions.columns

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("chunk_id")
            ids, qids, sim = left["chunk_id"].to_numpy(), right["qid"].to_numpy(), cosines(left, right)
            for i in range(right.num_rows):
                at = _allowed(left, right, i) if some else np.arange(len(ids))
                best = at[np.argsort(-sim[i, at], kind="stable")[:k]]
                out.append((np.full(len(best), qids[i]), ids[best], sim[i, best]))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else ([], [], [])
        return pa.table({"qid": pa.array(q, pa.int64()), "chunk_id": pa.array(c, pa.int64()), "similarity": pa.array(s, pa.float64())})

    left = chunks.select("chunk_id", "vector", *(["doc"] if some else []))
    right = questions.select("qid", F.col("vector").alias("asked"), *(["wanted"] if some else []))
    return top(_cells(left, right, meet, "qid long, chunk_id long, similarity double"), "similarity", k)


def _allowed(left: pa.Table, right: pa.Table, i: int) -> np.ndarray:
    """Places of the chunks that a question may be answered from."""
    wanted = right["wanted"][i]
    return np.arange(left.num_rows) if not wanted.is_valid else np.flatnonzero(pc.fill_null(pc.equal(left["doc"], wanted), False).to_numpy(zero_copy_only=False))


def with_facts(questions: DataFrame) -> DataFrame:
    """Questions with the periods and the statement kind that they name."""
    q = F.col("question")
    return questions.withColumns({"asked_periods": P.query_periods(q)["periods"], "names_period": P.names_period(q), "asked_kind": T.statement_named(q)})


def bonuses(candidates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidates (qid, chunk_id, question, fiscal_period, statement_type, …) with ``bonus``.

    Newer periods among a question's candidates get up to ``recency_boost``, unless the question names a
    period; a chunk of a period or statement kind that it names gets ``period_boost`` for each.
    """
    if "asked_periods" not in candidates.columns:
        candidates = with_facts(candidates)
    if "period" not in candidates.columns:
        candidates = candidates.withColumn("period", P.period_key(F.col("fiscal_period")))
    of = Window.partitionBy("qid")
    keyed = candidates.withColumn("_key", F.nullif(F.col("period"), F.lit(0)))
    # Only a question's different periods are ranked in one task, and they are few.
    places = keyed.where("_key is not null").select("qid", "_key").distinct().withColumns({"_rank": F.row_number().over(of.orderBy("_key")), "_span": F.count("*").over(of)})
    keyed = keyed.join(places, ["qid", "_key"], "left")
    recent = F.when(~F.col("names_period") & (F.col("_span") >= 2), settings.recency_boost * (F.col("_rank") - 1) / (F.col("_span") - 1))
    named = F.when(F.array_contains("asked_periods", F.coalesce("_key", F.lit(0))), settings.period_boost)
    kind = F.when(F.col("asked_kind") == F.col("statement_type"), settings.period_boost)
    zero = F.lit(0.0)
    return keyed.withColumn("bonus", F.coalesce(recent, zero) + F.coalesce(named, zero) + F.coalesce(kind, zero)).drop("_key", "_rank", "_span")


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their questions with ``_part``, their task's number, and how many of their question, and of these of their kind, come before them in it."""
    part, last, carried = TaskContext.get().partitionId(), None, np.zeros(3, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        qid, row = batch["qid"].to_numpy(), batch["is_row"].to_numpy(zero_copy_only=False).astype(bool)
        first = np.flatnonzero(np.concatenate([[True], qid[1:] != qid[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(qid))))
        counts = np.column_stack([np.ones(len(qid), np.int64), ~row, row])
        upto = np.cumsum(counts, axis=0)
        before = upto - counts
        before -= before[first][group]
        if qid[0] == last:
            before[group == 0] += carried
        last, carried = qid[-1], before[-1] + counts[-1]
        made = (pa.array(np.full(len(qid), part)), pa.array(before[:, 0]), pa.array(np.where(row, before[:, 2], before[:, 1])))
        yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "_part", "_all", "_kind"])


def _placed(scored: DataFrame, score: str, every: str, within: str) -> DataFrame:
    """With a row's places by ``score``: ``every`` among all of its question, from 1, and ``within`` those of its kind, from 0.

    Rows are dealt out by ranges of question and score, counted within their range, and raised by what the ranges before hold,
    so that a question's candidates may fill any number of tasks.
    """
    order = ["qid", F.desc(score), "chunk_id"]
    schema = scored.select("*", *(F.lit(0).cast("long").alias(c) for c in ("_part", "_all", "_kind"))).schema
    counted_ = kept(scored.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_before, schema), "places")
    sizes = counted_.groupBy("qid", "is_row", "_part").agg(F.count("*").alias("_n"))
    ahead = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each question, kind and range of it: as many as there are questions and tasks together, twice.
    starts = sizes.select("qid", "is_row", "_part", ahead("qid").alias("_all_ahead"), ahead("qid", "is_row").alias("_kind_ahead"))
    placed = counted_.join(starts, ["qid", "is_row", "_part"])
    return placed.withColumns({every: F.col("_all") + F.col("_all_ahead") + 1, within: F.col("_kind") + F.col("_kind_ahead")}).drop("_part", "_all", "_kind", "_all_ahead", "_kind_ahead")


def ranks(scored: DataFrame) -> DataFrame:
    """(qid, chunk_id, similarity, bm25, is_row, none of them null) with ranks over all candidates, from 1, and within rows and passages, from 0."""
    return _placed(_placed(scored, "similarity", "vec_rank", "vec_type_rank"), "bm25", "bm25_rank", "bm25_type_rank")


def fused(ranked: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """With ``rrf``: reciprocal ranks of both lists, weighed for rows, plus the bonus."""
    weight = F.when(F.col("is_row"), settings.row_weight).otherwise(1.0)
    score = weight / (settings.rrf_k + F.col("vec_type_rank")) + weight / (settings.rrf_k + F.col("bm25_type_rank"))
    bonus = F.col("bonus") if "bonus" in ranked.columns else F.lit(0.0)
    return ranked.withColumn("rrf", F.round(score + bonus, 8))


def top(table: DataFrame, score: str, k: int) -> DataFrame:
    """The ``k`` best rows of each question, ties to the smaller chunk_id, with ``rank``."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(score), "chunk_id"))
    return table.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def _asked(questions: DataFrame, chunks: DataFrame, settings: Settings, embed: Embed | None, known: DataFrame | None = None) -> DataFrame:
    """Questions with their facts, ``focus``, its vector, and ``wanted``, the document that they are restricted to."""
    asked = focused(questions, chunks, settings.common_term_ratio, known) if settings.focus_query else questions.withColumn("focus", P.query_periods(F.col("question"))["rest"])
    asked = asked.withColumn("wanted", F.col("doc") if "doc" in questions.columns else F.lit(None).cast("string"))
    return embedded(with_facts(asked.select("qid", "question", "focus", "wanted")), "qid", "focus", embed, settings.query_prefix)


def _weighted(asked: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Questions with ``weights``: their terms, each with its inverse frequency times its count."""
    terms = asked.select("qid", F.explode(T.query_tokens(F.col("focus"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    stats = corpus_stats(chunks)
    weights = terms.join(idf(postings(chunks), stats) if known is None else with_idf(known.select("term", "df"), stats), "term")
    lists = weights.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("term", (F.col("idf") * F.col("times")).alias("weight")))).alias("weights"))
    return asked.join(lists, "qid", "left").withColumn("weights", F.coalesce("weights", F.array().cast("array<struct<term:string,weight:double>>")))


RANKED = "qid long, chunk_id long, is_row boolean, similarity double, bm25 double, vec_rank long, vec_type_rank long, bm25_rank long, bm25_type_rank long"
POOL = "qid long, chunk_id long, similarity double, bm25 double, is_row boolean, period int, named boolean, kind boolean"
PLACES = "qid long, chunk_id long, v long, b long, vt long, bt long"
SCORING = ("chunk_id", "doc", "is_row", "statement_type", "period", "vector", "terms", "tfs", "dl")
LISTS = "qid long, ids array<long>, sims array<double>, words array<double>, rows array<boolean>, periods array<int>, named array<boolean>, kinds array<boolean>"


def _to_score(asked: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    return _weighted(asked, chunks, known).select("qid", "wanted", F.col("vector").alias("asked"), "asked_periods", "asked_kind", "weights")


def _scored(asked: DataFrame, chunks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """For each question and block of chunks its candidates' scores and facts, as arrays."""
    average = corpus_stats(chunks).first()["avgdl"] or 1.0
    schema = pa.schema([("qid", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64())), ("words", pa.list_(pa.float64())), ("rows", pa.list_(pa.bool_())), ("periods", pa.list_(pa.int32())), ("named", pa.list_(pa.bool_())), ("kinds", pa.list_(pa.bool_()))])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        sim, words = cosines(left, right), keyword_scores(left, right, average)
        ids, row, period = left["chunk_id"].to_numpy(), left["is_row"].to_numpy(), left["period"].to_numpy()
        kind = np.array(left["statement_type"].to_pylist(), object)
        at, named, kinds = [], [], []
        for i, (periods, wanted_kind) in enumerate(zip(right["asked_periods"].to_pylist(), right["asked_kind"].to_pylist(), strict=True)):
            some = _allowed(left, right, i)
            at.append(some)
            named.append(np.isin(period[some], periods or []) & (period[some] != 0))
            kinds.append((kind[some] == wanted_kind) if wanted_kind else np.zeros(len(some), bool))
        every, ends = np.concatenate(at), pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]), pa.int32())
        of = np.repeat(np.arange(len(at)), [len(x) for x in at])
        flat = (ids[every], sim[of, every], words[of, every], row[every], period[every], np.concatenate(named), np.concatenate(kinds))
        out = pa.Table.from_arrays([right["qid"].combine_chunks(), *(pa.ListArray.from_arrays(ends, pa.array(x, f.type.value_type)) for x, f in zip(flat, list(schema)[1:], strict=True))], schema=schema)
        return out.filter(pc.greater(pc.list_value_length(out["ids"]), 0))

    return _cells(chunks.select(*SCORING), _to_score(asked, chunks, known), meet, LISTS, asked.count())


def _facts(chunks: DataFrame) -> DataFrame:
    return indexed(chunks).select("chunk_id", "doc", "is_row", "period", "statement_type")


def candidates(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), embed: Embed | None = None) -> DataFrame:
    """Every question with every chunk that it may be answered from, with both scores.

    A question's ``doc``, where it has one, restricts its candidates and nothing else.
    """
    chunks = indexed(chunks, embed)
    return _pairs(kept(_asked(questions, chunks, settings, embed), "asked"), chunks)


def _pairs(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    pairs = _scored(asked, chunks).select("qid", F.explode(F.arrays_zip("ids", "sims", "words")).alias("x"))
    pairs = pairs.select("qid", F.col("x.ids").alias("chunk_id"), F.col("x.sims").alias("similarity"), F.col("x.words").alias("bm25"))
    return pairs.join(_facts(chunks), "chunk_id").join(asked.drop("vector", "focus", "wanted"), "qid")


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The elements of all lists."""
    return column.flatten().to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in column.chunks])


def _all_ranks(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """One question's candidates with their ranks over all of them, as ``ranks`` has them."""
    qid, ids = table["qid"][0].as_py(), _flat(table["ids"])
    order = np.argsort(ids, kind="stable")
    ids, row, sim, words = ids[order], _flat(table["rows"])[order].astype(bool), _flat(table["sims"])[order], _flat(table["words"])[order]
    del table, order

    def places(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(-score, kind="stable")
        all_, within = np.empty(len(by), np.int32), np.empty(len(by), np.int32)
        all_[by] = np.arange(1, len(by) + 1)
        for some in (by[row[by]], by[~row[by]]):
            within[some] = np.arange(len(some))
        return all_, within

    made = (ids, row, sim, words, *(x for score in (sim, words) for x in places(score)))
    names = [c.split()[0] for c in RANKED.split(", ")]
    for at in range(0, len(ids), SLICE):
        part = [x[at : at + SLICE] for x in made]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), qid)), *(pa.array(x.astype(np.int64) if x.dtype == np.int32 else x) for x in part)], names)


def ranked_candidates(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), embed: Embed | None = None, held: int = CANDIDATES) -> DataFrame:
    """``ranks`` of ``candidates``: every question with every chunk that it may be answered from, with scores and ranks.

    A question's scores are ranked as arrays in one task while the chunks are ``held`` at most, so that they are moved once; beyond, by ranges over any number of tasks.
    """
    chunks = indexed(chunks, embed)
    asked = kept(_asked(questions, chunks, settings, embed), "asked")
    names = [c.split()[0] for c in RANKED.split(", ")]
    if chunks.count() > held:
        return ranks(_pairs(asked, chunks)).select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if table.num_rows:
            yield from _all_ranks(table)

    return _scored(asked, chunks).select("qid", "ids", "rows", "sims", "words").groupBy("qid").applyInArrow(run, RANKED)


def _undominated(ids: np.ndarray, sim: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Places of those with fewer than ``k`` others ahead of them by both scores, ties to the smaller id.

    Candidates come in the order of the first score; of those before, so many are ahead by the second as stand before its place in
    the k best so far.
    """
    if len(ids) <= k:
        return np.arange(len(ids))
    first = np.lexsort((ids, -sim))
    second = np.empty(len(ids), np.int64)
    second[np.lexsort((ids, -words))] = np.arange(len(ids))
    place = second[first]
    best, out = sorted(place[:k].tolist()), list(range(k))
    at = k
    while at < len(place):  # up to the next one that fewer than k of the ones before beat
        better = np.flatnonzero(place[at : at + 256] < best[-1])
        if not len(better):
            at += 256
            continue
        at += int(better[0])
        out.append(at)
        insort(best, int(place[at]))
        best.pop()
        at += 1
    return first[out]


def _pool(table: pa.Table, k: int) -> pa.Table:
    """Of the candidates of one question (a row each), those that can be among its ``k`` best: of each kind and bonus those with fewer than ``k`` ahead by both scores."""
    kinds = np.column_stack([table[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("is_row", "period", "named", "kind")])
    ids, sim, words = (table[c].to_numpy() for c in ("chunk_id", "similarity", "bm25"))
    classes, of = np.unique(kinds, axis=0, return_inverse=True)
    some = [np.flatnonzero(of.ravel() == i) for i in range(len(classes))]
    return table.take(pa.array(np.concatenate([x[_undominated(ids[x], sim[x], words[x], k)] for x in some])))


class _Band:
    """Of one question's candidates of one class so far, those with fewer than ``k`` ahead by both scores, in the order of the first."""

    def __init__(self, k: int):
        self.k, self.ids, self.sim, self.words = k, np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.new: list[tuple[np.ndarray, ...]] = []
        self._raise()

    def _raise(self) -> None:
        """After so many of the first, the k-th best by the second score: whoever comes after it there, is behind k by both."""
        best: list[tuple[float, int]] = []
        bars = [(-np.inf, 0)] * min(self.k, len(self.ids) + 1)
        for n, x in enumerate(zip((-self.words).tolist(), self.ids.tolist(), strict=True), 1):
            insort(best, x)
            del best[self.k :]
            if n >= self.k:
                bars.append((-best[-1][0], best[-1][1]))
        self.bar, self.bar_id, self.down = np.array([x for x, _ in bars]), np.array([x for _, x in bars], np.int64), -self.sim

    def add(self, ids: np.ndarray, sim: np.ndarray, words: np.ndarray) -> None:
        ahead = np.searchsorted(self.down, -sim, "left")
        bar = self.bar[ahead]
        some = np.flatnonzero((words > bar) | ((words == bar) & (ids < self.bar_id[ahead])))
        if len(some):
            self.new.append((ids[some], sim[some], words[some]))
            if sum(len(x[0]) for x in self.new) > len(self.ids) + 64:
                self.settle()

    def settle(self) -> None:
        ids, sim, words = map(np.concatenate, zip((self.ids, self.sim, self.words), *self.new, strict=True))
        at = _undominated(ids, sim, words, self.k)
        at = at[np.lexsort((ids[at], -sim[at]))]
        self.ids, self.sim, self.words, self.new = ids[at], sim[at], words[at], []
        self._raise()


def _read(batches: Iterator[pa.RecordBatch], asked: pa.Table, average: float) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray | None]]]:
    """Chunks, some at a time, with all questions' scores of them, and for each question restricted to a document the places of its chunks."""
    free = [x is None for x in asked["wanted"].to_pylist()]
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNKS):
            left = pa.Table.from_batches([batch.slice(at, CHUNKS)])
            yield left, cosines(left, asked), keyword_scores(left, asked, average), [None if every else _allowed(left, asked, i) for i, every in enumerate(free)]


def _pooling(held, average: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of the chunks that a task reads, those that can be among the ``k`` best of a question of the block; classes are chunks of one kind, period and statement."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, bands = held.value, {}
        for left, sim, words, allowed in _read(batches, asked, average):
            ids, row, period, kind = (left[c].to_numpy() for c in ("chunk_id", "is_row", "period", "statement_type"))
            classes: dict[tuple, list[int]] = {}
            for i, x in enumerate(zip(row.tolist(), period.tolist(), kind.tolist(), strict=True)):
                classes.setdefault(x, []).append(i)
            for x, places in classes.items():
                places = np.array(places)
                for i, only in enumerate(allowed):
                    some = places if only is None else np.intersect1d(places, only, assume_unique=True)
                    if len(some):
                        if (i, x) not in bands:
                            bands[i, x] = _Band(k)
                        bands[i, x].add(ids[some], sim[i, some], words[i, some])
        qids, periods, kinds = (asked[c].to_pylist() for c in ("qid", "asked_periods", "asked_kind"))
        for (i, (row, period, kind)), band in bands.items():
            band.settle()
            facts = row, period, period != 0 and period in (periods[i] or []), bool(kinds[i]) and kind == kinds[i]
            rows = {"qid": [qids[i]] * len(band.ids), "chunk_id": band.ids, "similarity": band.sim, "bm25": band.words, **{c: [x] * len(band.ids) for c, x in zip(("is_row", "period", "named", "kind"), facts, strict=True)}}
            yield pa.RecordBatch.from_pydict(rows, schema=_POOL)

    return run


_POOL = pa.schema([("qid", pa.int64()), ("chunk_id", pa.int64()), ("similarity", pa.float64()), ("bm25", pa.float64()), ("is_row", pa.bool_()), ("period", pa.int32()), ("named", pa.bool_()), ("kind", pa.bool_())])


class _Places:
    """How many candidates stand before each of a pool by one score, ties to the smaller id; counted by where they come in its order."""

    def __init__(self, ids: np.ndarray, score: np.ndarray, row: np.ndarray):
        self.order = np.lexsort((ids, -score))
        self.ids, self.down, self.row = ids[self.order], -score[self.order], row[self.order]
        self.found = np.zeros((2, len(ids) + 1), np.int64)

    def add(self, ids: np.ndarray, score: np.ndarray, kind: int) -> None:
        at = np.searchsorted(self.down, -score, "left")
        equal = np.flatnonzero(np.append(self.down, np.inf)[at] == -score)
        begins = at[equal]
        for a in np.unique(begins):
            some = equal[begins == a]
            b = np.searchsorted(self.down, self.down[a], "right")
            at[some] = a + np.searchsorted(self.ids[a:b], ids[some], "right")
        self.found[kind] += np.bincount(at, minlength=len(self.ids) + 1)

    def told(self) -> tuple[np.ndarray, np.ndarray]:
        """Those before each in all, and of its kind."""
        before = self.found.cumsum(axis=1)[:, :-1]
        out = np.empty((2, len(self.ids)), np.int64)
        out[:, self.order] = before.sum(axis=0), np.where(self.row, before[1], before[0])
        return out[0], out[1]


def _placing(held, pool, average: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each of the block's pool, how many of the chunks that a task reads stand before it by either score, in all and within its kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, of, places = held.value, pool.value.sort_by("qid"), {}
        qids, flat = of["qid"].to_numpy(), [of[c].to_numpy() for c in ("chunk_id", "similarity", "bm25", "is_row")]
        for i, q in enumerate(asked["qid"].to_pylist()):
            a, b = np.searchsorted(qids, q, "left"), np.searchsorted(qids, q, "right")
            if b > a:
                ids, sim, words, row = (x[a:b] for x in flat)
                places[i] = q, ids, _Places(ids, sim, row), _Places(ids, words, row)
        for left, sim, words, allowed in _read(batches, asked, average):
            ids, row = left["chunk_id"].to_numpy(), left["is_row"].to_numpy()
            by_kind = [np.flatnonzero(~row), np.flatnonzero(row)]
            for i, (_, _, first, second) in places.items():
                for kind, some in enumerate(by_kind):
                    if allowed[i] is not None:
                        some = np.intersect1d(some, allowed[i], assume_unique=True)
                    if len(some):
                        first.add(ids[some], sim[i, some], kind)
                        second.add(ids[some], words[i, some], kind)
        for q, ids, first, second in places.values():
            (v, vt), (b, bt) = first.told(), second.told()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int64)), *map(pa.array, (ids, v, b, vt, bt))], [c.split()[0] for c in PLACES.split(", ")])

    return run


def _counted_best(asked: DataFrame, chunks: DataFrame, settings: Settings, k: int, known: DataFrame) -> DataFrame:
    """The ``k`` best by the fused score, the same as ``ranks``, ``bonuses``, ``fused`` and ``top`` of all candidates.

    Within a kind and bonus, one that ``k`` others beat by both scores isn't among the best. What is left of each task's chunks, and then of
    all, is a small pool, which holds every period that the candidates have. Its exact ranks are counted over all chunks, whose scores are
    worked out once more: they are many times the index, and cheaper made than moved. Questions come to the tasks in blocks of ``QUESTIONS``.
    """
    if settings.row_weight < 0:  # then being ahead doesn't help
        return top(fused(bonuses(ranks(_pairs(asked, chunks)), settings), settings), "rrf", k)
    # What both readings of the chunks score is the same, since they read the same columns of the same files.
    average = corpus_stats(chunks).first()["avgdl"] or 1.0
    left, right = chunks.select(*SCORING), kept(_to_score(asked, chunks, known), "weighted")
    blocks = max(1, -(-right.count() // QUESTIONS))
    context = chunks.sparkSession.sparkContext
    block = lambda table, i: context.broadcast(table.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i).toArrow())
    of = [block(right, i) for i in range(blocks)]
    every = lambda made, schema: reduce(DataFrame.unionAll, [left.mapInArrow(f, schema) for f in made])
    local = every([_pooling(held, average, k) for held in of], POOL)
    pool = kept(local.groupBy("qid").applyInArrow(lambda table: _pool(table, k), POOL), "pool")
    counted_ = every([_placing(held, block(pool, i), average) for i, held in enumerate(of)], PLACES)
    placed = kept(counted_.groupBy("qid", "chunk_id").agg((F.sum("v") + 1).alias("vec_rank"), (F.sum("b") + 1).alias("bm25_rank"), F.sum("vt").alias("vec_type_rank"), F.sum("bt").alias("bm25_type_rank")), "placed")
    # Written, since what follows reads it more than once.
    facts = pool.drop("is_row", "period", "named", "kind").join(placed, ["qid", "chunk_id"]).join(_facts(chunks), "chunk_id").join(asked.drop("vector", "focus", "wanted"), "qid")
    scored = kept(fused(bonuses(facts, settings), settings), "fused")
    best, far = top(scored, "rrf", k), _far(scored, settings, k)
    if far.isEmpty():
        return best
    # Where scores so far down decide that rounding makes equal, ids decide among candidates outside the pool too.
    rest = top(fused(bonuses(ranks(_pairs(asked.join(far, "qid", "left_semi"), chunks)), settings), settings), "rrf", k)
    return best.join(far, "qid", "left_anti").unionByName(rest, allowMissingColumns=True)


def _far(scored: DataFrame, settings: Settings, k: int) -> DataFrame:
    """(qid) of the questions whose last place is held by a score that may be, once rounded, also that of one which the holder beats by both scores."""
    least = top(scored, "rrf", k).groupBy("qid").agg(F.min("rrf").alias("rrf"))
    weight = F.when(F.col("is_row"), settings.row_weight).otherwise(1.0)
    step = lambda c: weight / ((settings.rrf_k + F.col(c)) * (settings.rrf_k + F.col(c) + 1))
    return scored.join(least, ["qid", "rrf"]).where(step("vec_type_rank") + step("bm25_type_rank") < 2e-8).select("qid").distinct()


def _best(settings: Settings, k: int) -> Callable[[pa.Table], pa.Table]:
    """One question's ranks over all its candidates, and the ``k`` best by the fused score; the same as ``ranks``, ``bonuses``, ``fused`` and ``top``."""

    def run(table: pa.Table) -> pa.Table:
        flat = lambda c: np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in table[c]])
        ids = flat("ids")
        order = np.argsort(ids, kind="stable")
        ids, sim, words, row, period, named, kind = (flat(c)[order] for c in ("ids", "sims", "words", "rows", "periods", "named", "kinds"))

        def places(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            by = np.argsort(-score, kind="stable")
            all_, within = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
            all_[by] = np.arange(1, len(by) + 1)
            for some in (by[row[by]], by[~row[by]]):
                within[some] = np.arange(len(some))
            return all_, within

        vec, vec_type = places(sim)
        bm, bm_type = places(words)
        weight = np.where(row, settings.row_weight, 1.0)
        bonus = np.zeros(len(ids))
        known = np.unique(period[period != 0])
        if len(known) >= 2 and not table["names_period"][0].as_py():
            bonus = np.where(period != 0, settings.recency_boost * np.searchsorted(known, period) / (len(known) - 1), 0.0)
        bonus = bonus + np.where(named, settings.period_boost, 0.0) + np.where(kind, settings.period_boost, 0.0)
        score = rounded(weight / (settings.rrf_k + vec_type) + weight / (settings.rrf_k + bm_type) + bonus, 8)
        at = np.lexsort((ids, -score))[:k]
        return pa.table({"qid": np.full(len(at), table["qid"][0].as_py()), "chunk_id": ids[at], "similarity": sim[at], "bm25": words[at], "vec_rank": vec[at], "bm25_rank": bm[at], "vec_type_rank": vec_type[at], "bm25_type_rank": bm_type[at], "bonus": bonus[at], "rrf": score[at], "rank": np.arange(1, len(at) + 1)})

    return run


def search(questions: DataFrame, chunks: DataFrame, settings: Settings = Settings(), top_k: int | None = None, embed: Embed | None = None, score: Callable | None = None, wide: bool | None = None) -> DataFrame:
    """The best chunks of each question with all scores and ranks; ``score`` is the pairwise model that reranks where the settings ask for it.

    With ``wide``, ranks are counted where the chunks are read, so that no task holds a question's scores and none are moved; else a task ranks them as arrays. Where it isn't said, an index of more than ``WIDE`` chunks is searched so. What was found is written.

    What a question says of periods is taken out before ranking and counts as a bonus only: every passage
    of a filing holds its period, so that it would rank headings first.
    """
    k = top_k or settings.top_k
    chunks = indexed(chunks, embed, texts=settings.use_hybrid and settings.use_reranker)
    known = frequencies(chunks) if settings.use_hybrid else None
    asked = kept(_asked(questions, chunks, settings, embed, known), "asked")
    told = asked.select("qid", "question")
    if not settings.use_hybrid:
        return nearest(chunks, asked, k).join(_facts(chunks), "chunk_id").join(told, "qid")
    pool = max(settings.rerank_candidates, k) if settings.use_reranker else k
    schema = "qid long, chunk_id long, similarity double, bm25 double, vec_rank long, bm25_rank long, vec_type_rank long, bm25_type_rank long, bonus double, rrf double, rank long"
    if wide or wide is None and chunks.count() > WIDE:
        best = _counted_best(asked, chunks, settings, pool, known).select(*(c.split()[0] for c in schema.split(", ")))
    else:
        best = _scored(asked, chunks, known).join(asked.select("qid", "names_period"), "qid").groupBy("qid").applyInArrow(_best(settings, pool), schema)
    # Written, since it is small and answers, citations and scores each read it.
    found = kept(kept(best, "best").join(_facts(chunks), "chunk_id").join(told, "qid"), "found")
    if not settings.use_reranker:
        return found
    return reranked(found.join(of_found(chunks.select("chunk_id", "text"), found), "chunk_id"), settings, k, score or overlap_scores)


def of_found(table: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``table`` whose chunk_id was found; what was found is small, and sent to where the rows lie, so that no text is moved."""
    return table.join(F.broadcast(found.select("chunk_id").distinct()), "chunk_id", "left_semi")


def overlap_scores(questions: pd.Series, texts: pd.Series) -> pd.Series:
    """Stand-in for a cross-encoder: share of the question's tokens in the text."""
    import re

    cut = lambda s: set(re.findall("[a-z0-9]+", (s or "").lower()))
    return pd.Series([len(cut(q) & cut(t)) / max(1, len(cut(q))) for q, t in zip(questions, texts, strict=True)], dtype="float64")


def reranked(pool: DataFrame, settings: Settings = Settings(), k: int = 8, score: Callable = overlap_scores) -> DataFrame:
    """Fuse the first order, a pairwise model's and, for figure questions, that by numeric share."""
    model = F.pandas_udf(score, "double")
    first = pool.withColumnRenamed("rank", "first_rank").withColumn("model", F.round(model("question", "text"), 6)).withColumn("dense", F.round(T.numeric_share(F.col("text")), 6))
    of = Window.partitionBy("qid")
    part = lambda c: 1 / (settings.rerank_rrf_k + F.row_number().over(of.orderBy(F.desc(c), "first_rank")) - 1)
    total = 1 / (settings.rerank_rrf_k + F.col("first_rank") - 1) + part("model") + F.when(T.wants_number(F.col("question")), part("dense")).otherwise(0.0)
    place = F.row_number().over(of.orderBy(F.desc("fused"), "first_rank"))
    return first.withColumn("fused", F.round(total, 8)).withColumn("rank", place.cast("long")).where(F.col("rank") <= k)
