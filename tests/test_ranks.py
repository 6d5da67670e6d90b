"""Ranks of a question's candidates over many tasks."""

import random
import re
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import retrieval

SCHEMA = "qid long, chunk_id long, similarity double, bm25 double, is_row boolean"


def by_sorting(rows):
    """Places of each row, counted in its question's sorted lists."""
    out = {}
    for q in {r[0] for r in rows}:
        for at, names in ((2, ("v", "vt")), (3, ("b", "bt"))):
            order = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[at], r[1]))
            kinds = {True: 0, False: 0}
            for n, r in enumerate(order):
                out.setdefault(r[:2], {}).update({names[0]: n + 1, names[1]: kinds[r[4]]})
                kinds[r[4]] += 1
    return out


def test_ranks_of_a_question_that_holds_most_rows(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(q, c, round(rng.random(), 2), rng.choice([0.0, 0.0, round(rng.uniform(0, 9), 1)]), rng.random() < 0.3) for q, n in ((1, 3), (2, 4000), (3, 1), (4, 60)) for c in range(n)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit("x"))
    held, write = [], retrieval.kept
    monkeypatch.setattr(retrieval, "kept", lambda df, name: held.append(write(df, name)) or held[-1])
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        got = retrieval.ranks(table).collect()
    finally:
        spark.conf.set(name, before)
    assert len(held) == 2 and all(t.where("qid = 2").select("_part").distinct().count() > 1 for t in held)  # its rows came from several tasks
    want = by_sorting(rows)
    assert len(got) == len(rows) and all(r["extra"] == "x" for r in got)
    assert all({"v": r["vec_rank"], "vt": r["vec_type_rank"], "b": r["bm25_rank"], "bt": r["bm25_type_rank"]} == want[r["qid"], r["chunk_id"]] for r in got)
    assert retrieval.ranks(table.where("false")).count() == 0


def test_bonus_for_newer_periods(spark):
    rows = [(q, c, "", p, None, [], False, None) for q, periods in ((1, [0, 7, 7, 9, 3]), (2, [0, 0]), (3, [5, 5])) for c, p in enumerate(periods)]
    table = spark.createDataFrame(rows, "qid long, chunk_id long, fiscal_period string, period int, statement_type string, asked_periods array<int>, names_period boolean, asked_kind string")
    got = {(r["qid"], r["chunk_id"]): round(r["bonus"], 6) for r in retrieval.bonuses(table).collect()}
    assert got == {(1, 0): 0, (1, 1): 0.005, (1, 2): 0.005, (1, 3): 0.01, (1, 4): 0, (2, 0): 0, (2, 1): 0, (3, 0): 0, (3, 1): 0}


def test_wide_search_is_search(spark):
    rng = random.Random(2)
    words = "mill pond bridge bread profit ratio notice branch quarter march standalone consolidated".split()
    chunks = spark.createDataFrame(
        [(i, f"d{i % 3}", " ".join(rng.choices(words, k=rng.choice([2, 5, 9]))), i % 3 == 0, rng.choice(["", "March 31, 2026", "June 30, 2025"]), rng.choice(["", "standalone", "consolidated"])) for i in range(150)],
        "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string",
    )
    asked = spark.createDataFrame([(1, "net profit as of March 31, 2026", None), (2, "standalone ratio", "d1"), (3, "the bridge and the pond", None)], "qid long, question string, doc string")
    index = retrieval.indexed(chunks)
    for settings in (Settings(), Settings(use_reranker=True, row_weight=0.7)):
        rows = [sorted(map(tuple, retrieval.search(asked, index, settings, 6, wide=wide).select("qid", "rank", "chunk_id", "rrf", "vec_rank", "bm25_type_rank", "doc", "question").collect())) for wide in (False, True)]
        assert rows[0] == rows[1] and len(rows[0]) == 18


def test_top_is_limited_before_it_is_gathered(spark):
    table = spark.range(10).select((F.col("id") % 2).alias("qid"), F.col("id").alias("chunk_id"), F.rand(1).alias("rrf"))
    assert "WindowGroupLimit" in retrieval.top(table, "rrf", 3)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_counted_in_slices(monkeypatch):
    """A batch is never held as tokens: what is read at once stays below a number of bytes."""
    read, counted = [], retrieval._counted_slice
    monkeypatch.setattr(retrieval, "_counted_slice", lambda texts: read.append((len(texts), sum(len(x.as_py() or b"") for x in texts))) or counted(texts))
    monkeypatch.setattr(retrieval, "HELD", 100)
    texts = [b"net profit", None, b"", b"b", b"b", b"x " * 200, b"!", b"profit of profit", b"caf\xc3\xa9 7"] * 20
    got = retrieval._counted(pa.array(texts, pa.binary())).to_pylist()
    assert sum(n for n, _ in read) == len(texts) and all(size <= 100 or n == 1 for n, size in read)
    for text, r in zip(texts, got, strict=True):
        want = Counter(re.findall(rb"[a-z0-9]+", text or b""))
        vector = [0.0] * 128
        for t, n in want.items():
            vector[int(md5(t).hexdigest()[:8], 16) % 128] += n
        assert dict(zip(r["terms"], r["tfs"], strict=True)) == {t.decode(): n for t, n in want.items()} and r["dl"] == sum(want.values()) and r["vector"] == vector
    assert len(retrieval._counted(pa.array([], pa.binary()))) == 0


def test_all_ranks_in_a_task_or_by_ranges(spark, monkeypatch):
    rng = random.Random(5)
    words = "mill pond bridge bread profit ratio notice branch".split()
    chunks = spark.createDataFrame([(i * 7 % 101, f"d{i % 3}", " ".join(rng.choices(words, k=rng.choice([0, 2, 5]))), i % 3 == 0, "", "") for i in range(101)], "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string")
    asked = spark.createDataFrame([(1, "mill pond", None), (2, "unheard", None), (3, "the bridge", "d1")], "qid long, question string, doc string")
    index = retrieval.indexed(chunks)
    monkeypatch.setattr(retrieval, "SLICE", 40)
    rows = lambda df: sorted(map(tuple, df.select(*(c.split()[0] for c in retrieval.RANKED.split(", "))).collect()))
    want = rows(retrieval.ranks(retrieval.candidates(asked, index)))
    assert len(want) == 2 * 101 + 34
    assert rows(retrieval.ranked_candidates(asked, index)) == want and rows(retrieval.ranked_candidates(asked, index, held=100)) == want


def test_pool_holds_all_that_can_be_among_the_best():
    rng = random.Random(3)
    for n, k, values in ((1, 3, 5), (400, 1, 9), (400, 8, 4), (900, 5, 400), (300, 2, 1)):
        ids, sim, words = np.array(rng.sample(range(5 * n), n)), np.array([rng.randrange(values) / 7 for _ in range(n)]), np.array([rng.randrange(values) / 3 for _ in range(n)])
        ahead = lambda s: (s[None, :] > s[:, None]) | ((s[None, :] == s[:, None]) & (ids[None, :] < ids[:, None]))
        want = np.flatnonzero((ahead(sim) & ahead(words)).sum(axis=1) < k)
        assert sorted(retrieval._undominated(ids, sim, words, k)) == sorted(want), (n, k)


def test_wide_search_writes_scores_once_and_ranks_a_pool(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(i, "d", " ".join(rng.choices(words, k=rng.choice([2, 5, 9]))), i % 3 == 0, rng.choice(["", "March 31, 2026", "June 30, 2025"]), "") for i in range(3000)], "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string")
    asked = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 as of March 31, 2026"), (3, "unheard")], "qid long, question string")
    index = retrieval.indexed(chunks)
    want = sorted(map(tuple, retrieval.search(asked, index, top_k=5).select("qid", "rank", "chunk_id", "rrf", "vec_rank", "bm25_rank", "bonus").collect()))
    held, write = {}, retrieval.kept

    def noted(df, name):
        held[name] = write(df, name)
        return held[name]

    monkeypatch.setattr(retrieval, "kept", noted)
    rows = lambda: sorted(map(tuple, retrieval.search(asked, index, top_k=5, wide=True).select("qid", "rank", "chunk_id", "rrf", "vec_rank", "bm25_rank", "bonus").collect()))
    assert rows() == want and len(want) == 15 and held["pool"].count() < 900 and "places" not in held
    # Where rounding may make scores equal, ids decide among all, by ranks of all.
    monkeypatch.setattr(retrieval, "_far", lambda scored, settings, k: scored.select("qid").where("qid = 2").distinct())
    held.clear()
    assert rows() == want and "places" in held


def test_bands_and_places_over_slices_are_those_over_all():
    """What tasks keep of their chunks, slice by slice, and what they count before it, with many ties."""
    rng = random.Random(6)
    for n, k, values in ((700, 8, 3), (900, 3, 400), (300, 1, 2), (5, 8, 2), (600, 2, 1)):
        ids, sim, words, row = np.array(rng.sample(range(9 * n), n)), np.array([rng.randrange(values) / 7 for _ in range(n)]), np.array([rng.randrange(values) / 3 for _ in range(n)]), np.array([rng.random() < 0.3 for _ in range(n)])
        band = retrieval._Band(k)
        for at in range(0, n, 90):
            band.add(ids[at : at + 90], sim[at : at + 90], words[at : at + 90])
        band.settle()
        want = ids[retrieval._undominated(ids, sim, words, k)]
        assert sorted(band.ids) == sorted(want), (n, k)
        some = np.isin(ids, want)
        ahead = (sim[None, :] > sim[some][:, None]) | ((sim[None, :] == sim[some][:, None]) & (ids[None, :] < ids[some][:, None]))
        places = retrieval._Places(ids[some], sim[some], row[some])
        for at in range(0, n, 90):
            for kind in (0, 1):
                part = np.flatnonzero(row[at : at + 90] == kind) + at
                places.add(ids[part], sim[part], kind)
        every, within = places.told()
        assert (every == ahead.sum(axis=1)).all() and (within == (ahead & (row[None, :] == row[some][:, None])).sum(axis=1)).all(), (n, k)


def test_wide_search_moves_no_scores_and_no_texts(spark, monkeypatch):
    """Beside the index, what is written doesn't grow with questions times chunks; batches that Python gets hold chunks, never lists of scores."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)]
    chunks = spark.createDataFrame([(i, "d", " ".join(rng.choices(words, k=5)), i % 3 == 0, "", "") for i in range(4000)], "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string")
    asked = spark.createDataFrame([(i, f"w{i % 30} w{i * 7 % 30}", None if i % 2 else "d") for i in range(40)], "qid long, question string, doc string")
    held, write = {}, retrieval.kept
    monkeypatch.setattr(retrieval, "kept", lambda df, name: held.setdefault(name, write(df, name)))
    monkeypatch.setattr(retrieval, "QUESTIONS", 15)
    got = retrieval.search(asked, chunks, top_k=3, wide=True)
    sizes = {name: (t.count(), max((len(x) for r in t.collect() for x in r if isinstance(x, list)), default=0)) for name, t in held.items()}
    assert "scores" not in held and "text" not in held["index"].columns
    assert all(n <= 4000 and width <= 128 for n, width in sizes.values()), sizes
    plan = retrieval.of_found(chunks.select("chunk_id", "text"), got)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    rows = lambda df: sorted(map(tuple, df.select("qid", "rank", "chunk_id", "rrf", "vec_rank", "bm25_rank", "vec_type_rank").collect()))
    assert rows(got) == rows(retrieval.search(asked, chunks, top_k=3, wide=False)) and got.count() == 120


def test_an_index_is_given_on_in_slices(monkeypatch):
    monkeypatch.setattr(retrieval, "HELD", 100)
    texts = [b"net profit", None, b"", b"x " * 200, b"profit of profit"] * 30
    batch = pa.RecordBatch.from_pydict({"chunk_id": list(range(len(texts))), "_lowered": pa.array(texts, pa.binary())})
    made = list(retrieval._counting(["chunk_id"])(iter([batch])))
    assert len(made) > 30 and all(b.num_rows == 1 or sum(len(texts[i] or b"") for i in b["chunk_id"].to_pylist()) <= 100 for b in made)
    rows = pa.Table.from_batches(made)
    whole = retrieval._counted(batch["_lowered"])
    assert rows["chunk_id"].to_pylist() == list(range(len(texts))) and all(rows[c].combine_chunks().to_pylist() == whole.field(f).to_pylist() for c, f in (("terms", "terms"), ("tfs", "tfs"), ("dl", "dl"), ("_hashed", "vector")))
