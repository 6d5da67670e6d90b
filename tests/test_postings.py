"""Stored posting lists, vectors that are none, and failures within a batch of prompts."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import retrieval, serving
from lodestone.sources import postings

SCHEMA = "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string"


def stored(spark, tmp_path, texts, buckets=16):
    chunks = retrieval.indexed(spark.createDataFrame([(i, "d", t, False, "", "") for i, t in enumerate(texts)], SCHEMA))
    postings.save(chunks, f"{tmp_path}/lists", buckets)
    return chunks, f"{tmp_path}/lists"


@pytest.mark.parametrize("named", [postings.NAMED, 1])
def test_stored_lists_score_as_the_chunks_do(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(postings, "NAMED", named)
    texts = ["net profit rose", "profit profit loss", None, "", "a notice of the branch", "loss of branch profit"] + [f"common w{i % 7} v{i}" for i in range(80)]
    chunks, path = stored(spark, tmp_path, texts)
    asked = spark.createDataFrame([(1, "profit"), (1, "profit"), (1, "w3"), (2, "common"), (2, "branch"), (3, "unheard"), (4, None)], "qid long, term string")
    rows = lambda df: sorted(map(tuple, df.select("qid", "chunk_id", "bm25").collect()))
    got = rows(postings.bm25(spark, path, asked))
    assert got == rows(retrieval.bm25(chunks, asked)) and {r[0] for r in got} == {1, 2}
    assert postings.bm25(spark, path, asked.where("false")).count() == 0


def test_only_the_buckets_of_what_is_asked_are_read(spark, tmp_path):
    _, path = stored(spark, tmp_path, [f"word{i} word{i + 1}" for i in range(300)])
    asked = spark.createDataFrame([(1, "word5")], "qid long, term string")
    plan = postings.bm25(spark, path, asked)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert len(scans) == 2 and all(re.search(r"PartitionFilters: \[[^]]*bucket#\d+ = \d+\)", x) and "EqualTo(term,word5)" in x for x in scans), plan
    held = spark.read.parquet(f"{path}/postings").groupBy("bucket").count().collect()
    assert len(held) == 16 and max(r["count"] for r in held) < 0.2 * sum(r["count"] for r in held)


def test_empty_index(spark, tmp_path):
    _, path = stored(spark, tmp_path, [])
    assert postings.bm25(spark, path, spark.createDataFrame([(1, "a")], "qid long, term string")).count() == 0


def test_vectors_that_are_none():
    vectors = [[1.0, 0.0], None, [], [1.0], [1.0, None], [np.nan, 1.0], [0.0, 0.0], [1.0, 1.0]]
    left = pa.table({"vector": pa.array(vectors, pa.list_(pa.float64()))})
    right = pa.table({"asked": pa.array([[2.0, 0.0], None, [3.0], [np.inf, 1.0], [0.0, 0.0, 1.0]], pa.list_(pa.float64()))})
    want = np.zeros((5, 8))
    want[0, 0], want[0, 7], want[2, 3] = 1.0, 0.707107, 1.0
    assert (retrieval.cosines(left, right) == want).all()


def test_one_bad_prompt_costs_the_others_nothing(spark):
    calls = []

    def generate(prompts):
        calls.append(len(prompts))
        if (prompts == "bad").any():
            raise TimeoutError("slow")
        return prompts.str.upper()

    run = serving.guarded(generate)
    good = pd.Series(["a", "b", "c", "d"], index=[3, 1, 4, 9])
    assert run(good).to_dict() == {3: "A", 1: "B", 4: "C", 9: "D"} and calls == [4]
    said = run(pd.Series(["a", "b", "bad", "d", "e"])).tolist()
    assert [s for s in said if s[0] != "\x00"] == ["A", "B", "D", "E"] and said[2] == serving.FAILED + "unavailable"
    assert run(good[:0]).empty
    got = spark.createDataFrame([("a",), ("bad",)], "p string").select("p", serving.failure(F.pandas_udf(run, "string")("p")).alias("f")).collect()
    assert {r["p"]: r["f"] for r in got} == {"a": None, "bad": "unavailable"}


ODD = ["net profit rose", "profit profit loss", None, "", "a notice of the branch", "İstanbul ÉTÉ profit", "loss of branch profit " * 50] + [f"common w{i % 7} v{i}" for i in range(80)]


def test_lists_come_from_texts_or_from_counted_chunks(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "d", t, None if i == 1 else i % 5 == 0, "", "") for i, t in enumerate(ODD)], SCHEMA)
    counted = retrieval.indexed(chunks)
    asked = spark.createDataFrame([("x", "profit"), ("x", "w3"), ("y", "common"), (None, "branch"), (None, "branch")], "qid string, term string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(retrieval.bm25(counted, asked).select("qid", "chunk_id", "bm25"))
    for name, given in (("texts", chunks), ("counted", counted)):
        path = f"{tmp_path}/{name}"
        postings.save(given, path, 4)
        assert rows(postings.bm25(spark, path, asked)) == want and {r[0] for r in want} == {"x", "y", None}
        assert rows(postings.common_terms(spark, path)) == rows(retrieval.common_terms(counted)) == [("common", 64)]
        assert postings.common_terms(spark, path, least=100).count() == 0
        stats = retrieval.corpus_stats(counted)
        assert rows(spark.read.parquet(f"{path}/corpus").select("n", "avgdl")) == rows(stats)
        assert rows(spark.read.parquet(f"{path}/terms").select("term", "df")) == rows(retrieval.idf(retrieval.postings(counted), stats).select("term", "df"))


def test_a_term_of_all_chunks_is_a_row_for_each_block(spark, tmp_path):
    _, path = stored(spark, tmp_path, [f"common v{i}" for i in range(300)])
    held = spark.read.parquet(f"{path}/postings")
    common = held.where("term = 'common'").select("block", "ids", "n", "total").collect()
    assert len(common) == held.select("block").distinct().count() < 50
    assert sorted(i for r in common for i in r["ids"]) == list(range(300)) and sum(r["n"] for r in common) == sum(r["total"] for r in common) == 300


def test_scores_are_summed_block_by_block_for_blocks_of_questions(spark, tmp_path, monkeypatch):
    chunks, path = stored(spark, tmp_path, ODD)
    asked = spark.createDataFrame([(q, t) for q in range(20) for t in ("profit", "common", f"w{q % 7}")], "qid long, term string")
    want = sorted(map(tuple, retrieval.bm25(chunks, asked).select("qid", "chunk_id", "bm25").collect()))
    for sent in (postings.SENT, 0):
        monkeypatch.setattr(postings, "SENT", sent)
        monkeypatch.setattr(retrieval, "QUESTIONS", 3)
        got = postings.bm25(spark, path, asked)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(block#\d+L?, of#", plan) and not re.search(r"hashpartitioning\([^)]*chunk_id", plan)
        assert ("BroadcastHashJoin [term" in plan) or not sent
        assert sorted(map(tuple, got.collect())) == want


def test_blocks_hold_so_many_chunks_and_postings(monkeypatch):
    monkeypatch.setattr(postings, "CHUNKS", 10)
    monkeypatch.setattr(postings, "POSTINGS", 25)
    monkeypatch.setattr(postings.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 2})()))
    texts = [" ".join(f"t{j}" for j in range(i % 8)) for i in range(90)] + [" ".join(f"u{j}" for j in range(60))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(91)), pa.array([True] * 91), pa.array([t.encode() for t in texts])], ["chunk_id", "plain", "text"])
    monkeypatch.setattr(retrieval, "HELD", 40)
    found = pa.Table.from_batches(postings._blocks(iter([batch.slice(0, 50), batch.slice(50)]))).to_pylist()
    whole = [r for r in found if r["term"] is None]
    assert sum(r["n"] for r in whole) == 91 and max(r["n"] for r in whole) <= 10 and [r["block"] - (2 << postings.SHIFT) for r in whole] == list(range(len(whole)))
    sizes = {r["block"]: sum(x["n"] for x in found if x["term"] and x["block"] == r["block"]) for r in whole}
    assert sorted(sizes.values())[-1] == 60 and sorted(sizes.values())[-2] <= 25  # a longer text fills one by itself
    made = sorted((r["term"], i, d, f) for r in found if r["term"] for i, d, f in zip(r["ids"], r["dls"], r["tfs"], strict=True))
    assert made == sorted((t, i, len(x.split()), 1) for i, x in enumerate(texts) for t in x.split())
