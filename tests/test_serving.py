"""Serving by batches against a request-by-request walk, and its small parts."""

import math
import random
from collections import OrderedDict, deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.operators import admission, answers, retrieval, serving
from lodestone.sources import index
from lodestone.sources import pages as sources


def outcomes(rows, presets, known, s, per_key, key_window, overall, overall_window):
    """One request after the other: rate limit, presets, documents, cache, first gate, quota, answer, and only then the cache is filled."""
    rate, cache, own, all_, out = {}, OrderedDict(), {}, deque(), {}

    def fresh(times, t, w):
        while times and times[0] <= t - w:
            times.popleft()
        return times

    for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
        q, t = " ".join(r["question"].lower().split()), r["at"]
        times = fresh(rate.setdefault(r["key"], deque()), t, 60.0)
        if len(times) >= s.rate_limit_per_minute:
            out[r["event_id"]] = ("rate limit", max(1, math.ceil(times[0] + 60 - t)))
            continue
        times.append(t)
        if r["doc"] is None and q in presets:
            out[r["event_id"]] = ("preset", None)
        elif known and r["doc"] is not None and r["doc"] not in known:
            out[r["event_id"]] = ("unknown document", None)
        elif (q, r["doc"]) in cache:
            cache.move_to_end((q, r["doc"]))
            out[r["event_id"]] = ("cache", None)
        elif not r["passed"]:
            out[r["event_id"]] = ("gate 1", None)
        else:
            mine = fresh(own.setdefault(r["key"], deque()), t, key_window)
            if len(fresh(all_, t, overall_window)) >= overall:
                out[r["event_id"]] = ("quota", max(1, math.ceil(all_[0] + overall_window - t)))
            elif len(mine) >= per_key:
                out[r["event_id"]] = ("quota", max(1, math.ceil(mine[0] + key_window - t)))
            else:
                mine.append(t)
                all_.append(t)
                out[r["event_id"]] = ("gate 2" if r["refused"] else "live", None)
                if not r["refused"] and s.cache_size:
                    cache[q, r["doc"]] = True
                    while len(cache) > s.cache_size:
                        cache.popitem(last=False)
    return out


SCHEMA = "key long, event_id long, at double, question string, doc string, passed boolean, refused boolean"


def decided(spark, rows, known, *limits, slices=None):
    frame = spark.createDataFrame(pd.DataFrame(rows).astype({"doc": object}).to_dict("records"), SCHEMA)
    presets, documents = spark.createDataFrame([("p", "a q1")], "preset string, question string"), spark.createDataFrame([(k,) for k in known], "doc string")
    return {r["event_id"]: r for r in serving.decided(frame, presets, documents, *limits, slices=slices).collect()}


@pytest.mark.parametrize("seed,slices,known,cache", [(0, 1, {"d0"}, 5), (1, 7, {"d0"}, 5), (2, 7, set(), 3), (3, 20, {"d0"}, 0)])
def test_order_of_decisions(spark, seed, slices, known, cache):
    rng = random.Random(seed)
    # Identifiers are dealt at random, so that their order is not that of the times.
    ids = rng.sample(range(1000), 300)
    rows = [{"key": rng.randrange(4), "event_id": i, "at": n * 3.0 + rng.random(), "question": f"{rng.choice('AaB')}  q{rng.randrange(12)}", "doc": rng.choice([None, None, "d0", "x"]), "passed": rng.random() < 0.8, "refused": rng.random() < 0.3} for n, i in enumerate(ids)]
    s = Settings(rate_limit_per_minute=4, cache_size=cache)
    got = decided(spark, rows, known, s, 3, 60.0, 6, 100.0, slices=slices)
    assert {i: (r["outcome"], r["retry_after"]) for i, r in got.items()} == outcomes(rows, {"a q1"}, known, s, 3, 60.0, 6, 100.0)
    assert all(r["status"] == {"rate limit": 429, "quota": 429, "unknown document": 404}.get(r["outcome"], 200) and (r["retry_after"] is not None) == (r["status"] == 429) for r in got.values())


def test_a_refused_question_is_not_kept(spark):
    rows = [{"key": 1, "event_id": n, "at": float(n), "question": q, "doc": None, "passed": True, "refused": False} for n, q in enumerate("abbba")]
    got = decided(spark, rows, {"d0"}, Settings(), 1, 3600.0, 800, 86400.0)
    assert [got[n]["outcome"] for n in range(5)] == ["live", "quota", "quota", "quota", "cache"]


def walk(rows, per_key, key_window, overall, overall_window):
    own, all_, out = {}, deque(), {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        for times, w in ((all_, overall_window), (own.setdefault(k, deque()), key_window)):
            while times and times[0] <= t - w:
                times.popleft()
        if len(all_) >= overall:
            out[i] = ("overall", max(1, math.ceil(all_[0] + overall_window - t)))
        elif len(own[k]) >= per_key:
            out[i] = ("key", max(1, math.ceil(own[k][0] + key_window - t) if own[k] else math.ceil(key_window)))
        else:
            out[i] = ("ok", 0)
            own[k].append(t)
            all_.append(t)
    return out


@pytest.mark.parametrize("limits", [(4, 30.0, 9, 60.0), (4, 30.0, 900, 60.0), (1, 400.0, 2, 500.0), (0, 30.0, 9, 60.0)])
def test_quota_of_a_busy_log_is_walked_in_slices(spark, limits):
    # No quiet stretch anywhere, and limits that are met all the time, at times, or for longer than a slice.
    rng = random.Random(3)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.random() * 4
        rows.append((rng.choice([0, 0, 0, 1, 2, None]), 600 - i, t))
    frame = spark.createDataFrame(rows, "key long, event_id long, at double")
    want = walk(rows, *limits)
    for slices in (1, 12):
        got = {r["event_id"]: (r["verdict"], r["retry_after"]) for r in admission.charged(frame, *limits, slices=slices).collect()}
        assert got == want


def test_no_task_holds_a_hot_key(spark):
    # One key with nearly all requests, refused most of the time: its rows are walked in many slices, each by itself, and not all of them in every round.
    from lodestone.operators import walks

    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(4000):
        t += rng.random() * 4
        rows.append((7 if rng.random() < 0.95 else i, i, t))
    frame = spark.createDataFrame(rows, "key long, event_id long, at double").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def step(held, row):
        seen.add(1)
        wait = held.wait(row[2])
        if not wait:
            held.add(row[2])
        return row[1], not wait

    def load(times):
        held = admission.Held(6, 40.0)
        held.times = deque(times)
        return held

    table = walks.walked(frame, "key", ["at", "event_id"], walks.Walk(lambda: admission.Held(6, 40.0), step, lambda h: list(h.times), load), "event_id long, admitted boolean", 40)
    got = {r["event_id"]: r["admitted"] for r in table.collect()}
    by = {}
    for k, i, t in rows:
        by.setdefault(k, []).append((t, i))
    want = {i: a for own in by.values() for (t, i), (a, _) in zip(sorted(own), admission.walk([t for t, _ in sorted(own)], 6, 40.0), strict=True)}
    assert got == want and 4000 < seen.value < 40 * 4000 / 2
    assert {r["event_id"]: r["admitted"] for r in admission.limited(frame, 6, 40.0, slices=40).collect()} == want


@pytest.mark.parametrize("size", [0, 3, 50])
def test_one_cache_for_all_in_slices(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([1, 1, 1, None, 2]), i, f"k{rng.randrange(5) if rng.random() < 0.6 else rng.randrange(60)}", rng.random() < 0.2, i // 400) for i in range(1500)]
    frame = spark.createDataFrame(rows, "user long, event_id long, key string, refused boolean, generation long")
    caches, want = {}, {}
    for u, i, k, refused, g in rows:
        cache = caches.setdefault(u, OrderedDict())
        want[i] = (g, k) in cache
        if want[i]:
            cache.move_to_end((g, k))
        elif not refused and size:
            cache[g, k] = True
            if len(cache) > size:
                cache.popitem(last=False)
    assert {r["event_id"]: r["hit"] for r in admission.cache_hits(frame, size, slices=25).collect()} == want


def test_walks_of_empty_logs(spark):
    none = spark.createDataFrame([], "key long, event_id long, at double")
    assert admission.charged(none, 1, 1.0, 1, 1.0).count() == 0 and admission.limited(none, 3, slices=5).count() == 0
    assert admission.limited(spark.createDataFrame([(1, 1, 0.0)] * 3, none.schema), 0).where("admitted").count() == 3


def test_refusals_and_old_answers_are_not_kept(spark):
    rows = [(1, 1, "a", True, 1), (1, 2, "a", False, 1), (1, 3, "a", False, 1), (1, 4, "a", False, 2), (1, 5, "a", False, 2)]
    got = {r["event_id"]: r["hit"] for r in admission.cache_hits(spark.createDataFrame(rows, "user long, event_id long, key string, refused boolean, generation long"), 3).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: True}


class RateLimitError(Exception):
    status_code = 429

    class response:  # noqa: N801
        status_code, headers = 429, {"retry-after": "7.0"}


def test_errors(spark):
    assert serving.translated(RateLimitError("key abc"), "abc") == {"kind": "rate limit", "retry_after": 7, "detail": "RateLimitError: key ***"}
    assert serving.translated(TimeoutError("x"))["kind"] == "unavailable" and serving.translated(ValueError("x"))["kind"] == "failed"

    def broken(prompts):
        raise ConnectionError("down")

    raw = serving.guarded(broken)(pd.Series(["a", "b"])).tolist()
    found = spark.createDataFrame([(r,) for r in [*raw, '{"answer": "x"}']], "raw string").select(serving.failure(F.col("raw")).alias("f"), serving.message(serving.failure(F.col("raw"))).alias("m")).collect()
    assert [r["f"] for r in found] == ["unavailable", "unavailable", None] and found[2]["m"] is None
    assert [serving.has_key(k) for k in (None, " ", "your_key", "sk-1")] == [False, False, False, True]
    assert serving.described("x ", 400) == "x" and serving.described([{"msg": "too long"}, "b"], 422) == "too long; b" and "500" in serving.described(None, 500)


def _chunks(spark):
    rows = [(i, "d1" if i < 2 else "d2", i + 1, t, False, "", "", "prose", i, "") for i, t in enumerate(["the mill closed in march", "herons nest by the pond", "the bridge was mended", "bread is sold at noon"])]
    return spark.createDataFrame(rows, "chunk_id long, doc string, page int, text string, is_row boolean, fiscal_period string, statement_type string, chunk_type string, chunk_index int, doc_label string")


def test_presets_results_and_health(spark, tmp_path):
    chunks, path = _chunks(spark), f"{tmp_path}/presets"
    assert serving.load_presets(spark, path) is None
    presets = spark.createDataFrame([("a", "where do herons nest"), ("b", "when is bread sold")], "preset string, question string")
    made = serving.build_presets(presets, chunks, path, Settings(min_similarity=0.05))
    assert sorted(r["preset"] for r in made.collect()) == ["a", "b"]
    assert serving.load_presets(spark, path, chunks).count() == 2 and serving.load_presets(spark, path, chunks.limit(2)) is None
    said = spark.createDataFrame([(1, "1,000 herons", False), (2, "", True), (3, "wrong", False)], "qid long, answer string, refused boolean")
    expected = spark.createDataFrame([(1, "answer", ["1000"]), (2, "decline", None), (3, "answer", ["x"]), (4, "answer", None)], "qid long, expected string, must array<string>")
    judged = serving.judged_answers(said, expected)
    assert {r["qid"]: r["verdict"] for r in judged.collect()} == {1: "PASS", 2: "PASS", 3: "WRONG", 4: None}
    assert serving.save_results(judged, f"{tmp_path}/results") == {"pass": 2, "wrong": 1, "fail": 0}
    assert serving.health(spark, f"{tmp_path}/index")["status"] == "no index"
    index.save(retrieval.indexed(chunks), f"{tmp_path}/index")
    assert serving.health(spark, f"{tmp_path}/index", "sk")["indexed_chunks"] == 4 and serving.documents(spark, f"{tmp_path}/index").count() == 2
    out = serving.respond(spark.createDataFrame([(1, "where do herons nest")], "qid long, question string"), index.load(spark, f"{tmp_path}/index", 128), Settings(min_similarity=0.05)).first()
    assert not out["refused"] and out["sources"]
    line = spark.createDataFrame([out]).select(answers.copied(F.col("answer"), F.col("sources")).alias("c")).first()["c"]
    assert line.startswith(out["answer"]) and "- d" in line


def test_search_equals_its_parts(spark):
    # The fast path in arrays against the same ranking composed of windows, with periods, kinds, rows and a document filter.
    rng = random.Random(5)
    words = "mill pond heron bridge bread orders price total returned march".split()
    rows = [(i, f"d{i % 3}", " ".join(rng.choices(words, k=rng.randint(0, 12))), i % 2 == 0, rng.choice(["", "March 31, 2026", "June 30, 2025", "March 31, 2025"]), rng.choice(["", "standalone", "consolidated"])) for i in range(120)]
    chunks = retrieval.indexed(spark.createDataFrame(rows, "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string"))
    asked = [(1, "total price", None), (2, "standalone orders FY2026", "d1"), (3, "heron pond in June 2025", None), (4, "zzz", None), (5, "the group's bread", "none")]
    questions = spark.createDataFrame(asked, "qid long, question string, doc string")
    s = Settings(row_weight=0.9)
    columns = ["qid", "chunk_id", "similarity", "bm25", "vec_rank", "bm25_rank", "vec_type_rank", "bm25_type_rank", "rrf", "rank"]
    slow = retrieval.top(retrieval.fused(retrieval.bonuses(retrieval.ranks(retrieval.candidates(questions, chunks, s)), s), s), "rrf", 8).select(*columns)
    fast = retrieval.search(questions, chunks, s).select(*columns)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect())) and fast.where("qid = 5").count() == 0
    near = retrieval.search(questions, chunks, Settings(use_hybrid=False)).select("qid", "chunk_id", "rank").collect()
    want = retrieval.top(retrieval.candidates(questions, chunks, s), "similarity", 8).select("qid", "chunk_id", "rank").collect()
    assert sorted(map(tuple, near)) == sorted(map(tuple, want))


def test_models_get_their_prefix(spark):
    def embed(texts):
        return [[float(t.startswith("Q: ")), 1.0] for t in texts]

    chunks = retrieval.indexed(_chunks(spark), embed)
    questions = spark.createDataFrame([(1, "herons")], "qid long, question string")
    found = retrieval.search(questions, chunks, Settings(query_prefix="Q: "), embed=embed)
    assert {round(r["similarity"], 4) for r in found.collect()} == {0.7071}


def test_references_in_pages(spark):
    text = "a &amp;lt; b &#39;c&#x27; &nbsp;&copy; 2020 &unknown; &#0; &#55296; &amp; &mdash;&#128512;"
    got = spark.createDataFrame([(text,)], "t string").select(sources.unescaped(F.col("t")).alias("u")).first()["u"]
    assert got == "a &lt; b 'c'  © 2020 &unknown; &#0; &#55296; & —😀"


def test_commands(spark, tmp_path, capsys):
    from lodestone.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The herons nest by the pond each spring, as they have for years.\x0cBread is sold at noon in the old mill by the river.")
    (tmp_path / "none").mkdir()
    assert main(["ingest", f"{tmp_path}/none", f"{tmp_path}/index"]) == 1
    assert main(["ingest", f"{tmp_path}/in", f"{tmp_path}/index", "--stats"]) == 0 and index.size(spark, f"{tmp_path}/index") == 0
    assert main(["ingest", f"{tmp_path}/in", f"{tmp_path}/index"]) == 0 and index.size(spark, f"{tmp_path}/index") == 2
    assert main(["ask", f"{tmp_path}/index", "where do herons nest by the pond", "--doc", "a.txt"]) == 0 and "a.txt, page 1" in capsys.readouterr().out
    assert main(["ask", f"{tmp_path}/index", "where do herons nest by the pond", "--k", "1", "--no-hybrid", "--full"]) == 0 and "each spring" in capsys.readouterr().out
    spark.createDataFrame([("p1", "where do herons nest by the pond")], "preset string, question string").write.json(f"{tmp_path}/p")
    assert main(["presets", f"{tmp_path}/index", f"{tmp_path}/p", f"{tmp_path}/kept"]) == 0 and "1 presets" in capsys.readouterr().out
    # The stand-in for a model repeats a passage's first line, its label.
    spark.createDataFrame([(1, "where do herons nest by the pond", "answer", ["results"], ["herons nest"], False), (2, "zzz", "decline", None, ["zzz"], True)], "qid long, question string, expected string, must array<string>, needles array<string>, decline boolean").write.json(f"{tmp_path}/q")
    assert main(["batch", f"{tmp_path}/index", f"{tmp_path}/q", f"{tmp_path}/out"]) == 0 and "'pass': 2" in capsys.readouterr().out
    assert main(["harness", f"{tmp_path}/index", f"{tmp_path}/q"]) == 0 and "1.0" in capsys.readouterr().out


def test_reranking_model_and_evaluation_summary(spark, tmp_path):
    # A model that likes bread only puts it first.
    found = retrieval.search(spark.createDataFrame([(1, "herons by the pond")], "qid long, question string"), _chunks(spark), Settings(use_reranker=True), score=lambda q, t: t.str.contains("bread").astype("float64") * 9)
    plain = retrieval.search(spark.createDataFrame([(1, "herons by the pond")], "qid long, question string"), _chunks(spark), Settings(use_reranker=True))
    by = lambda df: {r["chunk_id"]: r["model"] for r in df.collect()}
    assert by(found)[3] == 9.0 and by(plain)[3] < 1
    (tmp_path / "evals.json").write_text('{"headline": "x", "eval10": {"title": "t", "rows": [{"label": "a", "value": "1"}]},\n "ablation": {"rank_shifts": [{"q": "q", "off": 2, "on": 4}]}}')
    row = serving.load_evals(spark, f"{tmp_path}/evals.json").first()
    assert row["headline"] == "x" and row["eval10"]["rows"][0]["value"] == "1" and row["ablation"]["rank_shifts"][0]["on"] == 4
    (tmp_path / "other.json").write_text('{"a": 1}')
    assert serving.load_evals(spark, f"{tmp_path}/none.json") is None and serving.load_evals(spark, f"{tmp_path}/other.json") is None


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_needles_over_a_corpus(spark, block_bytes):
    from lodestone.operators import evaluation

    rng = random.Random(6)
    texts = ["".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "A  b"]
    needles = ["a b", "AB", "b  c", "", " ", "aa", "cab", "ab", None] + ["".join(rng.choice("abc ") for _ in range(4)) for _ in range(20)]
    plain = lambda t: " ".join((t or "").lower().split())
    want = sorted({(i, n) for i, t in enumerate(texts) for n in map(plain, needles) if n and n in plain(t)})
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(n,) for n in needles], "needle string")
    assert sorted(map(tuple, evaluation.corpus_hits(docs, asked, block_bytes).collect())) == want
    assert evaluation.corpus_hits(docs, asked.limit(0)).count() == 0
