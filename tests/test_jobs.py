"""Both jobs: growing input, failures on the way, reruns, odd rows and command lines."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from jobs import common, evaluate_bank, ingest_pages

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(repr, df.collect()))


def page(text, lang="en"):
    return f'<html lang="{lang}"><head><title>t</title></head><body><p>{text}</p></body></html>'


def added(spark, folder, name, values, extra=False):
    """A file with pages under a given name in the folder; files that are there stay."""
    d = spark.createDataFrame(values, "page_id long, url string, html string")
    d = d.withColumn("digest", d.url) if extra else d
    d.coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    shutil.move(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")


OLD = [(1, "http://a/1", page("word " * 30)), (2, "http://a/2", page("Ein Satz. " * 5, "de")), (3, "http://a/3", page("gone soon " * 9)), (4, None, page("x y z", "zz"))]
NEW = [(5, "http://a/1", page("newer text " * 20, "fr")), (6, "http://a/3", None), (6, "http://a/3", None), (7, "http://a/4", ""), (None, None, page("no id and no url")), (8, "http://a/5", "plain " * 700)]


def test_only_new_pages_are_taken(spark, tmp_path):
    pages, out, check = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/check"
    config = ingest_pages.Config(piece_words=10)
    added(spark, pages, "one", OLD)
    assert ingest_pages.run(spark, pages, out, check, config)["pages"] == 4
    first = rows(ingest_pages.current(spark, out))
    files = {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{out}/passages") for f in names}
    assert ingest_pages.run(spark, pages, out, check, config) == {"batches": 0, "pages": 0, "passages": 0} and rows(ingest_pages.current(spark, out)) == first
    added(spark, pages, "two", NEW, extra=True)
    assert ingest_pages.run(spark, pages, out, check, config)["pages"] == len(NEW)
    later = {f: os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{out}/passages") for f in names}
    assert len(later) > len(files) and all(later[f] == t for f, t in files.items())  # nothing old is rewritten
    got = ingest_pages.current(spark, out)
    # The same as taking all at once, whatever the batches.
    once = ingest_pages.run(spark, pages, f"{tmp_path}/out2", f"{tmp_path}/check2", config)
    assert once["batches"] == 1 and rows(ingest_pages.current(spark, f"{tmp_path}/out2")) == rows(got)
    single = ingest_pages.run(spark, pages, f"{tmp_path}/out3", f"{tmp_path}/check3", ingest_pages.Config(piece_words=10, files_per_batch=1))
    assert single["batches"] == 2 and rows(ingest_pages.current(spark, f"{tmp_path}/out3")) == rows(got)
    by = {}
    for r in got.collect():
        by.setdefault(r["url"], []).append(r)
    assert {u: (len(x), sum(r["words"] for r in x), x[0]["lang"]) for u, x in by.items()} == {
        "http://a/1": (4, 40, "fr"), "http://a/2": (1, 10, "de"), "http://a/3": (1, 0, "und"), "page:4": (1, 3, "und"), "http://a/4": (1, 0, "und"), "page:": (1, 5, "en"), "http://a/5": (70, 700, "und"),
    }
    assert {r["source"] for r in by["http://a/3"]} == {"ocr"} and {r["source"] for r in by["http://a/1"]} == {"text-layer"}
    log = spark.read.json(f"{out}/log").collect()
    assert sorted((r["batch"], r["pages"]) for r in log) == [(0, 4), (1, 6)] and sorted(os.listdir(f"{out}/passages/batch=0"))[-3:] == ["lang=de", "lang=en", "lang=und"]


def test_a_batch_that_failed_is_taken_again(spark, tmp_path, monkeypatch):
    pages, out, check = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/check"
    added(spark, pages, "one", OLD)

    def broken(*_):
        raise RuntimeError("lost after writing")

    with monkeypatch.context() as m:
        m.setattr(ingest_pages.log, "info", broken)
        with pytest.raises(Exception, match="lost after writing"):
            ingest_pages.run(spark, pages, out, check)
    assert spark.read.parquet(f"{out}/passages").count() == 4  # written, but not committed
    assert ingest_pages.run(spark, pages, out, check)["pages"] == 4
    assert spark.read.parquet(f"{out}/passages").count() == 4 and ingest_pages.current(spark, out).count() == 4


def test_empty_pages(spark, tmp_path):
    added(spark, f"{tmp_path}/pages", "none", [])
    ingest_pages.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/check")
    assert ingest_pages.current(spark, f"{tmp_path}/out").count() == 0


def bank(spark, path, docs, questions):
    spark.createDataFrame(docs, "doc_id long, text string, source string, rank int").write.parquet(f"{path}/docs")
    spark.createDataFrame(questions, "item_id long, text string").write.parquet(f"{path}/bank")
    return f"{path}/docs", f"{path}/bank", f"{path}/out"


def test_bank_is_judged(spark, tmp_path):
    docs = [(i, t, f"s{i % 2}", 0) for i, t in enumerate(["the herons nest by the pond each spring and leave in autumn", "bread is sold at noon in the old mill", None, "the mill closed in march", ""])]
    paths = bank(spark, tmp_path, docs, [(1, "herons nest by the pond in winter only"), (2, "bread is sold at noon"), (3, None), (4, "zzz")])
    config = evaluate_bank.Config(top_k=2, needle_chars=20)
    log = evaluate_bank.run(spark, *paths, config)
    first = rows(evaluate_bank.output(spark, paths[2]))
    assert evaluate_bank.run(spark, *paths, config) == log
    got = evaluate_bank.output(spark, paths[2])
    assert rows(got) == first
    assert log == {"documents": 5, "questions": 4, "hits": 8, "passed": 2, "complete": 1}
    assert {(r["qid"], r["verdict"], r["first_rank"]) for r in got.collect()} == {(1, "some", 1), (2, "all", 1), (3, "none", None), (4, "none", None)}
    # A hit counts as many needles as it holds.
    assert {r["chunk_id"]: r["needles"] for r in got.where("qid = 2").collect()}[1] == 2
    assert spark.read.json(f"{paths[2]}/log").first()["hits"] == 8


def test_bank_without_documents_and_bad_ids(spark, tmp_path):
    paths = bank(spark, f"{tmp_path}/a", [], [(1, "herons")])
    assert evaluate_bank.run(spark, *paths)["hits"] == 0
    assert [tuple(r) for r in evaluate_bank.output(spark, paths[2]).select("qid", "rank", "verdict").collect()] == [(1, None, "none")]
    for n, (docs, asked) in enumerate([([(1, "a", "s", 0)] * 2, [(1, "a")]), ([(1, "a", "s", 0)], [(None, "a")])]):
        with pytest.raises(ValueError, match="null or repeated"):
            evaluate_bank.run(spark, *bank(spark, f"{tmp_path}/b{n}", docs, asked))


def test_configurations():
    for name, kind in (("ingest_pages", ingest_pages.Config), ("evaluate_bank", evaluate_bank.Config)):
        with open(f"{ROOT}/jobs/{name}.json") as f:
            assert common.configured(kind, f.read()) == kind()
    with pytest.raises(ValueError, match="no setting"):
        common.configured(ingest_pages.Config, '{"pieces": 3}')
    with pytest.raises(ValueError, match="must be like"):
        common.configured(ingest_pages.Config, '{"piece_words": "3"}')


def test_command_line(spark, tmp_path):
    added(spark, f"{tmp_path}/pages", "one", OLD)
    (tmp_path / "c.json").write_text('{"piece_words": 7}')
    env = os.environ | {"PYTHONPATH": ROOT}
    call = [sys.executable, "-m", "jobs.ingest_pages", f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/check", "--config", f"{tmp_path}/c.json"]
    said = [json.loads(subprocess.run(call, env=env, cwd=ROOT, capture_output=True, text=True, timeout=240, check=True).stdout.strip().splitlines()[-1]) for _ in range(2)]
    assert [s["pages"] for s in said] == [4, 0] and said[0]["passages"] == 11


def test_documents_are_read_once_for_hits_and_verdicts(spark, tmp_path, monkeypatch):
    """Verdicts come from the hits that were written; each run finds and reads texts once."""
    paths = bank(spark, tmp_path, [(i, f"the old mill {i}", "a", 0) for i in range(60)], [(1, "the old mill 7"), (2, "the new mill")])
    held, write = [], evaluate_bank.kept
    monkeypatch.setattr(evaluate_bank, "kept", lambda df, name: held.append(write(df, name)) or held[-1])
    assert evaluate_bank.run(spark, *paths)["questions"] == 2
    made = evaluate_bank.judged_hits(spark.createDataFrame([(1, "the old mill 7")], "qid long, question string"), spark.read.parquet(paths[0]).selectExpr("doc_id AS chunk_id", "source AS doc", "text", "true AS is_row", "'' AS fiscal_period", "'' AS statement_type"))
    assert len(held) == 2 and all(t.columns == ["qid", "needle", "rank"] for t in held)
    files = {f for f in made.inputFiles() if "documents" in f or f"{paths[0]}" in f}
    assert not files, files
