"""Operators against fixtures and brute force."""

import contextlib
import json
import math
import random
import time
from collections import OrderedDict, deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import periods as P
from lodestone.functions import text as T
from lodestone.operators import admission, answers, evaluation, pages, retrieval
from lodestone.sources import index
from lodestone.sources import pages as sources


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("v")).first()["v"]


def scanned(tokens):
    """Rows by one pass from left to right, as the rules are stated."""
    import re

    num = lambda t: re.match(T.NUMBER, t)
    hole = lambda t: t.lower() in T.PLACEHOLDERS
    rows, label, i = [], [], 0
    while i < len(tokens):
        if num(tokens[i]):
            j = next((k for k in range(i, len(tokens)) if not num(tokens[k]) and not hole(tokens[k])), len(tokens))
            run = tokens[i:j]
            if sum(map(bool, map(num, run))) < 3:
                label += run
            else:
                if j < len(tokens) and len(run) > 3 and re.match(T.ROW_NUMBER, run[-1]):
                    j, run = j - 1, run[:-1]
                if not all(re.match(T.DATE, t) for t in run if num(t)):
                    rows.append((label[-40:], run))
                label = []
            i = j
            continue
        j = next((k for k in range(i, len(tokens)) if not hole(tokens[k])), len(tokens))
        if j - i >= 3:
            rows.append((label[-40:], tokens[i:j]))
            label, i = [], j
        else:
            label.append(tokens[i])
            i += 1
    return rows


def test_rows_equal_a_scan(spark):
    rng = random.Random(4)
    words = ["net", "profit", "12", "7", "1,234.5", "(99)", "3.1%", "nil", "-", "31.03.2026", "30.09.2025", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["label " * 200 + "1 2 3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got: dict = {}
    for r in pages.table_rows(docs, ["doc"]).orderBy("doc", "row").collect():
        got.setdefault(r["doc"], []).append((r["label"], r["vals"]))
    for i, t in enumerate(texts):
        assert got.get(i, []) == scanned(t.split()), t


@pytest.mark.parametrize(
    ("header", "n", "labels"),
    [
        ("Quarter ended Year ended", 5, ["Quarter ended March 31, 2026", "Quarter ended December 31, 2025", "Quarter ended March 31, 2025", "Year ended March 31, 2026", "Year ended March 31, 2025"]),
        ("Quarterended", 3, ["Quarter ended March 31, 2026", "Quarter ended December 31, 2025", "Quarter ended March 31, 2025"]),
        ("Quarter ended", 4, None),
        ("nothing", 3, None),
        (None, 3, None),
    ],
)
def test_column_labels(spark, header, n, labels):
    c = P.column_labels(F.lit(header).cast("string"), F.lit(n), F.lit("March 31, 2026"))
    assert one(spark, c) == labels
    assert one(spark, P.column_labels(F.lit("Quarter ended"), F.lit(3), F.lit("soon"))) is None


def test_period_helpers(spark):
    assert one(spark, P.period_key(F.lit("as of march 31 2026"))) == 20260331 and one(spark, P.period_key(F.lit(""))) == 0
    assert one(spark, P.shift_period(F.lit("March 31, 2026"), 1)) == "February 28, 2026"
    assert one(spark, P.shift_period(F.lit("February 10, 2024"), 0)) == "February 29, 2024"
    got = one(spark, P.query_periods(F.lit("net profit (as of FY2026) please")))
    assert got["periods"] == [20260331] and got["rest"] == "net profit (as of ) please"
    assert [one(spark, P.names_period(F.lit(q))) for q in ("in 2026", "dismayed", "FY2026", "none")] == [True, True, False, False]


def test_clean_and_noise(spark):
    text = "aB joined\n#$%^ a\n\n\n\nkept line  \n\t\nend"
    assert one(spark, T.cleaned(F.lit(text))) == "a B joined\n\nkept line\n\nend"


def test_metadata_is_filled(spark):
    head = "{} FINANCIAL RESULTS FOR THE QUARTER ENDED {}"
    rows = [("d", 1, "notes"), ("d", 2, head.format("STANDALONE", "MARCH 31, 2026")), ("d", 3, "more"), ("d", 4, head.format("CONSOLIDATED", "JUNE 30, 2026")), ("e", 1, "plain")]
    got = {(r["doc"], r["page"]): (r["statement_type"], r["fiscal_period"], r["doc_label"]) for r in pages.tagged(spark.createDataFrame(rows, "doc string, page long, text string")).collect()}
    assert got["d", 1][0] == got["d", 3][0] == "standalone" and got["d", 4][0] == "consolidated"
    assert got["d", 1][1] == "March 31, 2026" and got["d", 4][2] == "Consolidated Results — March 31, 2026"  # a tie goes to the earlier page
    assert got["e", 1] == ("", "", "Results")


@pytest.mark.parametrize("n", [10, 500, 2000])
def test_packing_loses_nothing(spark, n):
    words = [f"w{i}" for i in range(n)]
    text = "\n\n".join(" ".join(words[i : i + 130]) for i in range(0, n, 130))
    out = one(spark, pages.packed(F.lit(text)))
    assert {w for c in out for w in c.split()} == set(words) and all(len(c.split()) <= 350 + 150 for c in out)
    assert one(spark, pages.packed(F.lit(" ".join(words)))) == [" ".join(words[i : i + 350]) for i in range(0, n, 350)]


def test_limiter(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.uniform(0, 300)) for i, k in enumerate(rng.choices(range(4), k=300))]
    got = {r["event_id"]: (r["admitted"], r["retry_after"]) for r in admission.limited(spark.createDataFrame(rows, "key long, event_id long, at double"), 5, 60.0).collect()}
    for k in range(4):
        held = deque()
        for _, i, t in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            while held and t - held[0] >= 60:
                held.popleft()
            ok = len(held) < 5
            assert got[i] == (ok, 0 if ok else max(1, math.ceil(held[0] + 60 - t)))
            if ok:
                held.append(t)
    assert all(a for a, _ in admission.walk([1.0] * 50, 0, 60))


def test_quota(spark):
    rows = [(1, 0, 0.0), (1, 1, 1.0), (2, 2, 2.0), (3, 3, 3.0)]
    out = {r["event_id"]: r["verdict"] for r in admission.charged(spark.createDataFrame(rows, "key long, event_id long, at double"), 1, 3600.0, 2, 86400.0).collect()}
    assert out == {0: "ok", 1: "key", 2: "ok", 3: "overall"}


@pytest.mark.parametrize("size", [0, 1, 3])
def test_cache(spark, size):
    rng = random.Random(size)
    rows = [(u, i, rng.choice("abcdef")) for i, u in enumerate(rng.choices(range(3), k=200))]
    got = {r["event_id"]: r["hit"] for r in admission.cache_hits(spark.createDataFrame(rows, "user long, event_id long, key string"), size).collect()}
    for u in range(3):
        kept: OrderedDict = OrderedDict()
        for _, i, k in (r for r in rows if r[0] == u):
            assert got[i] == (k in kept)
            kept[k] = True
            kept.move_to_end(k)
            while len(kept) > size:
                kept.popitem(last=False)


def test_streaming_limit_equals_batch(spark, tmp_path):
    from lodestone.streaming.limits import limited

    rng = random.Random(9)
    rows = pd.DataFrame([(k, i, float(i)) for i, k in enumerate(rng.choices(range(3), k=120))], columns=["key", "event_id", "at"])
    for n in range(2):
        spark.createDataFrame(rows.iloc[n * 60 : n * 60 + 60]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key long, event_id long, at double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = limited(stream, 5, 30.0).writeStream.format("memory").queryName("admitted").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").start()
    # A query whose state can time out never runs out of batches, so that its rows are waited for.
    end = time.time() + 90
    while time.time() < end and spark.sql("SELECT count(*) AS n FROM admitted").first()["n"] < len(rows):
        time.sleep(0.5)
    q.stop()
    got = {r["event_id"]: r["admitted"] for r in spark.sql("SELECT * FROM admitted").collect()}
    assert got == {r["event_id"]: r["admitted"] for r in admission.limited(spark.createDataFrame(rows), 5, 30.0).collect()}


def _small(spark):
    texts = ["net profit rose", "capital adequacy ratio", "branch notice in dubai", "net interest income"]
    chunks = spark.createDataFrame([(i, f"d{i % 2}", t, i % 2 == 1, "March 31, 2026" if i < 2 else "June 30, 2025", "standalone") for i, t in enumerate(texts)], "chunk_id long, doc string, text string, is_row boolean, fiscal_period string, statement_type string")
    return chunks, spark.createDataFrame([(1, "what is the capital adequacy"), (2, "zzz qqq")], "qid long, question string")


def test_search_and_answers(spark, tmp_path):
    chunks, questions = _small(spark)
    found = retrieval.search(questions, chunks, Settings(), 3)
    # Rows and other passages are ranked apart: the only match leads the rows, level with the first of the others.
    best = [(r["chunk_id"], r["rrf"]) for r in found.where("qid = 1").orderBy("rank").collect()]
    assert [c for c, _ in best[:2]] == [0, 1] and best[0][1] == best[1][1]
    facts = chunks.select("chunk_id", "text", F.lit(1).alias("page"), F.col("chunk_id").alias("chunk_index"), F.lit("prose").alias("chunk_type"), F.lit("").alias("doc_label"))
    seen = f"{tmp_path}/calls"

    def generate(prompts: pd.Series) -> pd.Series:
        with open(seen, "a") as f:
            f.write("x" * len(prompts))
        return prompts.map(lambda p: json.dumps({"not_covered": False, "answer": "16%", "used_passages": [99]}))

    out = {r["qid"]: r for r in answers.ask(found.join(facts, "chunk_id"), questions, generate=generate).collect()}
    assert out[1]["answer"] == "16%" and [x["snippet"] for x in out[1]["sources"]] == ["capital adequacy ratio"]  # none of its numbers exist
    assert out[2]["refused"] and out[2]["sources"] is None and open(seen).read() == "x"


def test_doc_filter_leaves_statistics_alone(spark):
    chunks, questions = _small(spark)
    every = {(r["qid"], r["chunk_id"]): r["bm25"] for r in retrieval.search(questions, chunks, top_k=4).collect()}
    some = retrieval.search(questions.withColumn("doc", F.lit("d1")), chunks, top_k=4).collect()
    assert {r["chunk_id"] for r in some} == {1, 3} and all(every[r["qid"], r["chunk_id"]] == r["bm25"] for r in some)
    assert retrieval.search(questions.withColumn("doc", F.lit("none")), chunks).count() == 0


def test_index(spark, tmp_path):
    chunks, _ = _small(spark)
    with pytest.raises(index.IndexNotBuilt):
        index.load(spark, f"{tmp_path}/i")
    assert index.size(spark, f"{tmp_path}/i") == 0 and index.generation(spark, f"{tmp_path}/i") == 0
    assert index.save(chunks, f"{tmp_path}/i") == 4 and index.save(chunks.limit(2), f"{tmp_path}/i") == 2
    with pytest.raises(ValueError, match="nothing"):
        index.save(chunks.limit(0), f"{tmp_path}/i")
    assert index.size(spark, f"{tmp_path}/i") == 2 and index.generation(spark, f"{tmp_path}/i") == 2
    a, b = index.fingerprint(chunks).first(), index.fingerprint(chunks.orderBy(F.desc("chunk_id"))).first()
    assert a == b != index.fingerprint(chunks.limit(3)).first()


def test_files_with_a_bad_one(spark, tmp_path):
    long = "a page with a text layer that is long enough to be read as it is"
    for name, data in (("a.pdf", f"one\x0c{long}\x0c".encode()), ("b.pdf", b"bad"), ("c.txt", b"no"), ("d.pdf", long.encode())):
        (tmp_path / name).write_bytes(data)

    def parse(name, data):
        if data == b"bad":
            raise ValueError("broken")
        return sources.plain_text(name, data)

    @contextlib.contextmanager
    def recognise(name, data):
        with open(f"{tmp_path}/opened", "a") as f:
            f.write(name)
        yield lambda n: "seen text" if n == 1 else " "
        with open(f"{tmp_path}/opened", "a") as f:
            f.write(" closed ")

    rows = sources.corpus(spark, str(tmp_path), parse, recognise).collect()
    assert {(r["doc"], r["page"], r["text"], r["source"]) for r in rows} == {("a.pdf", 1, "seen text", "ocr"), ("a.pdf", 2, long, "text-layer"), ("d.pdf", 1, long, "text-layer")}
    assert open(f"{tmp_path}/opened").read() == "a.pdf closed "  # once, for the file that needs it
    assert [r["doc"] for r in sources.from_files(spark, str(tmp_path), parse).where("error is not null").collect()] == ["b.pdf"]
    with pytest.raises(FileNotFoundError):
        sources.corpus(spark, str(tmp_path), parse, pattern="*.doc")
    with pytest.raises(RuntimeError):
        sources.corpus(spark, str(tmp_path), parse, pattern="b.pdf")


def test_long_texts_are_cut_in_linear_time(spark):
    took = []
    for n in (20_000, 160_000):
        d = spark.createDataFrame([("word " * n,)], "t string")
        began = time.time()
        assert d.select(F.size(T.word_pieces(F.col("t"), 350)).alias("n")).first()["n"] == -(-n // 350)
        took.append(time.time() - began)
    assert took[1] < 20 * max(took[0], 0.2)


def test_settings():
    assert Settings.from_env({"TOP_K": "3", "USE_HYBRID": "no", "CHUNK_MAX_TOKENS": "9"}) == Settings(top_k=3, use_hybrid=False)
    with pytest.raises(ValueError, match="TOP_K"):
        Settings.from_env({"TOP_K": "x"})


def test_evaluation(spark):
    found = spark.createDataFrame([(1, 1, "Net  Profit rose"), (1, 2, "other"), (2, 1, "none")], "qid long, rank long, text string")
    needles = spark.createDataFrame([(1, "net profit"), (1, "missing"), (2, "x y")], "qid long, needle string")
    j = evaluation.judged(needles, evaluation.needle_hits(found, needles))
    assert {r["qid"]: (r["any_hit"], r["all_hit"], r["first_rank"]) for r in j.collect()} == {1: (True, False, 1), 2: (False, False, None)}
    assert evaluation.recall(j).first()["recall"] == 0.5


def test_phrases_that_name_a_period(spark):
    # What each of these names.
    phrases = {
        "orders by March 31, 2026, in all": [20260331], "returns FY2026": [20260331], "returns FY 26": [20260331], "Q4 FY26 returns": [20260331], "on 30 September 2025": [20250930], "Q2 FY2026": [20250930],
        "July-September 2025": [20250930], "Sept 30th, 2025": [20250930], "December 2025": [20251231], "at 31.12.2025": [20251231], "financial year 2025": [20250331], "Q1 of FY2026": [20250630],
        "Q2, Q3, and Q4 of FY2026": [20250930, 20251231, 20260331], "March 31, 2026 and December 31, 2025": [20251231, 20260331], "which orders came late": [], "what may follow": [], "opened in 1994": [],
    }
    got = spark.createDataFrame([(q,) for q in phrases], "q string").select("q", P.query_periods(F.col("q"))["periods"].alias("k")).collect()
    assert {r["q"]: r["k"] for r in got} == phrases
