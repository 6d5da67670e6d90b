"""Decontamination and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import decontamination, resampling
from lodestone.llm.common import plain_words, shards


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_words():
    for text in (None, "", "Ab cÉ-9 z\x00q\x7f{x}", "漢字 İ ſ \xa0 a\x85b é", "_a__B"):
        assert [w.decode() for w in plain_words(text.encode() if text else None)] == words(text)


def brute(docs, items, window):
    out = []
    for _, text in docs:
        w, hit, ids, best = words(text), set(), set(), 0
        for name, other in items:
            o = words(other)
            n = min(window, len(o))
            for j in range(len(o) - n + 1 if o else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == o[j : j + n]:
                        hit |= set(range(i, i + n))
                        ids.add("" if name is None else str(name))
                        k = n
                        while i + k < len(w) and j + k < len(o) and w[i + k] == o[j + k]:
                            k += 1
                        best = max(best, k)
        out.append((len(w), len(hit), sorted(ids), best))
    return out


def cases(seed):
    rng = random.Random(seed)
    some = lambda n, m: " ".join(rng.choice("abcdefgh"[:m]) + rng.choice(["", "", "É"]) for _ in range(n))
    items = [(i, some(rng.randint(3, 30), 6)) for i in range(12)] + [(3, "a b"), (None, "zz"), (50, None), (51, " - "), (52, "h H h H h"), (7, some(40, 2))]
    texts = [some(rng.randint(0, 60), 8) for _ in range(25)] + [None, "", "zz", "Zz zz-ZZ", "a b" * 30]
    texts += [some(8, 8) + " " + rng.choice([t for _, t in items if t]) + "! " + some(5, 8) for _ in range(15)] + [items[-1][1]] * 5
    return list(enumerate(texts)), items


@pytest.mark.parametrize("seed,window", [(0, 10), (1, 4), (2, 1), (3, 6)])
def test_suffix_arrays_find_what_brute_force_finds(seed, window):
    docs, items = cases(seed)
    held = decontamination.Items([(None if n is None else str(n), t.encode() if t else None) for n, t in items], window)
    got = decontamination.searched([t.encode() if t is not None else None for _, t in docs], held)
    want = brute(docs, items, window)
    assert [(g["n_words"], g["n_hit"], g["items"]) for g in got] == [w[:3] for w in want]
    assert all(sum(s["end"] - s["begin"] for s in g["spans"]) == g["n_hit"] for g in got)
    # Every test suffix's longest match is told once, to one of the documents that hold it.
    assert max(g["longest"] for g in got) == max(w[3] for w in want) and all(g["longest"] <= w[3] for g, w in zip(got, want, strict=True))
    for g, (_, text) in zip(got, docs, strict=True):
        if g["longest"]:
            part = words(text)[g["longest_word"] : g["longest_word"] + g["longest"]]
            assert len(part) == g["longest"] and any(part == words(t)[j : j + len(part)] for n, t in items if ("" if n is None else str(n)) == g["longest_item"] for j in range(len(words(t))))


def test_long_copies_are_sorted_by_doubling():
    rng = random.Random(9)
    text = [rng.randint(1, 3) for _ in range(400)]
    ids = np.array((text + [0]) * 6 + text[100:] + [0], np.int64)
    array = decontamination.SuffixArray(ids, 2, 1, 400)
    keys = [tuple(ids[p : p + list(ids[p:]).index(0)]) for p in array.places.tolist()]
    cut = [k[:400] for k in keys]
    # What is left of the order: no suffix stands after one that is greater before either ends.
    for a, b in zip(cut, cut[1:], strict=False):
        n = min(len(a), len(b))
        assert a[:n] <= b[:n]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_blocks_of_items(spark, block_bytes):
    docs, items = cases(4)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, _found string")
    b = spark.createDataFrame(items, "item_id long, text string")
    f = "m"
    got = {r["doc_id"]: (r[f]["n_words"], r[f]["n_hit"], r[f]["items"]) for r in decontamination.scanned(d, b, 5, f, block_bytes).collect()}
    assert got == dict(enumerate(w[:3] for w in brute(docs, items, 5)))
    kept = decontamination.decontaminated(d, b, 5)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, g in got.items() if not g[1]}


def test_report_of_odd_rows(spark, odd):
    b = spark.createDataFrame([(1, "one two three four five six"), (2, None)], "item_id long, text string")
    rows = decontamination.report(odd, b).collect()
    assert len(rows) == odd.count() and {r["contaminated"] for r in rows if r["doc_id"] in (4, 5)} == {True} and sum(r["contaminated"] for r in rows) == 3
    assert {r["items_sha256"] for r in rows if r["contaminated"]} == {hashlib.sha256(b"1").hexdigest()} and {r["items_sha256"] for r in rows if not r["contaminated"]} == {hashlib.sha256(b"").hexdigest()}
    assert decontamination.report(odd.limit(0), b).count() == 0
    assert decontamination.report(odd, b.limit(0)).where("contaminated or n_items > 0").count() == 0
    assert decontamination.decontaminated(odd, b).dtypes == odd.dtypes


def buckets_of(text, longest, buckets):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1))


@pytest.mark.parametrize("longest,percent", [(1, 10), (3, 40)])
def test_resampling_by_definition(spark, odd, longest, percent):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "Ça", "d9"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, ""]
    rows = [(i // 2 if i < 20 else i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (7, "a " * 30), (7, "a " * 30)]
    docs, target = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "a b a b Ça"), (2, None)], "item_id long, text string")
    buckets = 50
    s, t = sum((buckets_of(x, longest, buckets) for _, x in rows), Counter()), buckets_of("a b a b Ça", longest, buckets)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    want = []
    for i, x in rows:
        of = buckets_of(x, longest, buckets)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in of.items())
        want.append((i, of.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20))
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], math.inf if w[0] is None else w[0], w[1]))
    best = able[: len(able) * percent // 100]
    got = resampling.resampled(docs, target, longest, buckets, 20, percent).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got))) == sorted(str(w[:4]) for w in want)
    assert [(r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [w[:4] for w in best]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(best) + 1))
    drawn = resampling.drawn(docs.withColumn("_weights", docs.text), target, longest, buckets, 20, percent)
    assert drawn.columns == ["doc_id", "text", "_weights"] and sorted(str(r["doc_id"]) for r in drawn.collect()) == sorted(str(w[0]) for w in best)


def test_resampling_of_odd_rows(spark, odd):
    target = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert len(resampling.resampled(odd, target).collect()) == odd.count()
    assert resampling.resampled(odd.limit(0), target).count() == 0 and resampling.drawn(odd.limit(0), target).count() == 0
    assert resampling.resampled(odd, target.limit(0)).where("n_features = 0 and weight <> 0").count() == 0
    assert resampling.drawn(odd, target, percent=100).dtypes == odd.dtypes


def test_many_equal_ranks(spark):
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", "repeat('a ', 20) as text")
    got = sorted(r["rank"] for r in resampling.resampled(docs, docs.selectExpr("doc_id as item_id", "text"), percent=50).where("rank is not null").collect())
    assert got == list(range(1, 1501))


def test_shards():
    import pyarrow as pa

    rows = [b"a" * 5, None, b"b" * 30, b"", b"c" * 4, b"d" * 4, None]
    got = list(shards(pa.array(rows, pa.binary()), 10))
    assert [x for part in got for x in part] == rows and all(len(p) == 1 or sum(len(x or b"") for x in p) <= 10 for p in got)
    assert list(shards(pa.array([], pa.binary()))) == []


def test_local_folder_where_none_is_named(tmp_path):
    # In a session of its own without the setting, as a user's is.
    import os
    import subprocess
    import sys

    code = "from pyspark.sql import SparkSession\nfrom lodestone.llm import common\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert common.written(s.range(3), 'x').count() == 3\nprint('fine')"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    assert "fine" in subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240).stdout
