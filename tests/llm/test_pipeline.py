"""The pipeline from end to end on a small corpus whose every decision is known or worked out by brute force."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, mixing, quality, token_counts, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The shared documents and labels, with planted rows: insults, near copies, different texts under one id, repeated rows."""
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rng = random.Random(7)
    clean = [r.text for r in docs.where("length(text) between 600 and 2000 and lang = 'en'").orderBy("doc_id").limit(40).collect()]
    rows = []
    for i, t in enumerate(clean[:12]):
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows += [(900_000 + i, " ".join(words)), (910_000, t[::-1]), (None, t)]
    rows += [(920_000, clean[0]), (920_000, clean[0]), (930_000, None), (930_001, "")]
    more = spark.createDataFrame([(i, t, "en", "planted", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.union(more).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def similar_groups(texts):
    sets, label, holders = [], list(range(len(texts))), {}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        sets.append(s)
        both = {}
        for x in s or [None]:
            for j in holders.setdefault(x, []):
                both[j] = both.get(j, 0) + 1
            holders[x].append(i)
        for j, n in both.items():
            if not s or n >= 0.8 * (len(s) + len(sets[j]) - n) - 1e-9:
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return [top(i) for i in range(len(texts))]


def test_stage_by_stage(spark, folder):
    docs = common.read(spark, folder, "documents")
    labels = common.read(spark, folder, "labels")
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source) for r in rows)
    steps = dict(corpus_pipeline.STAGES)
    before = docs.collect()

    # The classifiers drop what they score beyond their thresholds and nothing else.
    one = common.written(steps["toxicity"](spark, docs, folder), "t")
    model = toxicity.learned(docs, labels)
    scores = toxicity.Scorer(model).scores([r.text or "" for r in before]) if model else [0.0] * len(before)
    assert key(one.collect()) == key(r for r, p in zip(before, scores, strict=True) if p < 0.7)
    two = common.written(steps["quality_classifier"](spark, one, folder), "q")
    net = quality.learned(one, labels)
    before = one.collect()
    scores = quality._scores(net, [r.text or "" for r in before])
    assert key(two.collect()) == key(r for r, p in zip(before, scores, strict=True) if p >= 0.3)

    # One row of each group of near copies, and of no group more, stays: all pairs by their exact similarity.
    before = two.collect()
    three = common.written(steps["simhash_near_dedup"](spark, two, folder), "n")
    groups = {}
    for r, g in zip(before, similar_groups([r.text for r in before]), strict=True):
        groups.setdefault(g, []).append(r)
    stays = [min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)) for rows in groups.values()]
    after = three.collect()
    assert len(after) == len(groups) and sorted((r.doc_id is None, r.doc_id or 0) for r in after) == sorted((r.doc_id is None, r.doc_id or 0) for r in stays)

    # Each document is there as often as its rate says: the whole part, or one more.
    four = common.written(steps["mixing"](spark, three, folder), "m")
    sizes = {r.source: r for r in mixing.targets(three.select("source", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long").alias("size"))).collect()}
    times = {}
    for r in four.collect():
        times[r.doc_id, r.text, r.source] = times.get((r.doc_id, r.text, r.source), 0) + 1
    for r in after:
        words = sum(len((x.text or "").split()) for x in after if x.source == r.source)
        if words:
            rate = sizes[r.source].target / words
            assert int(rate) <= times.get((r.doc_id, r.text, r.source), 0) <= int(rate) + 1
    five = steps["sentencepiece"](spark, four, folder)
    library = sentencepiece.SentencePieceProcessor(model_proto=token_counts.model_bytes())
    assert sorted(tuple(r.ids) for r in five.collect()) == sorted(tuple(library.encode(r.text or "")) for r in four.collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    rows = out.collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    assert corpus_pipeline.run(spark, folder).count() == len(rows)
