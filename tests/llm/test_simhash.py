"""Fingerprints by their definition and links against all pairs."""

import numpy as np
import pandas as pd
import pytest
import xxhash

from lodestone.llm import simhash
from lodestone.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_labels(fps, radius):
    label = list(range(len(fps)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = top(i), top(j)
            label[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = docs.toPandas().sort_values("doc_id")
    out = simhash.components(docs).toPandas().sort_values("doc_id")
    fps = np.array([brute_fingerprint(t) for t in texts.text], np.uint64)
    assert out.fingerprint.tolist() == [f"{int(x):016x}" for x in fps]
    assert out.component_id.tolist() == texts.doc_id.to_numpy()[brute_labels(fps, 4)].tolist()


@pytest.mark.parametrize(("radius", "segments", "meet"), [(4, 2, 8192), (4, 2, 50), (11, 4, 8192), (11, 4, 50)])
def test_dense_groups(spark, monkeypatch, radius, segments, meet):
    monkeypatch.setattr(simhash, "MEET", meet)
    rng = np.random.default_rng(radius)
    fps = []
    for base in rng.integers(0, 2**63, 5, dtype=np.uint64):
        for _ in range(150):
            x = int(base)
            for i in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(i)
            fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))
    found = connected_components(simhash.links(nodes, radius, segments)).toPandas()
    label = dict(zip(found.node, found.label, strict=True))
    got = [label.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute_labels(fps, radius)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_deduplicated_keeps_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w150 ", "changed ")
    other = " ".join(f"v{i}" for i in range(300))
    docs = spark.createDataFrame([(3, base), (1, near), (2, base), (7, other), (7, other), (8, "short one"), (9, "short two"), (None, base), (None, "alone")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text) for r in simhash.deduplicated(docs).collect()) == [(0, "alone"), (1, near), (7, other), (8, "short one"), (9, "short two")]


def test_different_texts_under_one_id_stay(spark):
    texts = [" ".join(f"{name}{i}" for i in range(60)) for name in "abc"]
    docs = spark.createDataFrame([(5, t, "x") for t in texts] + [(4, texts[0], "y"), (None, texts[1], "z"), (5, texts[2], "x")], "doc_id long, text string, row string")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns and sorted((r.doc_id, r.text[0]) for r in out.collect()) == [(4, "a"), (5, "b"), (5, "c")]


def test_one_phrase_said_often_makes_no_copies(spark):
    docs = spark.createDataFrame([(i, "x " * 1000 + " ".join(f"{name}{k}" for k in range(400))) for i, name in enumerate("ab")], "doc_id long, text string")
    assert simhash.near_copies(docs).count() == 0


def shingle_sets(texts, n=5):
    rows = [t.lower().split() for t in texts]
    return [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset() for w in rows]


def jaccard_groups(texts):
    """Group names by all pairs that share a shingle, each by its exact similarity."""
    sets, label, holders = shingle_sets(texts), list(range(len(texts))), {}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
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


def near_labels(spark, texts, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    label = {r.doc_id: r.copy_of for r in simhash.near_copies(docs, **how).collect()}
    return [label.get(i, i) for i in range(len(texts))]


def test_groups_equal_all_pairs(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").toPandas().text.tolist()
    assert near_labels(spark, texts) == jaccard_groups(texts)


@pytest.mark.parametrize(("block", "together"), [(300_000, 50_000), (2_000, 20)])
def test_dense_near_copies(spark, monkeypatch, block, together):
    # Chains and crowds of copies; small blocks deal them out.
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(simhash, "TOGETHER", together)
    rng = np.random.default_rng(6)
    texts = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(100)]
        for k in range(60):
            words = list(base)
            for i in rng.choice(100, rng.integers(0, 4), replace=False):
                words[i] = f"z{rng.integers(10**9)}"
            texts.append(" ".join(words))
        for k in range(1, 30):  # each much like the last, the ends unlike
            base[3 * k % 100] = f"c{g}x{k}"
            texts.append(" ".join(base))
    got, want = near_labels(spark, texts), jaccard_groups(texts)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(texts)
    assert all(want[a] == want[i] for i, a in enumerate(got))  # nothing is joined that all pairs leave apart


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    out = {r.node: r.label for r in connected_components(edges).collect()}
    assert out == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_similarity_decides(spark):
    # Pairs of 196 shingles against as many and some more, just above and just below a similarity of 0.8.
    rng = np.random.default_rng(8)
    docs = []
    for i in range(300):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 265)]
        docs += [(2 * i, " ".join(words[:200])), (2 * i + 1, " ".join(words[: 248 if i < 150 else 255]))]
    found = {r.doc_id: r.copy_of for r in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(d == c + 1 and d < 300 for d, c in found.items())
    assert len(found) >= 147


def test_short_copies(spark):
    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    docs = [(1, text("a", 19)), (2, text("a", 20)), (3, text("b", 8)), (4, text("b", 9)), (5, text("c", 7)), (6, text("c", 8)), (7, "one two"), (8, "one two three"), (9, "One  two")]
    docs += [(20 + i, f"all of these words {i} differ here {i} anew") for i in range(80)]
    found = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(2, 1), (4, 3), (9, 7)]


def test_recall_by_similarity(spark):
    # Pairs of so many words, of which the second's end is cut off to give the similarity.
    rng = np.random.default_rng(9)
    for n, similarity, least in ((30, 0.85, 0.95), (200, 0.82, 0.97), (200, 0.9, 0.995), (1000, 0.82, 0.97)):
        docs = []
        for i in range(200):
            words = [f"w{x}" for x in rng.integers(0, 10**9, n + 4)]
            docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[: 4 + -int(-n * similarity // 1)]))]
        assert simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).count() >= 200 * least, (n, similarity)


def test_stars_keep_components():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 80, 120):
        u, v = rng.integers(-50, 50, n), rng.integers(-50, 50, n)
        a, b = simhash.stars(u, v)
        label = {x: {x} for x in range(-50, 50)}
        for x, y in zip(u.tolist(), v.tolist(), strict=True):
            both = label[x] | label[y]
            label.update(dict.fromkeys(both, both))
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((min(g), x) for x, g in label.items() if min(g) != x)
    # A path numbered at random, and a dense group, give one link for each node but the least.
    order = rng.permutation(2000)
    assert len(simhash.stars(order[:-1], order[1:])[0]) == 1999
