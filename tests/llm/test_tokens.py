"""Codec and counts against the library, on random texts and the shared documents."""

import random

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from lodestone.llm import bpe, sentencepiece_codec, token_counts

DATA = token_counts.model_bytes()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=DATA)


@pytest.fixture(scope="module")
def texts(sf):
    rng = random.Random(1)
    letters = "aaabcdehilnorst  ▁\n\t.é漢🙂\u0000ñ012"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    made += [" " * k + x for k in range(40) for x in ("", "a", "\n", "漢", " x")] + ["the" * 500, "aab" * 400, " " * 700, "a\U0010ffffb", "\U0010ffff", "x \U0010ffff\U0010ffff y"]
    return made + pd.read_parquet(f"{sf}/documents.parquet").text.tolist()


def test_codec_equals_library(library, texts):
    codec = sentencepiece_codec.Codec(DATA)
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == library.encode(texts, num_threads=1)
    assert [codec.decode(g) for g in got] == [t.replace(bpe.SPACE, " ") for t in texts]


def test_counts_of_every_prefix(library, texts):
    for t in texts[::40]:
        t = t[:250]
        want = [len(x) for x in library.encode([t[:i] for i in range(len(t) + 1)])]
        assert token_counts.prefix_counts(DATA, t).tolist() == want
        steps = np.diff(want)
        for budget in (0, 1, 7, 40):
            assert token_counts.fit(steps, budget) == max(i for i, n in enumerate(want) if n <= budget)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    letters = rng.integers(1, 4, 300)
    packed = sentencepiece_codec._packed(letters, 13)
    order = sentencepiece_codec.suffix_array(packed, 16)
    rows = [tuple(letters[i : i + 16]) for i in order]
    assert rows == sorted(rows)


def test_tables(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.token_counts(docs, DATA).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id])) and r.over_limit == (r.n_tokens > 4096) and r.n_bytes == len(texts[r.doc_id].encode())
    tokens = sentencepiece_codec.encoded(docs, DATA)
    assert {r.doc_id: r.text for r in sentencepiece_codec.decoded(tokens, DATA).collect()} == texts
    stored = token_counts.token_counts(docs.where("length(text) < 300"), DATA, 10)
    fits = {r.doc_id: (r.n_tokens, r.fit_chars) for r in stored.collect()}
    assert {r.doc_id: (r.n_tokens, r.fit_chars) for r in token_counts.fitted(stored, 10).collect()} == fits
    for r in token_counts.with_prefix_counts(stored).collect():
        text, (n, chars) = texts[r.doc_id], fits[r.doc_id]
        assert len(r.prefix_tokens) == len(text) + 1 and r.prefix_tokens[-1] == n == len(library.encode(text))
        assert r.prefix_tokens[chars] == len(library.encode(text[:chars])) <= 10 and all(x > 10 for x in r.prefix_tokens[chars + 1 :])


def test_odd_ids(spark, library):
    codec = sentencepiece_codec.Codec(DATA)
    for ids in ([0], [1], [2], [1, 264, 359], [264, 0, 359], [1, 2], [300, 1, 301], [0, 264]):
        assert codec.decode(np.array(ids)) == library.decode(ids), ids
    rows = spark.createDataFrame([(1, [264, None, 359]), (2, None), (3, []), (None, [1])], "doc_id long, ids array<int>")
    assert [r.text for r in sentencepiece_codec.decoded(rows, DATA).collect()] == [library.decode([264, 359]), "", "", ""]
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]))


def test_steps_that_no_byte_holds(monkeypatch):
    rng = np.random.default_rng(0)
    for steps in ([], [1, -2, 127, -127], [128], [-128, 5, 70000, -128 - 256 * 128, 1], rng.integers(-300, 300, 500).tolist(), [-2139062144, 3]):
        packed = token_counts.packed(np.array(steps, np.int64))
        assert token_counts.unpacked(packed).tolist() == steps
    # A model whose counts jump: what is kept and put together is still exact.
    real = token_counts.unit_prefixes
    monkeypatch.setattr(token_counts, "unit_prefixes", lambda m, units: (real(m, units)[0] * 100, real(m, units)[1]))
    counter, units = token_counts.Counter(token_counts.model_bytes()), token_counts.bpe.units_of("Many words, and 漢字 too.")
    counter.learn([units])
    wide = np.cumsum(token_counts.unpacked(token_counts.packed(counter.steps(units))), dtype=np.int64)
    monkeypatch.undo()
    assert wide.tolist() == (100 * token_counts.prefix_counts(token_counts.model_bytes(), "Many words, and 漢字 too.")[1:]).tolist()
