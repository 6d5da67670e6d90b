"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from lodestone.llm import ann, html_text, media, mixing, quality, sentencepiece_codec, sharding, simhash, token_counts, toxicity

DATA = token_counts.model_bytes()
OPERATORS = {
    "codec": lambda d, labels: sentencepiece_codec.round_trip(d, DATA),
    "media": lambda d, labels: media.round_trip(d),
    "toxicity": toxicity.scored,
    "quality": quality.scored,
    "sharding": lambda d, labels: sharding.resharded(d),
    "simhash": lambda d, labels: simhash.components(d),
    "mixing": lambda d, labels: mixing.mixed(d),
    "counts": lambda d, labels: token_counts.token_counts(d, DATA),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_once(odd, labels, name):
    rows = OPERATORS[name](odd, labels).collect()
    assert len(rows) == odd.count()
    assert sorted((r.doc_id is None, r.doc_id) for r in rows if r.doc_id is not None) == sorted((False, r.doc_id) for r in odd.collect() if r.doc_id is not None)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(odd, labels, name):
    assert OPERATORS[name](odd.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["codec", "media", "toxicity", "quality", "simhash", "counts"])
def test_equal_texts_equal_values(odd, labels, name):
    rows = OPERATORS[name](odd, labels).collect()
    same = {tuple(v for k, v in r.asDict().items() if k not in ("doc_id", "held_out")).__repr__() for r in rows if r.doc_id in (4, 5)}
    assert len(same) == 1


@pytest.mark.parametrize("step", range(4))
def test_stages_keep_columns(spark, odd, tmp_path, labels, step):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[step]
    out = stage(spark, odd, str(tmp_path))
    assert out.dtypes == odd.dtypes
    assert stage(spark, odd.limit(0), str(tmp_path)).count() == 0
    if name != "mixing":
        assert out.count() <= odd.count()


def test_last_stage(spark, odd, tmp_path):
    out = corpus_pipeline.STAGES[4][1](spark, odd, str(tmp_path)).collect()
    assert len(out) == odd.count() and {r.n_tokens for r in out if r.doc_id in (1, 2)} == {0}


def test_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain"), (3, "u", "<p>"), (None, "u", "<article><p>A &amp; b  c.</p></article>"), (5, "u", "<article>" + "<p>x y z.</p>" * 3000)]
    d = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    out = html_text.extracted(d).collect()
    assert len(out) == len(rows)
    assert {r.n_chars for r in out if r.page_id in (1, 2)} == {0}
    assert [r.text for r in out if r.page_id is None] == ["A & b c."]
    assert [r.text.count("x y z.") for r in out if r.page_id == 5] == [3000]
    assert html_text.extracted(d.limit(0)).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (50, [1.0, 0.1]), (7, [1.0]), (8, [0.0, 1.0])]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, gid int")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(d).collect()}
    assert [out[0, k][0] for k in range(1, 5)] == [1, 2, 50, 8] and (0, 5) not in out
    assert out[0, 1][1] == 1.0 and [out[50, k][0] for k in range(1, 5)] == [0, 1, 2, 8]
    assert ann.nearest(d.limit(0)).count() == 0
