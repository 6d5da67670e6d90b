"""Cutting and packing by tokenizers whose counts don't add up, held against going word by word."""

import random
import re

import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.config import Settings
from lodestone.functions import text as T
from lodestone.functions import tokenizers as K
from lodestone.operators import pages
from lodestone.plans import registry

SUBWORDS = K.of_file(public_tokenizers.path("byte_bpe_50k.json"))
COUNTS = {"quarters": K.quarters, "subwords": SUBWORDS, "words": lambda texts: [len(t.split()) for t in texts]}


def pieces_by_word(text, n, count):
    out, held = [], []
    for w in text.split():
        if held and count([" ".join([*held, w])])[0] > n:
            out.append(" ".join(held))
            held = []
        held.append(w)
    return out + [" ".join(held)] * bool(held)


def tail_by_word(text, n, count):
    words, best = text.split(), ""
    for k in range(1, len(words) + 1):
        if n <= 0 or count([" ".join(words[-k:])])[0] > n:
            break
        best = " ".join(words[-k:])
    return best


def packed_by_word(text, most, overlap, count):
    """Each block is put to the open passage, or begins one with the last one's tail, or is cut."""
    size = lambda t: count([t])[0]
    out, now = [], None
    for block in filter(str.strip, re.split(r"\n\s*\n", re.sub(r"^\s*\n|\n\s*$", "", text))):
        if size(block) > most:
            parts = pieces_by_word(block, most, count)
            out += ([now] if now else []) + parts[:-1]
            now = parts[-1]
        elif now is None or size(f"{now}\n\n{block}".strip()) <= most:
            now = block if now is None else f"{now}\n\n{block}".strip()
        else:
            out.append(now.strip())
            now = f"{tail_by_word(out[-1], overlap, count)}\n\n{block}".strip()
    return out + ([now.strip()] if now and now.strip() else [])


def some_text(rng, words):
    word = lambda: "".join(rng.choices("abcdeéß漢1-", k=rng.choice([1, 2, 5, 9, 60])))
    return " ".join(word() for _ in range(words))


TEXTS = ["", "   \n ", "x", "one two"]


@pytest.mark.parametrize("name", sorted(COUNTS))
@pytest.mark.parametrize("n", [0, 1, 3, 40])
def test_pieces_and_tails(spark, name, n):
    rng = random.Random(n)
    texts = TEXTS + [some_text(rng, k) for k in (3, 30, 400)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i long, text string")
    count = COUNTS[name]
    got = {r["i"]: r for r in table.select("i", K.token_pieces(F.col("text"), n, count).alias("p"), K.last_tokens(F.col("text"), n, count).alias("t"), K.token_count(F.col("text"), count).alias("c")).collect()}
    for i, text in enumerate([*texts, ""]):
        assert got[i]["p"] == pieces_by_word(text, n, count), (i, n)
        assert got[i]["t"] == tail_by_word(text, n, count), (i, n)
        assert got[i]["c"] == count([text])[0]


@pytest.mark.parametrize("name", sorted(COUNTS))
def test_packing(spark, name):
    rng = random.Random(5)
    texts = [*TEXTS, *("\n\n".join(some_text(rng, rng.choice([1, 4, 12, 80])) for _ in range(b)) for b in (1, 2, 9, 40))]
    table = spark.createDataFrame(list(enumerate([*texts, None])), "i long, text string")
    got = {r["i"]: r["p"] for r in table.select("i", pages.packed(F.col("text"), 60, 15, COUNTS[name]).alias("p")).collect()}
    assert got == {i: packed_by_word(t, 60, 15, COUNTS[name]) for i, t in enumerate([*texts, ""])}


def test_words_as_tokens_pack_as_words_do(spark, sf):
    text = F.col("text")
    both = spark.read.parquet(f"{sf}/documents.parquet").select(pages.packed(text, 100, 20).alias("a"), pages.packed(text, 100, 20, COUNTS["words"]).alias("b"))
    rows = both.collect()
    assert rows and all(r["a"] == r["b"] for r in rows) and max(len(r["a"]) for r in rows) > 10


def test_subword_query_is_packing_word_by_word(spark, sf):
    got = {}
    for r in registry.QUERIES["w11_subword_packing"](spark, sf).orderBy("doc_id", "piece").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
        assert r["n_tokens"] == SUBWORDS([r["text"]])[0]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    some = sorted(docs, key=lambda i: len(docs[i] or ""))[:190]  # going word by word is slow for the longest
    assert all(got.get(i, []) == packed_by_word(docs[i] or "", 350, 60, SUBWORDS) for i in some)


def test_chunks_by_a_tokenizer(spark):
    body = "\n\n".join(some_text(random.Random(i), 40) for i in range(6))
    table = spark.createDataFrame([("d", 1, "file", body)], "doc string, page long, source string, text string")
    rows = pages.chunks(pages.tagged(table), Settings(chunk_max_tokens=120, chunk_overlap_tokens=10, row_chunks=False), SUBWORDS).orderBy("chunk_index").collect()
    want = packed_by_word(body, 120, 10, SUBWORDS)
    assert [r["text"] for r in rows] == ["Results\n" + t for t in want]
    made = spark.createDataFrame([(t,) for t in want], "text string")
    n = SUBWORDS(want)
    assert tuple(pages.token_stats(made, SUBWORDS).first()) == (min(n), sum(n) // len(n), max(n))


def test_costs_grow_with_length():
    asked = []

    def count(texts):
        asked.extend(map(len, texts))
        return [len(t.split()) for t in texts]

    words = " ".join(["word"] * 20_000)
    assert len(K._side_by_side([K._pieces(words, 350)], count)[0]) == 58
    assert sum(asked) < 12 * len(words)


def test_blocks_are_not_asked_of_null(spark):
    assert spark.range(1).select(K.passages(T.blocks(F.lit(None).cast("string")), 5, 1, K.quarters)).first()[0] == []


def test_what_is_counted_at_once_is_bounded():
    asked = []

    def count(texts):
        asked.append(sum(map(len, texts)))
        return [len(t.split()) for t in texts]

    column = pd.Series(["word " * 2000] * 300)
    made = K._udf(lambda t: K._pieces(t, 350), count, "array<string>").func(column)
    assert [len(p) for p in made] == [6] * 300 and max(asked) <= 1 << 19 and len(asked) > 1


def test_tokens_of_a_file_are_looked_up_and_summed(monkeypatch):
    """Texts are cut as by counting them whole, also with white space of any kind, and what is counted doesn't grow with repeated words."""
    rng = random.Random(9)
    words = ["mill", "the", "'s", "a\xa0b", "\u2028", "\xa0", "x\xa0", "1,234.5", "漢字", "<|endoftext|>", "é" * 90, "".join(rng.choices("abcdeß-1", k=300))]
    gaps = [" ", " ", " ", "  ", "\t", "\n", " \n", "\n\n", "\n \n\n", "\r\n"]
    texts = ["", " ", "\t\t", *("".join(x for _ in range(rng.choice([1, 5, 60, 500])) for x in (rng.choice(words[: rng.choice([3, 12])]), rng.choice(gaps))) for _ in range(60))]
    lists = [[b for b in re.split(r"\n\s*\n", t) if b] for t in texts]
    lists += [["\t", " \n", *b, "\t", " " * 400, "\t\n" * 900, "last "] for b in lists[:30]]
    monkeypatch.setattr(K, "REMEMBERED", 40)
    for n, overlap in ((1, 0), (9, 4), (60, 15), (350, 60)):
        plain = lambda walk, column: K._side_by_side(map(walk, column), SUBWORDS)
        looked_up = lambda walk, sized, column: list(K._walked(column, walk, SUBWORDS, sized))
        assert looked_up(lambda t: K._tail(t, n), lambda t, s: K._sized_tail(t, n, s)[0], texts) == plain(lambda t: K._tail(t, n), texts)
        assert looked_up(lambda t: K._pieces(t, n), lambda t, s: [x for x, _ in K._sized_pieces(t, n, s)], texts) == plain(lambda t: K._pieces(t, n), texts)
        assert looked_up(lambda b: K._counted_passages(b, n, overlap), lambda b, s: K._sized_passages(b, n, overlap, s), lists) == plain(lambda b: K._counted_passages(b, n, overlap), lists)
    assert looked_up(K._asked, lambda t, s: s.of(t), texts) == SUBWORDS(texts)
    asked, sizes = [], K.Sizes(lambda some: asked.extend(some) or SUBWORDS(some))
    blocks = ["mill pond bridge bread " * 40] * 500
    assert len(K._sized_passages(blocks, 350, 60, sizes)) > 200 and sum(map(len, asked)) < 200
