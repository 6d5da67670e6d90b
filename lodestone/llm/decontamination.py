"""Benchmark decontamination by suffix arrays of the training documents.

Tasks read documents in shards of some megabytes and build a suffix array over each shard's words: all suffixes that
begin in a run of benchmark words long enough for a window, in the order of their words. Every test suffix, from each word of
each item with a window's words left, is binary-searched in it, block of words by block. The range that is left after a window's
words are all its occurrences in the shard, with their places; going on to the item's end gives the longest verbatim match.

Words are numbered by the benchmark's dictionary and all other words are 0, which no test suffix holds, so that what
lies beyond such a word in a suffix's order doesn't matter. Several numbers are packed into one integer,
and prefix doubling sorts only suffixes that are still equal.

Documents are never shuffled. The benchmark is what tasks hold whole: its bytes are summed first, and beyond
``BLOCK_BYTES`` it is dealt into blocks that are searched one after the other, each over all documents; what was found so far is
written between the passes, so that memory stays that of one block.

Defined results: a null or empty text has no words and no hits; null or empty items have no windows; a null item_id counts as
the empty string; items under one id count once; equal rows get equal rows; an empty table gives an empty one and without
items nothing is hit. Further columns are ignored by ``report`` and kept by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begun, discard, plain_words, shards, unused, written

WINDOW = 10
#: Bytes of benchmark text that a task holds at once, as numbered words and windows.
BLOCK_BYTES = 16 << 20
FOUND = "struct<n_words:long,n_hit:long,items:array<string>,longest:int,longest_word:int,longest_item:string,spans:array<struct<begin:int,end:int>>>"


class Packed:
    """Word numbers, with as many of them in one integer from each place on as 63 bits hold."""

    def __init__(self, ids: np.ndarray, bits: int):
        self.ids, self.bits, self.per = ids, bits, 63 // bits
        padded = np.concatenate([ids, np.zeros(self.per, np.int64)])
        self.keys = np.zeros(len(ids), np.int64)
        for j in range(self.per):
            self.keys = (self.keys << bits) | padded[j : j + len(ids)]

    def at(self, places: np.ndarray, words: int | None = None) -> np.ndarray:
        """Keys at places, 0 beyond the end; only the first ``words`` of each, the others 0."""
        out = np.where(places < len(self.keys), self.keys[np.minimum(places, len(self.keys) - 1)], 0)
        return out if words is None or words >= self.per else out >> (self.bits * (self.per - words)) << (self.bits * (self.per - words))


class Items:
    """The test side: numbered items, their distinct windows, and which items hold each window."""

    def __init__(self, rows: Iterable[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.names: list[str] = []
        self.number: dict[bytes, int] = {}
        ids: list[int] = []
        windows: dict[tuple[int, ...], list[tuple[int, int, int]]] = {}
        for name, text in rows:
            word = [self.number.setdefault(w, len(self.number) + 1) for w in plain_words(text)]
            if word:
                size = min(window, len(word))
                for j in range(len(word) - size + 1):
                    windows.setdefault(tuple(word[j : j + size]), []).append((len(self.names), len(ids) + j, len(word) - j))
                self.names.append(name or "")
                ids += [*word, 0]
        self.packed = Packed(np.array(ids, np.int64), max(1, (len(self.number) + 1).bit_length()))
        self.sizes = np.array([len(w) for w in windows], np.int64)
        members = [m for held in windows.values() for m in held]
        #: Of each window: its members, which are an item, a place among the items' words, and the words left there.
        self.member = np.array(members, np.int64).reshape(-1, 3)
        self.of = np.concatenate([[0], np.cumsum([len(held) for held in windows.values()])]).astype(np.int64)
        self.least = int(self.sizes.min()) if len(self.sizes) else 0
        self.deepest = int(self.member[:, 2].max()) if len(members) else 0


class SuffixArray:
    """Suffixes of a shard's words in order, down to ``deepest`` words."""

    def __init__(self, ids: np.ndarray, bits: int, least: int, deepest: int):
        ends = np.flatnonzero(np.concatenate([ids == 0, [True]]))
        run = np.diff(np.concatenate([[-1], ends])) - 1  # known words before each end
        ids = np.where(np.repeat(run, run + 1)[:-1] >= least, ids, 0) if len(ids) else ids
        self.text = Packed(ids, bits)
        self.places = self._sorted(np.flatnonzero(ids), deepest)
        self.first = self.text.keys[self.places] if len(self.places) else np.empty(0, np.int64)

    def _sorted(self, places: np.ndarray, deepest: int) -> np.ndarray:
        if not len(places):
            return places
        keys = self.text.keys[places]
        order = np.argsort(keys, kind="stable")
        places, keys = places[order], keys[order]
        group = np.maximum.accumulate(np.where(np.concatenate([[True], keys[1:] != keys[:-1]]), np.arange(len(places)), 0))
        rank = np.zeros(len(self.text.keys), np.int64)  # 0: no suffix of ours
        rank[places] = group + 1
        depth = self.text.per
        while depth < deepest:
            alike = np.concatenate([group[1:] == group[:-1], [False]])
            open_ = np.flatnonzero(alike | np.concatenate([[False], alike[:-1]]))
            if not len(open_):
                break
            beyond = places[open_] + depth
            key = np.where(beyond < len(rank), rank[np.minimum(beyond, len(rank) - 1)], 0)
            order = np.lexsort((key, group[open_]))
            places[open_] = places[open_[order]]
            key, was = key[order], group[open_]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (was[1:] != was[:-1])])
            group[open_] = np.maximum.accumulate(np.where(new, open_, 0))
            rank[places[open_]] = group[open_] + 1
            depth *= 2
        return places

    def narrowed(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Within each range, all alike in the first ``depth`` words, those whose next ``words`` words are the wanted."""
        if depth == 0:
            top = wanted if words >= self.text.per else wanted | ((1 << (self.text.bits * (self.text.per - words))) - 1)
            return np.searchsorted(self.first, wanted, "left"), np.searchsorted(self.first, top, "right")
        return self._bound(low, high, wanted, depth, words, False), self._bound(low, high, wanted, depth, words, True)

    def _bound(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray, depth: int, words: int, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (some := np.flatnonzero(low < high)).size:
            middle = (low[some] + high[some]) >> 1
            key = self.text.at(self.places[middle] + depth, words)
            less = key <= wanted[some] if after else key < wanted[some]
            low[some] = np.where(less, middle + 1, low[some])
            high[some] = np.where(less, high[some], middle)
        return low

    def ranges(self, test: Packed, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes lie that begin with the ``sizes`` words at each place of ``test``."""
        low, high = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            a, b = np.zeros(len(some), np.int64), np.full(len(some), len(self.places))
            left = np.arange(len(some))
            for depth in range(0, size, self.text.per):
                words = min(self.text.per, size - depth)
                a[left], b[left] = self.narrowed(a[left], b[left], test.at(places[some[left]] + depth, words), depth, words)
                left = left[a[left] < b[left]]
            low[some], high[some] = a, np.maximum(a, b)
        return low, high

    def longest(self, test: Packed, places: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of ``test`` the most words, of its ``sizes``, that some suffix begins with, and a place of that suffix."""
        best, at = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.places))
        left, depth = np.flatnonzero(sizes > 0), 0
        while len(left):
            wanted = test.at(places[left] + depth)
            a, b = self.narrowed(low[left], high[left], wanted, depth, self.text.per)
            for side in (0, -1):  # the neighbours of where it would stand share most
                near = a + side
                inside = (near >= low[left]) & (near < high[left])
                found = self.places[np.where(inside, near, 0)]
                differ = self.text.at(found + depth) ^ wanted
                # The place of the highest bit in which they differ tells how many words are alike.
                bit = np.where(differ > 0, np.floor(np.log2(np.maximum(differ, 1).astype(np.float64))).astype(np.int64), -1)
                bit = np.where((bit >= 0) & ((np.int64(1) << np.maximum(bit, 0)) > differ), bit - 1, bit)
                alike = depth + np.where(bit < 0, self.text.per, self.text.per - 1 - bit // self.text.bits)
                alike = np.where(inside, np.minimum(alike, sizes[left]), 0)
                better = alike > best[left]
                best[left[better]], at[left[better]] = alike[better], found[better]
            low[left], high[left] = a, b
            depth += self.text.per
            left = left[(a < b) & (sizes[left] > depth)]
        return best, at


def _numbered(texts: list[bytes | None], number: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, a 0 after each text, and where each text begins."""
    parts = []
    for text in texts:
        found = plain_words(text)
        parts.append(np.fromiter((number.get(w, 0) for w in found), np.int64, len(found)))
        parts.append(np.zeros(1, np.int64))
    sizes = np.array([len(p) + 1 for p in parts[::2]], np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def searched(texts: list[bytes | None], items: Items) -> list[dict]:
    """What each text of a shard shares with the items."""
    ids, begin = _numbered(texts, items.number)
    out = [{"n_words": int(n) - 1, "n_hit": 0, "items": [], "longest": 0, "longest_word": None, "longest_item": None, "spans": []} for n in np.diff(begin)]
    if not len(items.sizes):
        return out
    array = SuffixArray(ids, items.packed.bits, items.least, items.deepest)
    if not len(array.places):
        return out
    test = items.member[items.of[:-1], 1]
    low, high = array.ranges(items.packed, test, items.sizes)
    some = np.flatnonzero(low < high)
    if not len(some):
        return out
    # Every occurrence: its window and its place in the shard.
    times = high[some] - low[some]
    window = np.repeat(some, times)
    steps = np.arange(len(window)) - np.repeat(np.cumsum(times) - times, times)
    place = array.places[np.repeat(low[some], times) + steps]
    # Words inside any occurrence lie between more begins than ends.
    change = np.bincount(place, minlength=len(ids) + 1) - np.bincount(place + items.sizes[window], minlength=len(ids) + 1)
    hit = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    for a, b in edges.reshape(-1, 2).tolist():  # an occurrence never reaches the 0 after a text
        doc = int(np.searchsorted(begin, a, "right")) - 1
        out[doc]["spans"].append({"begin": a - int(begin[doc]), "end": b - int(begin[doc])})
        out[doc]["n_hit"] += b - a
    held = np.unique((np.searchsorted(begin, place, "right") - 1) * len(items.sizes) + window)
    for doc in np.unique(held // len(items.sizes)).tolist():
        of = held[np.searchsorted(held, doc * len(items.sizes)) : np.searchsorted(held, (doc + 1) * len(items.sizes))] - doc * len(items.sizes)
        which = np.unique(np.concatenate([items.member[items.of[w] : items.of[w + 1], 0] for w in of.tolist()]))
        out[doc]["items"] = sorted({items.names[i] for i in which.tolist()})
    # The longest match of every test suffix that has one, told to the document in which it lies.
    member = items.member[np.concatenate([np.arange(items.of[w], items.of[w + 1]) for w in some.tolist()])]
    best, at = array.longest(items.packed, member[:, 1], member[:, 2])
    docs = np.searchsorted(begin, at, "right") - 1
    for k in np.lexsort((at, member[:, 0], -best)).tolist():
        found = out[int(docs[k])]
        if not found["longest"]:
            found |= {"longest": int(best[k]), "longest_word": int(at[k] - begin[docs[k]]), "longest_item": items.names[int(member[k, 0])]}
    return out


def merged(one: dict, other: dict) -> dict:
    """What two blocks of items found in one text."""
    spans: list[dict] = []
    for s in sorted([*one["spans"], *other["spans"]], key=lambda s: s["begin"]):
        if spans and s["begin"] <= spans[-1]["end"]:
            spans[-1] = {"begin": spans[-1]["begin"], "end": max(spans[-1]["end"], s["end"])}
        else:
            spans.append(dict(s))
    most = one if one["longest"] >= other["longest"] else other
    return {**most, "n_hit": sum(s["end"] - s["begin"] for s in spans), "items": sorted({*one["items"], *other["items"]}), "spans": spans}


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Items]:
    """The items, block by block; a block has about ``most`` bytes of text, and at least one item."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16).alias("n")).first()["n"] or 0
    n = max(1, -(-size // most))
    if n > 1:
        rows = written(rows.withColumn("block", F.pmod(F.xxhash64("name", "text"), F.lit(n))).repartition("block"), "benchmark")
    for k in range(n):
        # Items in a defined order, so that ties of longest matches don't depend on how they are read.
        yield Items(sorted(((r["name"], bytes(r["text"]) if r["text"] is not None else None) for r in (rows.where(F.col("block") == k) if n > 1 else rows).toLocalIterator()), key=lambda r: (r[0] or "", r[1] or b"")), window)


def _search(spark: SparkSession, items: Items) -> Callable[[Column, Column], Column]:
    """A column function of a text and what earlier blocks found in it."""
    held = spark.sparkContext.broadcast(items)
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("longest", pa.int32()), ("longest_word", pa.int32()), ("longest_item", pa.string()), ("spans", pa.list_(span))])

    @F.arrow_udf(FOUND)
    def search(column: pa.Array, before: pa.Array) -> pa.Array:
        rows = (r for texts in shards(column) for r in searched(texts, held.value))
        return pa.array([r if b is None else merged(b, r) for r, b in zip(rows, before.to_pylist(), strict=True)], kind)

    return search


def scanned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, found: str = "_found", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the struct ``found``: words, hit words and where they lie, items with occurring windows, and the longest match."""
    out, since = docs, begun()
    for k, items in enumerate(_blocks(benchmark, window, block_bytes)):
        if k:
            out = written(out, "scanned")
        before = F.col(found) if k else F.lit(None).cast(FOUND)
        out = out.withColumn(found, _search(docs.sparkSession, items)(F.col("text").cast("binary"), before))
    if k:  # the benchmark's blocks and earlier passes were only read on the way
        out = written(out, "scanned")
        discard(docs.sparkSession, since, out)
    return out


def _items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of the longest match longest (words), longest_word (its first) and longest_item."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    f = F.col("_found")
    return scanned(plain, benchmark, window).select(
        "doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), _items_digest(f["items"]).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated"),
        f["longest"].alias("longest"), f["longest_word"].alias("longest_word"), f["longest_item"].alias("longest_item"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no window of the benchmark occurs in, with their columns as they are."""
    name = unused("_found", docs.columns)
    return scanned(docs, benchmark, window, name).where(F.col(name)["n_hit"] == 0).drop(name)


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH items AS (
  SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_W} AS w FROM benchmark) WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)
), d AS (
  SELECT doc_id, row_number() OVER () AS r, {_W} AS w FROM documents
), places AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS words FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))
), found AS (
  SELECT DISTINCT r, i, places.size, item_id FROM places JOIN windows USING (size, words)
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS id FROM found) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
