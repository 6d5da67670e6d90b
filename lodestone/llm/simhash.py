"""SimHash fingerprints, linked by multi-index hashing.

A fingerprint's 64 bits are parted into segments. Two fingerprints within the
radius differ in at most two bits of some segment, so that the Hamming balls of
radius one around both values of that segment share a value. Each distinct
fingerprint is entered under every value of these balls (34 or fewer for each
segment); rows that meet under one value are compared over all their bits.
Copies meet once, as one fingerprint. A value under which many meet gives a
spanning forest of its links, not all pairs, which leaves components as they are;
one under which more meet than ``MEET`` is dealt out as pairs of blocks.

``deduplicated`` drops near copies: documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more. Fingerprints of 64 bits say too little for that, so
that each text has a sketch of eight such words, cut into 21 segments of 24 bits. A bit that
barely over or under half of the shingles set is the one that differs in a near copy, so
that of a segment's Hamming ball only the values are entered that flip some of its three
least decided bits. Texts that meet under a value and whose sketches are near are
candidates; every component of candidates is then decided by exact similarity.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, which is linked like any other; equal rows get equal rows; an
empty table gives an empty table; further columns, whatever their names, are
ignored by ``fingerprints`` and ``components`` and kept by ``deduplicated``. A null
doc_id takes part, but is never a component's name unless it is alone.
``deduplicated`` tells rows apart by themselves, not by their doc_id: different texts
under one doc_id all stay, and of repeated rows one does; texts without words are copies of
each other; a group's row with the least doc_id stays, one with a null doc_id only if no
other has one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, grouped, small_batches, spread, unused, written
from .components import connected_components

MEET = 8192  # distinct fingerprints under one value that one task compares
SHIFTED = 64  # up to so many rows under one value all links are emitted, beyond a forest
TOGETHER = 50_000  # sketches under one value that one task compares
BLOCK_SHINGLES = 300_000  # of the texts whose shingle sets one task compares
SEED = 42
SKETCH = 8  # words of a sketch
CUT, LOW = 24, 3  # bits of its segments, and how many of them are tried both ways
PARTS = SKETCH * 64 // CUT
#: Odd multipliers from which the further, nearly independent words of a sketch follow.
MIX = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) for k in range(SKETCH)]


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased words; of all words if there are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    k = min(words, len(parts))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A word whose bits are set in over half the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[lo : lo + (1 << 16)])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        for table in grouped(batches, 4 << 20):
            fps = np.array([majority(shingle_hashes(t or "", words)) for t in table["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segments(n: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``n`` segments."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def forest(words: list[np.ndarray], radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links, as places, that join all components of the rows of words that differ in ``radius`` bits at most."""
    rest, out = np.arange(len(words[0])), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = sum(np.bitwise_count(w[rest] ^ w[at]).astype(np.int64) for w in words) <= radius
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), at), found))
                queue.extend(found)
                rest = rest[~near]
    return out


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of each run of equal keys."""
    begin = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return begin, np.diff(np.append(begin, len(keys)))


def neighbours(begin: np.ndarray, length: np.ndarray):
    """(place, distance) of all pairs of rows in runs of ``SHIFTED`` rows or fewer, one distance at a time."""
    size = np.repeat(length, length)
    at = np.flatnonzero((size > 1) & (size <= SHIFTED))
    place = at - np.repeat(begin, length)[at]
    for d in range(1, min(SHIFTED, int(length.max(initial=0)))):
        go = place + d < size[at]
        at, place = at[go], place[go]
        if not len(at):
            return
        yield at, d


def _met(keys: np.ndarray, fps: np.ndarray, segments: list[tuple[int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key; every run of equal keys is complete."""
    seg, ball = keys >> 56, keys & ((1 << 56) - 1)
    first, width = (np.array(x, np.int64)[seg] for x in zip(*segments, strict=True))
    bits = fps.view(np.uint64)
    own = ((bits >> first.astype(np.uint64)) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
    begin, length = runs(keys)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at, d in neighbours(begin, length):
        a, b = own[at], own[at + d]
        # Of the values that two balls share only the least counts, or the value itself if it is the same.
        counts = np.where(a == b, ball[at] == a, ball[at] < (a ^ b ^ ball[at]))
        near = at[counts & (np.bitwise_count(bits[at] ^ bits[at + d]) <= radius)]
        us.append(fps[near])
        vs.append(fps[near + d])
    for k in np.flatnonzero(length > SHIFTED):
        lo, hi = begin[k], begin[k] + length[k]
        if (own[lo:hi] == own[lo]).all() and own[lo] != ball[lo]:
            continue  # all of them meet under their own value as well
        for u, v in forest([bits[lo:hi]], radius):
            us.append(fps[lo + u])
            vs.append(fps[lo + v])
    return np.concatenate(us), np.concatenate(vs)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each component's least node to its others, in place of the given links."""
    names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    label = np.arange(len(names))
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(names))
    return names[label[other]], names[other]


def meeting(parted: DataFrame, columns: list[str], most: int, join) -> tuple[DataFrame, DataFrame]:
    """(u, v) that ``join`` finds among the rows of each key, and the rows of keys with more than ``most`` rows.

    ``parted`` has ``key`` and the long ``columns``, the rows of a key in one partition and sorted;
    ``join`` takes the keys and columns of many complete keys.
    """
    spark = parted.sparkSession
    names = ["u", "v", "key", *columns]

    def linked(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(len(u), pa.int64()) for _ in names[2:])], names)

    def passed(k, f):
        return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in (k, *f))], names)

    def run(batches):
        held_k, held_f, passing = np.zeros(0, np.int64), np.zeros((len(columns), 0), np.int64), None
        for table in grouped(batches, 4 << 20):
            k = np.concatenate([held_k, table["key"].to_numpy()])
            f = np.hstack([held_f, np.stack([table[c].to_numpy() for c in columns])])
            if passing is not None:  # the rest of a run that is too large
                n = int(np.searchsorted(k, passing, side="right"))
                yield passed(k[:n], f[:, :n])
                k, f = k[n:], f[:, n:]
                if not len(k):
                    held_k, held_f = k, f
                    continue
                passing = None
            done = int(np.searchsorted(k, k[-1]))
            if done:
                yield from whole(k[:done], f[:, :done])
            held_k, held_f = k[done:], f[:, done:]
            if len(held_k) > most:
                yield passed(held_k, held_f)
                passing, held_k, held_f = int(held_k[0]), held_k[:0], held_f[:, :0]
        if len(held_k):
            yield from whole(held_k, held_f)

    def whole(k, f):
        _, length = runs(k)
        many = np.repeat(length > most, length)
        if many.any():
            yield passed(k[many], f[:, many])
            k, f = k[~many], f[:, ~many]
        if len(k):
            yield linked(*join(k, np.ascontiguousarray(f)))

    with batch_rows(spark, 20_000):
        met = written(parted.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "met")
    return met.where("key is null").select("u", "v"), met.where("key is not null").select("key", *columns)


def links(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """(u, v): links between distinct fingerprints ``fp`` with at most ``radius`` differing bits.

    All links, or, among many fingerprints that share a segment's value, enough
    for the same components.
    """
    if radius > 3 * segments - 1:
        raise ValueError("too few segments for the radius")
    parts = _segments(segments)
    values = []
    for k, (first, width) in enumerate(parts):
        own = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))
        values += [own.bitwiseXOR(F.lit(x)).bitwiseOR(F.lit(k << 56)) for x in [0, *(1 << i for i in range(width))]]
    balls = spread(nodes.select("fp"), "fp").select("fp", F.explode(F.array(*values)).alias("key"))
    parted = balls.repartition("key").sortWithinPartitions("key", "fp")
    found, many = meeting(parted, ["fp"], MEET, lambda k, f: _met(k, f[0], parts, radius))
    sizes = many.groupBy("key").agg(F.ceil(F.count("*") / (MEET // 2)).alias("blocks"))
    dealt = many.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("fp"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))

    def pairs(table):
        fps = np.sort(table["fp"].to_numpy())
        found = forest([fps.view(np.uint64)], radius)
        join = lambda i: np.concatenate([np.zeros(0, np.int64), *(fps[x[i]] for x in found)])
        return pa.table({"u": join(0), "v": join(1)})

    rest = dealt.select("key", "fp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")).groupBy("key", "a", "b").applyInArrow(pairs, "u long, v long")
    return found.union(rest)


def labelled(many: DataFrame, few: DataFrame, on: list[str], n: str) -> DataFrame:
    """``many`` with the columns of ``few``, which has one row for each value of ``on`` and its number of rows ``n``.

    Values with over a 100,000th of all rows, fewer than 100,000 in number, are
    broadcast, so that no task gathers the copies of a frequent one.
    """
    least = (few.agg(F.sum(n)).first()[0] or 0) // 100_000 + 100
    often = F.broadcast(few.where(F.col(n) > least).drop(n))
    rare = many.join(often.select(*on), on, "left_anti").join(few.where(F.col(n) <= least).drop(n), on)
    return many.join(often, on).unionByName(rare)


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, that join all components of the sets under their exact Jaccard similarity."""
    size = np.array([len(x) for x in sets], np.int64)
    _, item = np.unique(np.concatenate([np.zeros(0, np.int64), *sets]), return_inverse=True)
    order = np.argsort(item, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    begin = np.append(0, np.cumsum(np.bincount(item)))
    place = np.append(0, np.cumsum(size))
    rest, us, vs = np.ones(len(sets), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(len(sets)):
        queue = [root] if rest[root] else []
        rest[root] = False
        while queue:
            at = queue.pop()
            own = item[place[at] : place[at + 1]]
            n = begin[own + 1] - begin[own]
            where = np.arange(n.sum()) + np.repeat(begin[own] - np.cumsum(n) + n, n)
            both = np.bincount(holder[where], minlength=len(sets))
            found = np.flatnonzero(rest & (both >= similarity * (size + size[at] - both) - 1e-9))
            rest[found] = False
            us.append(np.full(len(found), at))
            vs.append(found)
            queue.extend(found.tolist())
    return np.concatenate(us), np.concatenate(vs)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a set of shingle hashes, and its segments: value, then the places of the least decided bits, five bits each."""
    count = np.zeros((SKETCH, 64), np.int64)
    for k, by in enumerate(MIX):
        for lo in range(0, len(hashes), 1 << 16):
            x = hashes[lo : lo + (1 << 16)]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(by)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX[0])
            count[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = 2 * count - len(hashes)
    words = np.packbits(over > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    cut = over.ravel()[: PARTS * CUT].reshape(PARTS, CUT)
    segments = (cut > 0) @ (1 << np.arange(CUT))
    for k, at in enumerate(np.argsort(np.abs(cut), axis=1, kind="stable")[:, :LOW].T):
        segments |= at << (CUT + 5 * k)
    return words, segments


def sketches(rows: DataFrame, words: int) -> DataFrame:
    """row, doc_id, the text's set of shingles as a 128-bit name (h1, h2) and their number n, two sketch words and the segments."""

    def run(batches):
        for table in grouped(batches, 4 << 20):
            seen, out = {}, []
            for t in table["text"].to_pylist():
                if t not in seen:
                    h = np.unique(shingle_hashes(t or "", words))
                    name = xxhash.xxh3_128_intdigest(h.tobytes(), SEED)
                    seen[t] = (name >> 64, name % (1 << 64), len(h), *sketch(h))
                out.append(seen[t])
            word = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = pa.array(np.arange(len(out) + 1) * PARTS, pa.int32())
            segments = np.concatenate([x[4] for x in out]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [table["row"].combine_chunks(), table["doc_id"].combine_chunks(), word([x[0] for x in out]), word([x[1] for x in out]), pa.array([x[2] for x in out], pa.int64()), word([x[3][0] for x in out]), word([x[3][1] for x in out]), pa.ListArray.from_arrays(offsets, pa.array(segments, pa.int64()))],
                ["row", "doc_id", "h1", "h2", "n", "c1", "c2", "segments"],
            )

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, h1 long, h2 long, n long, c1 long, c2 long, segments array<long>")


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links of nodes (id, c1, c2, segments) that may be similar; enough for the components of all such links."""
    cosine = 2 * similarity / (1 + similarity)
    share = float(np.arccos(cosine) / np.pi)
    radius = int(128 * share + 3.5 * np.sqrt(128 * share * (1 - share)))  # of two words of the sketch
    flips = np.array([[(m >> k) & 1 for k in range(LOW)] for m in range(1 << LOW)])

    def entries(batches):
        for table in grouped(batches, 1 << 20):
            seg = table["segments"].combine_chunks().flatten().to_numpy().reshape(-1, PARTS)
            low = np.stack([1 << (seg >> (CUT + 5 * k) & 31) for k in range(LOW)])
            value = (seg & ((1 << CUT) - 1)) | np.arange(PARTS) << CUT
            keys = np.stack([value ^ (m[:, None, None] * low).sum(axis=0) for m in flips], axis=-1).reshape(len(seg), -1)
            n = keys.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(table[c].to_numpy(), n)) for c in ("id", "c1", "c2"))], ["key", "id", "c1", "c2"])

    def near(k, f):
        ids, words = f[0], [w.view(np.uint64) for w in f[1:]]
        begin, length = runs(k)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, d in neighbours(begin, length):
            at = at[sum(np.bitwise_count(w[at] ^ w[at + d]).astype(np.int64) for w in words) <= radius]
            us.append(ids[at])
            vs.append(ids[at + d])
            if sum(map(len, us)) > 1 << 18:  # dense groups: memory stays small
                us, vs = ([x] for x in stars(np.concatenate(us), np.concatenate(vs)))
        for i in np.flatnonzero(length > SHIFTED):
            lo, hi = begin[i], begin[i] + length[i]
            for u, v in forest([w[lo:hi] for w in words], radius):
                us.append(ids[lo + u])
                vs.append(ids[lo + v])
        return stars(np.concatenate(us), np.concatenate(vs))

    def together(table):
        rows = table.group_by("id").aggregate([("c1", "min"), ("c2", "min")]).sort_by("id")
        ids = rows["id"].to_numpy()
        found = forest([rows[c].to_numpy().view(np.uint64) for c in ("c1_min", "c2_min")], radius)
        u, v = (np.concatenate([np.zeros(0, np.int64), *(ids[x[i]] for x in found)]) for i in range(2))
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    keyed = nodes.select("id", "c1", "c2", "segments").mapInArrow(entries, "key long, id long, c1 long, c2 long")
    found, many = meeting(keyed.repartition("key").sortWithinPartitions("key", "id"), ["id", "c1", "c2"], TOGETHER, near)
    return thinned(found.union(settled(many.withColumn("weight", F.lit(1)), ["c1", "c2"], TOGETHER, together)))


def thinned(found: DataFrame) -> DataFrame:
    """Links (u, v), u < v, with the same components: one from each node's least neighbour to it, and few more."""
    least = F.min("u").over(Window.partitionBy("v"))
    near = found.distinct().withColumn("m", least)
    return near.select(F.col("m").alias("u"), F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v")).where("u <> v").distinct()


def settled(rows: DataFrame, payload: list[str], limit: int, link) -> DataFrame:
    """(u, v), u < v: links with the components of all links that ``link`` finds between two rows of one key.

    ``rows`` has key, id, weight and the payload; ``link`` takes a table of them. A key of more
    than ``limit`` weight is dealt out in blocks. Each block is joined for itself; then the
    least ids of what is joined, among each other. In a group of copies that leaves one large
    component and a few rows besides; only those are held against all blocks, since two rows of one
    component need no link of their own.
    """
    rows = rows.select("key", "id", "weight", *payload)
    sizes = written(rows.groupBy("key").agg(F.sum("weight").alias("w"), F.count("*").alias("k")).where("k > 1").select("key", F.ceil(F.col("w") / limit).alias("blocks")), "sizes")
    schema = "u long, v long"
    whole = rows.join(sizes.where("blocks <= 1").select("key"), "key").groupBy("key").applyInArrow(link, schema)
    hot = sizes.where("blocks > 1")
    if hot.isEmpty():
        return whole
    whole = written(whole, "links")
    dealt = written(rows.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("id"), "blocks")), "dealt")
    found = written(dealt.groupBy("key", "own").applyInArrow(link, schema), "links")

    def marked(found):
        groups = connected_components(found).select(F.col("node").alias("id"), "label")
        return written(dealt.select("key", "id", "weight").join(groups, "id", "left").select("key", "id", "weight", F.coalesce("label", "id").alias("label")), "marked")

    by = marked(found)
    roots = by.groupBy("key", "label").agg(F.min("id").alias("id")).select("key", "id")
    if 2 * roots.count() <= by.count():
        found = written(found.union(settled(dealt.join(roots, ["key", "id"]), payload, limit, link)), "links")
        by = marked(found)
    counts = by.groupBy("key", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    odd = by.join(main, "key").where("label <> main").select("key", "id", "weight")
    turns = odd.groupBy("key").agg(F.ceil(F.sum("weight") / limit).alias("turns"))
    asked = dealt.join(odd.select("key", "id"), ["key", "id"]).join(turns, "key").withColumn("turn", F.pmod(F.xxhash64("id", F.lit(7)), "turns"))
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = dealt.join(turns, "key").withColumn("turn", steps("turns")).select("key", "own", "turn", "id", *payload)
    both = own.union(asked.withColumn("own", steps("blocks")).select("key", "own", "turn", "id", *payload))
    return whole.union(found).union(both.groupBy("key", "own", "turn").applyInArrow(link, schema))


def prefixes(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(key, id): the least shingle hashes of each text, so many that two texts of ``similarity`` share one."""

    def run(batches):
        for table in grouped(batches, 4 << 20):
            keys, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, t in zip(table["id"].to_pylist(), table["text"].to_pylist(), strict=True):
                h = np.unique(shingle_hashes(t or "", words))
                h = h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1]
                keys.append(h.view(np.int64))
                ids.append(np.full(len(h), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["key", "id"])

    return texts.select("id", "text").mapInArrow(run, "key long, id long")


def verified(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(u, v): links of similar texts (id, text) among the members (key, id) of each key, enough for the components of all such links."""
    counted = members.distinct()
    several = counted.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    asked = written(counted.join(several, "key").select("key", "id"), "members")

    def run(batches):
        for table in grouped(batches, 4 << 20):
            sets = [np.unique(shingle_hashes(t or "", words)).view(np.int64) for t in table["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([table["id"].combine_chunks(), pa.array(sets, pa.list_(pa.int64()))], ["id", "hashes"])

    wanted = texts.join(asked.select("id").distinct(), "id").select("id", "text")
    sets = written(wanted.mapInArrow(run, "id long, hashes array<long>"), "sets")

    def pairs(table):
        ids, first = np.unique(table["id"].to_numpy(), return_index=True)
        hashes = table["hashes"].combine_chunks()
        u, v = similar([hashes[i].values.to_numpy() for i in first.tolist()], similarity)
        return pa.table({"u": np.minimum(ids[u], ids[v]), "v": np.maximum(ids[u], ids[v])})

    rows = asked.join(sets, "id").withColumn("weight", F.greatest(F.lit(1), F.size("hashes")).cast("long"))
    return thinned(settled(rows, ["hashes"], BLOCK_SHINGLES, pairs))


def components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id that links reach."""
    prints = written(fingerprints(docs, words), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    found = connected_components(links(nodes, radius, 2 if radius <= 5 else 4))
    linked = found.withColumnRenamed("node", "fp").join(nodes, "fp")
    named = linked.join(linked.groupBy("label").agg(F.min("least").alias("named")), "label").select("fp", "named")
    labels = nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("named", "least").alias("component_id"))
    return labelled(prints, labels, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_groups(rows: DataFrame, words: int = 5, similarity: float = 0.8, least_shingles: int = 24) -> tuple[DataFrame, DataFrame]:
    """Two tables from rows of (row, doc_id, text), ``row`` being unique: the sketches, and for
    each set of shingles (h1, h2; k rows) ``stays``, the row that stands for its group, and that row's doc_id.

    Texts with one set of shingles are one node. Fingerprints say little of few shingles: nodes
    of fewer than ``least_shingles``, and longer ones that may be similar to them, are candidates if they
    share one of their least shingle hashes, which misses none. Every link is decided by the exact
    similarity; a group is a component of the links.
    """
    spark = rows.sparkSession
    small_batches(spark)
    prints = written(sketches(rows, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "n", "c1", "c2", "segments")).alias("x")
    nodes = prints.groupBy("h1", "h2").agg(first, F.count("*").alias("k")).select("h1", "h2", "k", "x.none", "x.doc_id", F.col("x.row").alias("id"), "x.n", "x.c1", "x.c2", "x.segments")
    nodes = written(spread(nodes, "id"), "nodes")
    families = connected_components(candidates(nodes.where(F.col("n") >= least_shingles), similarity)).select(F.col("label").alias("key"), F.col("node").alias("id"))
    texts = rows.select(F.col("row").alias("id"), "text")
    short = nodes.where((F.col("n") > 0) & (F.col("n") < least_shingles / similarity)).select("id")
    # A family's key is a row number; the keys of short texts are hashes, which may equal one: that only adds a comparison.
    shared = prefixes(texts.join(short, "id"), words, similarity)
    groups = connected_components(verified(families.union(shared), texts, words, similarity))
    named = nodes.join(groups, F.col("id") == F.col("node"), "left").select("h1", "h2", "k", "none", "doc_id", "id", F.coalesce("label", "id").alias("label"))
    named = written(named, "named")
    stays = named.groupBy("label").agg(F.min(F.struct("none", "doc_id", "id")).alias("x")).select("label", F.col("x.id").alias("stays"), F.col("x.doc_id").alias("copy_of"))
    return prints, named.join(stays, "label").select("h1", "h2", "k", "stays", "copy_of")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """The documents with a number for each row, written once so that the numbers stay; as (row, doc_id, text); the column's name."""
    name = unused("row", docs.columns)
    held = written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    return held, held.select(F.col(name).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), name


def near_copies(docs: DataFrame, **how) -> DataFrame:
    """doc_id and copy_of for each row that another row of its group stands for."""
    prints, groups = near_groups(_numbered(docs)[1], **how)
    return labelled(prints.select("row", "doc_id", "h1", "h2"), groups, ["h1", "h2"], "k").where("row <> stays").select("doc_id", "copy_of")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """The documents without near copies: of each group the row with the least doc_id stays. Columns stay as they are."""
    held, rows, name = _numbered(docs)
    stays = near_groups(rows, **how)[1].select(F.col("stays").alias(name)).distinct()
    return held.join(stays, name, "left_semi").select(*docs.columns)
