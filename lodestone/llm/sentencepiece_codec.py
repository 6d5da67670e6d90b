"""SentencePiece encoding by suffix-array matching, and decoding.

New units of a batch are joined into one text, whose suffixes are sorted as far
as the longest piece reaches. A binary search finds the range of suffixes that
begin with each piece of the vocabulary; every suffix of a range is an edge. The
edges are sorted by position and relaxed (see ``bpe``).

Defined results: a null text counts as empty and has no ids; equal texts give
equal ids; an empty table gives an empty table; further columns, whatever their
names, are ignored; a null doc_id stays null. Texts are processed whole. Decoding null ids gives an
empty text; nulls among ids are passed over, control pieces give nothing and the unknown piece
gives the library's mark; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import grouped, small_batches
from .token_counts import slices

#: Units whose ids a worker keeps; then it starts anew. Results don't depend on it.
KEPT_UNITS = 800_000
WORD = 4  # letters packed into one integer


def _packed(letters: np.ndarray, bits: int) -> np.ndarray:
    """Letters of each position and the next three as one integer; zeros past the end."""
    padded = np.concatenate([letters, np.zeros(WORD, np.int64)])
    out = np.zeros(len(letters), np.int64)
    for k in range(WORD):
        out = out << bits | padded[k : k + len(letters)]
    return out


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
    return out


def suffix_array(packed: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the ``depth`` letters that begin there, by prefix doubling."""
    order = np.argsort(packed)
    reach = WORD
    rank = _ranks(packed, order)
    while reach < depth:
        ahead = np.concatenate([rank[reach:], np.full(min(reach, len(rank)), -1)])
        keys = rank * (len(rank) + 1) + ahead + 1
        order = np.argsort(keys)
        rank = _ranks(keys, order)
        reach *= 2
    return order


class Matcher:
    """Pieces of a vocabulary as packed words, for binary search in suffix arrays."""

    def __init__(self, m: bpe.Bpe):
        self.model = m
        top = int(m.letter.max()) + 1
        self.bits = int(top).bit_length()
        if self.bits * WORD > 62:
            raise ValueError("too many letters")
        self.words = -(-m.longest // WORD)
        use = [k for k in range(len(m.pieces)) if m.reachable[k]]
        self.piece = np.array(use, np.int32)
        low = np.zeros((len(use), self.words * WORD), np.int64)
        high = np.full((len(use), self.words * WORD), (1 << self.bits) - 1, np.int64)
        for i, k in enumerate(use):
            row = m.letter[[ord(c) for c in m.pieces[k]]]
            low[i, : len(row)] = high[i, : len(row)] = row
        pack = lambda x: np.stack([sum(x[:, w * WORD + j] << self.bits * (WORD - 1 - j) for j in range(WORD)) for w in range(self.words)])
        self.low, self.high = pack(low), pack(high)

    def _search(self, packed: np.ndarray, order: np.ndarray, target: np.ndarray, after: bool) -> np.ndarray:
        """For each target the first suffix that is not before it (``after``: that is after it)."""
        n = len(order)
        lo, hi = np.zeros(target.shape[1], np.int64), np.full(target.shape[1], n, np.int64)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            at = order[np.minimum(mid, n - 1)]
            less, equal = np.zeros(len(at), bool), np.ones(len(at), bool)
            for w in range(self.words):
                word = packed[np.minimum(at + w * WORD, n - 1)]
                less |= equal & (word < target[w])
                equal &= word == target[w]
            go = (less | equal & after) & (lo < hi)
            stay = ~go & (lo < hi)
            lo[go] = mid[go] + 1
            hi[stay] = mid[stay]
        return lo

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence (start, end, piece) in the joined text; zeros in ``codes`` part its units."""
        m = self.model
        top = np.int64((1 << self.bits) - 1)
        letters = m.letter[codes].astype(np.int64)
        unknown = (letters == 0) & (codes != SEPARATOR)
        letters[unknown] = top  # like no letter of any piece
        packed = _packed(np.concatenate([letters, np.zeros(self.words * WORD, np.int64)]), self.bits)
        order = suffix_array(packed, m.longest)
        lo = self._search(packed, order, self.low, False)
        hi = self._search(packed, order, self.high, True)
        many = hi - lo
        piece = np.repeat(self.piece, many)
        start = order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        lost = np.flatnonzero(unknown)
        start = np.concatenate([start, lost])
        piece = np.concatenate([piece, np.full(len(lost), m.unknown, np.int32)])
        return start, start + m.length[piece], piece


#: Parts the units of a joined text; the first number that is no code point.
SEPARATOR = 0x110000


class Codec:
    def __init__(self, data: bytes):
        self.model = bpe.model(data)
        self.matcher = Matcher(self.model)
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        m = self.model
        self.surface = {int(i): p for p, i in zip(m.pieces, m.ids, strict=True)}
        # Bytes above 127 take the form that the surrogateescape handler turns back into bytes.
        self.surface |= {int(i): chr(b) if b < 128 else chr(0xDC00 + b) for b, i in enumerate(m.byte_ids)}
        self.surface |= m.special

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > KEPT_UNITS:
            self.known.clear()
        new = set().union(*texts) - self.known.keys()
        for part in slices(new, 800_000):
            self.known.update(zip(part, self.unit_ids(part), strict=True))

    def unit_ids(self, units: list[str]) -> list[bytes]:
        m = self.model
        codes, starts, _ = bpe.joined(units)
        lengths = np.append(starts[1:], len(codes)) - starts
        shift = np.repeat(np.arange(len(units)), lengths)
        spaced = np.full(len(codes) + len(units), SEPARATOR, np.uint32)
        spaced[np.arange(len(codes)) + shift] = codes
        s, e, p = self.matcher.edges(spaced)
        # Back to positions without separators.
        plain = np.cumsum(spaced != SEPARATOR) - 1
        s, e = plain[s], plain[s] + (e - s)
        last, _ = m.relax(starts, len(codes), (s, e, p), bpe.utf8_widths(codes))
        ids, at = m.traced(starts, last, codes)
        raw = ids.astype(np.int32).tobytes()
        at = (at * 4).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        units = [bpe.units_of(t) for t in texts]
        self.learn(units)
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), np.int32) for x in units]

    def decode(self, ids: np.ndarray) -> str:
        try:
            parts = [self.surface[i] for i in ids.tolist()]
        except KeyError as unknown:
            raise ValueError(f"no piece has the id {unknown}") from None
        while parts and not parts[0]:  # control pieces come before the space that the model puts in front
            parts.pop(0)
        text = "".join(parts).replace(bpe.SPACE, " ")
        text = text[1:] if parts and parts[0].startswith(bpe.SPACE) else text
        return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def encoded(docs: DataFrame, data: bytes) -> DataFrame:
    """doc_id and ``ids``, the text's piece ids."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = Codec(data)
        for table in grouped(batches, 4 << 20):
            rows = codec.encode([t or "" for t in table["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), _lists(rows)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(rows) if rows else np.zeros(0, np.int32))


def decoded(tokens: DataFrame, data: bytes) -> DataFrame:
    """doc_id and ``text`` from rows of doc_id and ids; null ids give an empty text."""
    small_batches(tokens.sparkSession)

    def run(batches):
        codec = Codec(data)
        for table in grouped(batches, 4 << 20):
            texts = [codec.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in table["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, data: bytes) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids, decoded_sha256, and whether decoding the ids gives the text again.

    Decoding turns U+2581, which stands for a space in pieces, into a space; a
    text that holds it is compared with that form.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        codec = Codec(data)
        for table in grouped(batches, 4 << 20):
            texts = [t or "" for t in table["text"].to_pylist()]
            rows = codec.encode(texts)
            back = [codec.decode(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    table["doc_id"].combine_chunks(),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([len(r) for r in rows], pa.int64()),
                    _lists(rows),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array([b == t.replace(bpe.SPACE, " ") for b, t in zip(back, texts, strict=True)]),
                ],
                ["doc_id", "n_bytes", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")
