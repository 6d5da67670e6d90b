"""Exact token counts of every prefix of a text, by prefix dynamic programming.

For each unit of text (see ``bpe``) the relaxation gives the last piece and the
number of ids of every prefix. The count of a text's prefix is the sum over the
units before it plus the count inside the unit in which it ends. What is stored are
steps, by how much the count changes from one prefix to the next, in one signed byte each (-128 stands before
a step of four bytes, for one that a byte doesn't hold): a
text's steps are those of its units in a row, and counts are their running sum. So counts,
truncation points and budget questions are answered from stored steps, without a second encoding.

Defined results: a null text counts as empty (0 tokens, 0 bytes, no steps); equal rows give
equal rows; an empty table gives an empty table; further columns of the input,
whatever their names, are ignored; a null doc_id stays null. Null steps count as those of an
empty text. Texts are processed whole and one batch of texts is held in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import grouped, small_batches

#: Units whose counts a worker keeps; then it starts anew. Results don't depend on it.
KEPT_UNITS = 600_000
#: Characters of new units relaxed at once, which bounds memory.
CHARACTERS = 400_000


def model_bytes(path: str | None = None) -> bytes:
    """The model file, read on the driver; executors get its bytes with the task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def slices(units: Iterable[str], most: int = CHARACTERS) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for u in units:
        held.append(u)
        size += len(u)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def unit_prefixes(m: bpe.Bpe, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts at every prefix of the joined units, and where each unit begins."""
    codes, starts, stop = bpe.joined(units)
    widths = bpe.utf8_widths(codes)
    _, count = m.relax(starts, len(codes), m.trie_edges(codes, stop), widths)
    return count, starts


def packed(steps: np.ndarray) -> bytes:
    """Steps in a byte each, and where that doesn't hold one, -128 and then four bytes."""
    if np.abs(steps.astype(np.int64)).max(initial=0) <= 127:
        return steps.astype(np.int8).tobytes()
    return b"".join(int(x).to_bytes(1, "little", signed=True) if abs(x) <= 127 else b"\x80" + int(x).to_bytes(4, "little", signed=True) for x in steps.tolist())


def unpacked(raw: bytes) -> np.ndarray:
    out = np.frombuffer(raw, np.int8)
    wide = np.flatnonzero(out == -128)
    if not len(wide):
        return out
    steps, at = [], 0
    for k in wide.tolist():
        if k >= at:  # else it is one of the four bytes of a step before
            steps += [out[at:k].astype(np.int64), np.array([int.from_bytes(raw[k + 1 : k + 5], "little", signed=True)])]
            at = k + 5
    return np.concatenate([*steps, out[at:].astype(np.int64)])


class Counter:
    """Steps of units, remembered between texts."""

    def __init__(self, data: bytes):
        self.model = bpe.model(data)
        self.known: dict[str, bytes] = {}  # signed bytes

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.known) > KEPT_UNITS:
            self.known.clear()
        new = set().union(*texts) - self.known.keys()
        for part in slices(new):
            count, starts = unit_prefixes(self.model, part)
            step = np.diff(count, prepend=np.int32(0))
            step[starts] = count[starts]
            begins, ends = starts.tolist(), [*starts.tolist()[1:], len(step)]
            if np.abs(step).max(initial=0) > 127:
                self.known.update((u, packed(step[a:b])) for u, a, b in zip(part, begins, ends, strict=True))
                continue
            raw = step.astype(np.int8).tobytes()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, begins, ends)), strict=True))

    def steps(self, units: list[str]) -> np.ndarray:
        """Change of the count from each prefix of the text to the next; as many as the text has characters."""
        if not units:
            return np.zeros(0, np.int8)
        out = unpacked(b"".join(map(self.known.__getitem__, units)))
        # The space that the model puts in front belongs to the first character.
        first = out[:1].astype(np.int64) + out[1:2]
        return np.concatenate([first if np.abs(first).max(initial=0) > 127 else first.astype(out.dtype), out[2:]])


def fit(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    good = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(good[-1]) + 1 if len(good) else 0


def prefix_counts(data: bytes, text: str) -> np.ndarray:
    """Tokens of text[:i] for every i from 0 to the length."""
    counter, units = Counter(data), bpe.units_of(text)
    counter.learn([units])
    return np.concatenate([[0], np.cumsum(counter.steps(units), dtype=np.int64)])


def fitted(stored: DataFrame, budget: int) -> DataFrame:
    """doc_id, n_tokens and fit_chars, the longest prefix within ``budget`` in characters, from rows of doc_id and prefix_steps."""
    small_batches(stored.sparkSession)

    def run(batches):
        for table in grouped(batches, 4 << 20):
            rows = [unpacked(x or b"") for x in table["prefix_steps"].to_pylist()]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array([int(r.sum(dtype=np.int64)) for r in rows], pa.int64()), pa.array([fit(r, budget) for r in rows], pa.int64())], ["doc_id", "n_tokens", "fit_chars"])

    return stored.select(F.col("doc_id").cast("long"), F.col("prefix_steps").cast("binary")).mapInArrow(run, "doc_id long, n_tokens long, fit_chars long")


def with_prefix_counts(stored: DataFrame) -> DataFrame:
    """doc_id and ``prefix_tokens``: the count of every prefix, from the empty one, from rows of doc_id and prefix_steps."""
    small_batches(stored.sparkSession)

    def run(batches):
        for table in grouped(batches, 1 << 20):
            rows = [np.concatenate([[0], np.cumsum(unpacked(x or b""), dtype=np.int64)]) for x in table["prefix_steps"].to_pylist()]
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "prefix_tokens"])

    return stored.select(F.col("doc_id").cast("long"), F.col("prefix_steps").cast("binary")).mapInArrow(run, "doc_id long, prefix_tokens array<long>")


def token_counts(docs: DataFrame, data: bytes, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (the longest prefix within ``limit``, in characters), and prefix_steps, one signed byte for each character (see ``packed``)."""
    small_batches(docs.sparkSession)

    def run(batches):
        counter = Counter(data)
        for table in grouped(batches, 4 << 20):
            texts = [t or "" for t in table["text"].to_pylist()]
            units = [bpe.units_of(t) for t in texts]
            counter.learn(units)
            rows = [counter.steps(u) for u in units]
            tokens = [int(r.sum(dtype=np.int64)) for r in rows]
            fits = [len(r) if n <= limit else fit(r, limit) for r, n in zip(rows, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(fits, pa.int64()), pa.array([packed(r) for r in rows], pa.binary())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars", "prefix_steps"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long, prefix_steps binary")
