"""Quality by positive-unlabelled learning.

Trusted positives are documents labelled good in the training folds; unlabelled
ones are documents without a label there, those of the other fold among them, whose labels are never
looked at. Labels of bad documents are not used. A
small network over counts of a text's characters, words and lines minimises the
non-negative unbiased risk: the positives' risk times the class prior, plus the
unlabelled texts' risk as negatives, less the positives' risk as negatives, where
the difference may not fall below zero. The prior is estimated from the two samples
too: the least ratio of the share of unlabelled texts above a threshold to that of
held-back positives, over the thresholds of a first separating score.

The samples are bounded: ``POSITIVE`` and ``UNLABELLED`` documents, those whose id's
hash is least; only their features come to the driver. Of rows that share a sampled id one is
learned from. Every text is scored whole.

Defined results: a null or empty text has zero features and scores as such; equal
texts score alike; null labels are not used; without positives, or where the training folds label
every document, so that nothing is unlabelled, every score is 1; an empty table gives an empty table. ``scored`` ignores
further columns of any name, ``kept`` keeps them.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, grouped, small_batches

POSITIVE, UNLABELLED = 4000, 8000
MARKS = b"!#$%&*|.,;:?-_=+~^@\"'()[]{}<>/\\"
FEATURES = 10 + len(MARKS)


def features(text: str) -> np.ndarray:
    """Shares of characters and words of a whole text."""
    out = np.zeros(FEATURES, np.float64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = text.split()
    n, k = len(raw), len(words)
    if not k:
        return out
    count = np.bincount(raw, minlength=256)
    upper, lower = count[65:91].sum(), count[97:123].sum()
    same = sum(map(eq, words, words[1:]))
    lines = text.split("\n")
    out[:10] = [
        np.log1p(k) / 10,
        n / k / 20,
        upper / max(1, upper + lower),
        count[48:58].sum() / n,
        count[128:].sum() / n,
        same / k,
        len(set(words)) / k,
        1 - len(set(lines)) / len(lines),
        count[10] / k,
        count[:32].sum() / n,
    ]
    out[10:] = np.sqrt(count[list(MARKS)] / k)
    return out


class Net:
    """One hidden layer of tanh units over standardised features."""

    def __init__(self, x: np.ndarray, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        d = x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def grads(self, x: np.ndarray, slope) -> list[np.ndarray]:
        z, h, g = self.forward(x)
        dg = slope(g)
        dh = dg[:, None] * self.p[2] * (1 - h**2)
        return [z.T @ dh, dh.sum(axis=0), h.T @ dg, np.array([dg.sum()])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _loss(g: np.ndarray) -> np.ndarray:
    """Logistic loss of a positive; that of a negative is the loss of -g."""
    return np.logaddexp(0, -g)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, epochs: int = 60, seed: int = 7) -> Net:
    """With a prior the non-negative risk, without one plain positives against unlabelled."""
    net = Net(np.vstack([positive, unlabelled]), seed=seed)
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    step, batches = 0, max(1, len(unlabelled) // 256)
    for _ in range(epochs):
        parts_p = np.array_split(rng.permutation(len(positive)), min(batches, len(positive)))
        parts_u = np.array_split(rng.permutation(len(unlabelled)), batches)
        for b in range(batches):
            xp, xu = positive[parts_p[b % len(parts_p)]], unlabelled[parts_u[b]]
            up = lambda n, w: lambda g: -w * _sigmoid(-g) / n  # noqa: E731  slope of the loss as a positive
            down = lambda n, w: lambda g: w * _sigmoid(g) / n
            if prior is None:
                total = [a + c for a, c in zip(net.grads(xp, up(len(xp), 1)), net.grads(xu, down(len(xu), 1)), strict=True)]
            else:
                rest = _loss(-net.forward(xu)[2]).mean() - prior * _loss(-net.forward(xp)[2]).mean()
                as_negative = [a + c for a, c in zip(net.grads(xu, down(len(xu), 1)), net.grads(xp, down(len(xp), -prior)), strict=True)]
                if rest >= 0:
                    total = [a + c for a, c in zip(net.grads(xp, up(len(xp), prior)), as_negative, strict=True)]
                else:  # undo what fits the sample too well
                    total = [-a for a in as_negative]
            step += 1
            for i, g in enumerate(total):
                g = g + 1e-4 * net.p[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g**2
                net.p[i] = net.p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from a separating score on held-back rows."""
    net = fit(positive[::2], unlabelled[::2], None, epochs=30)
    p, u = np.sort(net.forward(positive[1::2])[2]), np.sort(net.forward(unlabelled[1::2])[2])
    if not len(p) or not len(u):
        return 0.5
    t = p
    above_p = 1 - np.searchsorted(p, t) / len(p)
    above_u = 1 - np.searchsorted(u, t) / len(u)
    slack = np.sqrt(np.log(20) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)  # both shares come from samples
    best = np.argmin((above_u + slack) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> dict | None:
    if not len(positive) or not len(unlabelled):
        return None
    prior = class_prior(positive, unlabelled)
    net = fit(positive, unlabelled, prior)
    return {"net": net, "prior": prior}


def featured(docs: DataFrame) -> DataFrame:
    """Columns but the text, and ``x``: the text's features."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        for table in grouped(batches, 4 << 20):
            rows = [features(t or "") for t in table["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(table[c].combine_chunks() for c in others), pa.array(rows, pa.list_(pa.float64()))], [*others, "x"])

    schema = docs.select(*others).schema.add("x", T.ArrayType(T.DoubleType()))
    return docs.mapInArrow(run, schema)


def learned(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model. At most POSITIVE + UNLABELLED rows of features come to the driver."""
    ids = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id is not null")
    good = ids.where((F.col("quality") == 1) & (fold(5) != 0)).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVE)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    used = ids.where(F.col("quality").isNotNull() & (fold(5) != 0)).select("doc_id").distinct()
    free = plain.select("doc_id").where("doc_id is not null").distinct().join(used, "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(UNLABELLED)
    sample = good.select("doc_id", F.lit(1).alias("y")).union(free.select("doc_id", F.lit(0).alias("y")))
    rows = featured(plain.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))).toPandas()
    if not len(rows):
        return None
    x = np.stack(rows["x"].to_list())
    order = np.lexsort((*x.T[:3], rows["doc_id"]))
    x, y = x[order], rows["y"].to_numpy()[order]
    return train(x[y == 1], x[y == 0])


def _scores(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    return _sigmoid(model["net"].forward(np.stack([features(t) for t in texts]))[2]) if texts else np.zeros(0)


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = learned(docs, labels)

    def run(batches):
        for table in grouped(batches, 4 << 20):
            p = _scores(model, [t or "" for t in table["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(p)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more; columns as they are."""
    small_batches(docs.sparkSession)
    model = learned(docs, labels)
    place = docs.columns.index("text")

    def run(batches):
        for table in grouped(batches, 4 << 20):
            good = _scores(model, [t or "" for t in table.column(place).to_pylist()]) >= least
            yield from table.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(run, docs.schema)
