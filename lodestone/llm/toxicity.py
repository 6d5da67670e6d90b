"""Toxicity by a support vector machine over gapped subsequence kernels.

Two kernels compare strings of letters. One counts the letter triples that both hold in
order within six letters, less the further they are spread, with marks for a word's
begin and end; inflected forms of one stem are alike under it. The other counts fours within eight
letters nearly alike however they are spread; an insult with letters put in keeps most of its
fours, and no other word has many of them. Each is the cosine of those counts, sharpened.

A sentence's kernel value with a landmark is the greatest of its strings: its words, the
parts between marks inside a word, the word without its marks, windows of long words, and letters
that stand alone in a row. Sentences stand for their Nyström coordinates, kernel values with a set
of landmark insults times the inverse root of the landmarks' own kernel. A linear
machine over these coordinates separates sentences that hold an insult from those of clean documents.
Labels are of documents: a toxic document's sentences with a word that marks toxic documents are positive,
without such a word the one that scores highest, chosen again after each fit. Each insult is also
learned with one and two letters put in. A text scores as its highest sentence; a
logistic curve over that score gives the probability.

Landmarks and machine come from labelled rows of the training folds: at most
``TOXIC`` toxic and ``CLEAN`` clean documents, those whose id's hash is least. Every
text is scored whole, and only by its words. An insult parted by a single space, or
glued into a longer word of up to ``PIECE`` letters, is seen only as far as the kernels reach.

Defined results: a null or empty text scores as text without an insult; rows with
equal texts score alike; null labels are not used; with no toxic or no clean label to
learn from every score is 0; an empty table gives an empty table. Of rows that share a
sampled id one is learned from. ``scored`` ignores further columns of any name, ``kept`` keeps them.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, grouped, small_batches

TOXIC, CLEAN = 1500, 4000  # documents to learn from
LANDMARKS, LIKE = 56, 0.66
DECAY, SPAN = 0.7, 6
PIECE = 24  # letters of a word that are looked at together; longer words are cut with overlap
FOURS_DECAY, FOURS_SPAN = 0.95, 8
CLEAN_COST = 6.0  # of a sentence of clean documents on the wrong side
MARK_COST = 20.0  # of the sentences with a word that marks toxic documents, for each such word
VARIANTS, VARIANT_COST = 12, 3.0  # forms of an insult with one letter put in, and as many with two
WIDTH, FLOOR = 0.2, 0.5  # of the kernel of triples: its fall from 1, and where it ends
FOURS_WIDTH, FOURS_FLOOR = 0.5, 0.25
KEPT_WORDS = 200_000  # rows of values that a worker keeps; results don't depend on it
WORDS_AT_ONCE = 8_000
ENDS = frozenset(".!?…。！？")
EDGE = re.compile(r"^\W+|\W+$")
MARK = re.compile(r"[\W_]+")


def words_of(line: str) -> list[str]:
    """Lower-case words of a line; runs of three or more single letters also count as one word, at the line's end."""
    words = line.lower().split()
    if list(map(len, words)).count(1) >= 3:
        run: list[str] = []
        for w in [*words, ".."]:
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) >= 3:
                words.append("".join(run))
            run = []
    return words


def pieces_of(word: str) -> list[str]:
    """A word without marks around it, without any marks, and its parts between marks; long ones in overlapping windows."""
    if not word.isalnum():
        word = EDGE.sub("", word)
    if word.isalnum():
        if len(word) <= PIECE:  # most words
            return [word] if len(word) >= 3 else []
        found = [word]
    else:
        found = [word, MARK.sub("", word), *(p for p in MARK.split(word) if len(p) >= 3)]
    out = []
    for w in found:
        out += [w] if len(w) <= PIECE else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return list(dict.fromkeys(p for p in out if len(p) >= 3))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each letter of the joined words, the number of its word, and how many letters the word has from there."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    latin = (codes >= 97) & (codes <= 122)
    letter = np.where(latin, codes - 96, np.where(codes < 3, codes + 61, 27 + codes % 35))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    return letter, word, np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))


def fours(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, four, value) of the letter fours of each word, scaled to length one."""
    letter, word, left = _letters(words)
    names, keys, weights = [], [], []
    for rest in combinations(range(1, FOURS_SPAN), 3):
        at = np.flatnonzero(left > rest[-1])
        key = letter[at]
        for k in rest:
            key = key << 6 | letter[at + k]
        names.append(word[at])
        keys.append(key)
        weights.append(np.full(len(at), FOURS_DECAY ** (rest[-1] - 3)))
    both, back = np.unique(np.concatenate(names) << 24 | np.concatenate(keys), return_inverse=True)
    value = np.bincount(back, np.concatenate(weights), len(both))
    word, key = both >> 24, both & ((1 << 24) - 1)
    norm = np.sqrt(np.bincount(word, value**2, len(words)))
    return word, key, value / np.maximum(norm, 1e-9)[word]


def histograms(words: list[str]) -> np.ndarray:
    """How often each word has each letter class."""
    letter, word, _ = _letters(words)
    return np.bincount(word * 64 + letter, minlength=64 * len(words)).reshape(-1, 64).astype(np.int8)


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, triple, weight) of every occurrence; letters fall into 64 classes, marks for a word's begin and end among them."""
    letter, word, left = _letters([f"\x01{w}\x02" for w in words])
    out = []
    for last in range(2, SPAN):
        at = np.flatnonzero(left > last)
        for mid in range(1, last):
            out.append((word[at], letter[at] << 12 | letter[at + mid] << 6 | letter[at + last], np.full(len(at), DECAY ** (last + 1), np.float32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def coordinates(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``triples`` with each word's weights scaled to its occurrences' root energy."""
    word, triple, weight = triples(words)
    energy = np.sqrt(np.bincount(word, weight.astype(np.float64) ** 2, len(words)))
    return word, triple, weight / np.maximum(energy, 1e-9)[word]


class Kernel:
    """Values of words with the landmarks under the kernel of triples, and with the insults among them under that of fours.

    Each is a cosine, sharpened: it falls by a factor of e with each ``WIDTH`` that it
    lies below 1, and counts as none below ``FLOOR``.
    """

    def __init__(self, landmarks: list[str], insults: list[str]):
        self.landmarks, self.insults = landmarks, insults
        self.width = len(landmarks) + len(insults)
        word, triple, weight = coordinates(landmarks)
        known, slot = np.unique(triple, return_inverse=True)
        self.slot = np.full(1 << 18, -1, np.int32)
        self.slot[known] = np.arange(len(known))
        self.table = np.zeros((len(known), len(landmarks)), np.float32)
        np.add.at(self.table, (slot, word), weight)
        self.table /= np.maximum(np.linalg.norm(self.table, axis=0), 1e-9)
        # No cosine exceeds the sum over a word's triples of their greatest weight in any landmark.
        self.most = np.zeros(1 << 18, np.float32)
        self.most[known] = self.table.max(axis=1, initial=0)
        if insults:
            self.counts = histograms(insults)
            word, key, value = fours(insults)
            self.keys, slot = np.unique(key, return_inverse=True)
            self.by_four = np.zeros((len(self.keys), len(insults)), np.float32)
            self.by_four[slot, word] = value

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that have a value, in order, and their rows of values: triples, then fours."""
        n = len(self.landmarks)
        rows, at = [np.zeros((0, self.width), np.float32)], [np.zeros(0, np.int64)]
        for lo in range(0, len(words), WORDS_AT_ONCE):
            part = words[lo : lo + WORDS_AT_ONCE]
            (a, x), (b, y) = self._values(part), self._by_fours(part)
            some = np.union1d(a, b)
            row = np.zeros((len(some), self.width), np.float32)
            row[np.searchsorted(some, a), :n] = x
            row[np.searchsorted(some, b), n:] = y
            at.append(some + lo)
            rows.append(row)
        return np.concatenate(at), np.concatenate(rows)

    def _by_fours(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros((0, len(self.insults)), np.float32)
        if not self.insults:
            return none
        # Words of k letters in common have no more than C(k, 4) fours in common; most words are told apart by that.
        counts = histograms(words)
        length = counts.sum(axis=1)
        choose = np.array([n * (n - 1) * (n - 2) * (n - 3) / 24 for n in range(PIECE + 4)])
        near = np.zeros(len(words), bool)
        for c in self.counts:
            has, n = np.flatnonzero(c), int(c.sum())
            common = np.minimum(counts[:, has], c[has]).sum(axis=1)
            near |= choose[common] >= 0.7 * FOURS_FLOOR * np.sqrt(choose[min(n, FOURS_SPAN)] * choose[np.minimum(length, FOURS_SPAN)])
        at = np.flatnonzero(near & (length >= 4))
        if not len(at) or not len(self.keys):
            return none
        word, key, value = fours([words[i] for i in at])
        slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[slot] == key
        word, slot, value = word[hit], slot[hit], value[hit].astype(np.float32)
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        if not len(begin):
            return none
        cosine = np.add.reduceat(value[:, None] * self.by_four[slot], begin, axis=0)
        rows = np.where(cosine >= FOURS_FLOOR, np.exp((cosine - 1) / FOURS_WIDTH), 0).astype(np.float32)
        some = rows.any(axis=1)
        return at[word[begin]][some], rows[some]

    def _values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word, triple, weight = coordinates(words)
        bound = np.bincount(word, weight * self.most[triple], len(words))
        use = (bound >= FLOOR)[word]
        word, triple, weight = word[use], triple[use], weight[use]
        # Triples that a word repeats add up before they are squared: the exact norms of the few words left.
        key, back = np.unique(word << 18 | triple, return_inverse=True)
        norm = np.sqrt(np.bincount(key >> 18, np.bincount(back, weight) ** 2, len(words)))
        slot = self.slot[triple]
        word, slot, weight = word[slot >= 0], slot[slot >= 0], weight[slot >= 0]
        order = np.argsort(word, kind="stable")
        word, slot, weight = word[order], slot[order], weight[order].astype(np.float32)
        begin = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(word))
        out, at = [np.zeros((0, self.table.shape[1]), np.float32)], word[begin[:-1]]
        for lo in range(0, len(at), 1000):
            a, b = begin[lo], begin[min(lo + 1000, len(at))]
            out.append(np.add.reduceat(weight[a:b, None] * self.table[slot[a:b]], begin[lo : min(lo + 1000, len(at))] - a, axis=0))
        cosine = np.concatenate(out) / norm[at].astype(np.float32)[:, None]
        rows = np.where(cosine >= FLOOR, np.exp((cosine - 1) / WIDTH), 0).astype(np.float32)
        some = rows.any(axis=1)
        return at[some], rows[some]


def variants(word: str) -> list[str]:
    """Forms of the word with one letter put in, and with two; drawn by the word itself."""
    rng = np.random.default_rng(zlib.crc32(word.encode("utf-8", "surrogatepass")))
    out = []
    for k in (1, 2):
        for _ in range(VARIANTS):
            w = word
            for _ in range(k):
                i = int(rng.integers(1, len(w)))
                w = w[:i] + chr(97 + int(rng.integers(26))) + w[i:]
            out.append(w)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and offset of a linear machine with squared hinge loss, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = ridge * w - 2 * x[on].T @ (cost[on] * y[on] * slack[on])
        hess = np.diag(ridge) + 2 * (x[on].T * cost[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic_curve(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability over a score, with targets kept off 0 and 1."""
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x = np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -35, 35)))
        hess = (x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2)
        ab -= np.linalg.solve(hess, x.T @ (p - t) + 1e-3 * ab)
    return float(ab[0]), float(ab[1])


def unlike(words: list[str]) -> list[str]:
    """Up to LANDMARKS of the words, in order, without those much like an earlier one."""
    out: list[str] = []
    for w in words:
        if len(out) == LANDMARKS:
            break
        if not out or not (Kernel(out, []).values([w])[1] > np.exp((LIKE - 1) / WIDTH)).any():
            out.append(w)
    return out


class Values:
    """Rows of kernel values of words, remembered: of a word the greatest of its pieces."""

    def __init__(self, kernel: Kernel):
        self.kernel, self.rows, self.used = kernel, np.zeros((1024, kernel.width), np.float32), 0
        self.seen: set[str] = set()
        self.place: dict[str, int] = {}  # rows of the words that have a value

    def learn(self, words: set[str]) -> None:
        new = words - self.seen
        self.seen |= new
        plain = [w for w in new if 3 <= len(w) <= PIECE and w.isalnum()]  # most words, each a single piece
        owner = plain + [w for w in new.difference(plain) for _ in pieces_of(w)]
        pieces = plain + [p for w in new.difference(plain) for p in pieces_of(w)]
        for lo in range(0, len(pieces), WORDS_AT_ONCE):
            at, rows = self.kernel.values(pieces[lo : lo + WORDS_AT_ONCE])
            while self.used + len(at) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            for i, row in zip((at + lo).tolist(), rows, strict=True):
                k = self.place.get(owner[i])
                if k is None:
                    self.place[owner[i]] = self.used
                    self.rows[self.used] = row
                    self.used += 1
                else:
                    np.maximum(self.rows[k], row, out=self.rows[k])

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """Of the sentences that have any values: their texts' numbers, their rows, and the words that have them."""
        if len(self.seen) > KEPT_WORDS:
            self.seen.clear()
            self.place.clear()
            self.used = 0
        cut = [[words_of(line) for line in t.split("\n")] for t in texts]
        self.learn(set().union(*(ws for lines in cut for ws in lines)))
        place, of, at, begin, held = self.place, [], [], [], []
        for i, lines in enumerate(cut):
            for ws in lines:
                if place.keys().isdisjoint(ws):
                    continue
                some: list[str] = []
                for w in [*ws, "."]:  # a word that ends with a full stop or the like ends its sentence
                    if w in place:
                        some.append(w)
                    if w[-1] in ENDS and some:
                        of.append(i)
                        begin.append(len(at))
                        at += [place[x] for x in some]
                        held.append(some)
                        some = []
        out = [np.zeros((0, self.kernel.width), np.float32)]
        for lo in range(0, len(begin), 2000):
            hi = min(lo + 2000, len(begin))
            a, b = begin[lo], begin[hi] if hi < len(begin) else len(at)
            out.append(np.maximum.reduceat(self.rows[at[a:b]], np.array(begin[lo:hi]) - a, axis=0))
        return np.array(of, np.int64), np.concatenate(out), held


def train(texts: list[str], labels: list[int]) -> dict | None:
    """Landmarks, weights of kernel values, and the curve. Equal texts count once."""
    seen = dict(zip(texts, labels, strict=True))
    bags: list[tuple[set[str], int]] = []
    once: dict[str, str] = {}  # one object for each word
    for t, y in seen.items():
        bags.append(({once.setdefault(p, p) for w in set(words_of(t)) for p in pieces_of(w)}, y))
    toxic, clean = [b for b, y in bags if y == 1], [b for b, y in bags if y == 0]
    if not toxic or not clean:
        return None
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    # A passage that documents share says the same of all its words: a word counts once for each pair of neighbours.
    around: dict[str, set[int]] = {w: set() for w, n in in_toxic.items() if n > 1 and w not in in_clean}
    for t, y in seen.items():
        words = words_of(t) if y == 1 else []
        for before, w, after in zip(["", *words], words, [*words[1:], ""], strict=False):
            for p in pieces_of(w):
                if p in around:
                    around[p].add(zlib.crc32(f"{before} {after}".encode("utf-8", "surrogatepass")))
    in_toxic = Counter({w: min(n, len(around[w])) if w in around else n for w, n in in_toxic.items()})
    # Words that mark toxic documents, those most often met first.
    odds = {w: (n / len(toxic)) / ((in_clean[w] + 0.5) / len(clean)) for w, n in in_toxic.items()}
    # So many toxic documents must hold a word that, were labels drawn at random, not one word would be expected to reach it without a clean one.
    met = Counter((in_toxic + in_clean).values())
    often = max(2, round(0.01 * len(toxic)))
    while met[often] * (len(toxic) / len(bags)) ** often > 0.5:
        often += 1
    marked = sorted((w for w in in_toxic if odds[w] > 3 and 3 * in_toxic[w] > often), key=lambda w: (-in_toxic[w] * (in_clean[w] == 0), -odds[w], w))
    landmarks = unlike(marked)
    if not landmarks:
        return None
    # Words that many toxic documents and no clean one hold mark their sentences from the start.
    firm = {w for w in marked if in_toxic[w] >= often and not in_clean[w]}
    if not firm:
        return None
    # Those met half as often again as chance allows are insults, to be known with letters put in as well.
    insults = [w for w in landmarks if w in firm and len(w) >= 4 and 2 * in_toxic[w] >= 3 * often]
    kernel = Kernel(landmarks, insults)
    n, width = len(landmarks), kernel.width

    def rows_of(words):
        out = np.zeros((len(words), width))
        at, rows = kernel.values(words)
        out[at] = rows
        return out

    root = np.zeros((width, width))
    for part, words in ((slice(0, n), landmarks), (slice(n, width), insults)):
        own = rows_of(words)[:, part]
        value, vector = np.linalg.eigh((own + own.T) / 2)
        root[part, part] = (vector / np.sqrt(np.maximum(value, 1e-2))) @ vector.T  # inverse root
    values, texts = Values(kernel), list(seen)
    marked_x, marked_cost, free, clean_x, best = [], [], [], {bytes(4 * width)}, []
    for lo in range(0, len(texts), 50):
        of, rows, held = values.sentences(texts[lo : lo + 50])
        for i in range(min(50, len(texts) - lo)):
            a, b = np.searchsorted(of, [i, i + 1])
            best.append(np.unique(rows[a:b], axis=0))
            if seen[texts[lo + i]] != 1:
                clean_x.update(map(bytes, best[-1]))
                continue
            sure = [max((in_toxic[p] for w in ws for p in pieces_of(w) if p in firm), default=0) for ws in held[a:b]]
            marked_x += [r for r, k in zip(rows[a:b], sure, strict=True) if k]
            marked_cost += [min(1.0, k / (2 * often)) for k in sure if k]
            if b > a and not any(sure):
                free.append(best[-1] @ root)
    marked_x = np.stack(marked_x) @ root
    clean_x = np.frombuffer(b"".join(sorted(clean_x)), np.float32).reshape(-1, width) @ root
    changed = rows_of(sorted({v for w in insults for v in variants(w)} - set(in_clean))) @ root
    each = MARK_COST * len(firm) / len(marked_x)  # as if each word had one sentence
    w = None
    for _ in range(3):
        picked = [x[np.argmax(x @ w[:-1])] for x in free] if w is not None else []
        picked = np.array([x for x in picked if x @ w[:-1] + w[-1] > 0]).reshape(-1, width)
        x = np.vstack([clean_x, marked_x, picked, changed])
        y = np.concatenate([-np.ones(len(clean_x)), np.ones(len(x) - len(clean_x))])
        cost = np.concatenate([np.where(clean_x.any(axis=1), CLEAN_COST, CLEAN_COST * 100), each * np.array(marked_cost), np.full(len(picked), each), np.full(len(changed), VARIANT_COST)])
        w = fit_svm(x, y, cost)
    beta, offset = root @ w[:-1], float(w[-1])
    f = np.array([max([offset, *(x @ beta + offset)]) for x in best])
    slope, shift = logistic_curve(np.minimum(f, 1), np.array([y for _, y in bags]))
    return {"landmarks": landmarks, "insults": insults, "beta": beta, "offset": offset, "slope": max(slope, 1e-3), "shift": shift}


class Scorer:
    def __init__(self, model: dict):
        self.model, self.values = model, Values(Kernel(model["landmarks"], model["insults"]))

    def scores(self, texts: list[str]) -> np.ndarray:
        top = np.full(len(texts), self.model["offset"])
        for lo in range(0, len(texts), 200):
            of, rows, _ = self.values.sentences(texts[lo : lo + 200])
            np.maximum.at(top, of + lo, rows @ self.model["beta"] + self.model["offset"])
        # Beyond the margin a sentence is toxic without doubt.
        return 1 / (1 + np.exp(-np.clip(self.model["slope"] * np.minimum(top, 1) + self.model["shift"], -35, 35)))


def learned(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model from the training folds, fitted in one task over at most TOXIC + CLEAN documents; only the model comes to the driver."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(F.col("doc_id").isNotNull() & (fold(3) != 1))
    pick = lambda y, n: known.where(F.col("toxic") == y).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, TOXIC).union(pick(0, CLEAN))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def fit(batches):
        tables = [pa.Table.from_batches([b]) for b in batches]
        if tables:
            rows = pa.concat_tables(tables).sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
            model = train([t or "" for t in rows["text"].to_pylist()], rows["toxic"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(fit, "model binary").collect()
    return pickle.loads(made[0].model) if made else None


@lru_cache(maxsize=1)
def scorer(model: bytes) -> Scorer | None:
    """The scorer of a pickled model, kept by a worker from task to task with the values of words that it has seen."""
    held = pickle.loads(model)
    return Scorer(held) if held else None


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = pickle.dumps(learned(docs, labels))

    def run(batches):
        by = scorer(model)
        for table in grouped(batches, 4 << 20):
            texts = [t or "" for t in table["text"].to_pylist()]
            p = by.scores(texts) if by else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array(p)], ["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The documents that don't score ``least`` or more; columns as they are."""
    small_batches(docs.sparkSession)
    model = pickle.dumps(learned(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        by = scorer(model)
        for table in grouped(batches, 4 << 20):
            texts = [t or "" for t in table.column(place).to_pylist()]
            good = by.scores(texts) < least if by else np.ones(len(texts), bool)
            yield from table.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(run, docs.schema)
