"""Counting, cutting and packing text by a tokenizer that is given.

A tokenizer is a function that takes a list of texts and returns how many tokens each has; tokens need not follow
words, nor add up over them. What is asked of it must only not fall as words are added to a text. It runs in
Python workers, once for what many texts of an Arrow batch ask at a time, so that a model's own batching counts; what is
asked at once stays below ``HELD`` characters, since tokenizers hold many times that.
Words lie between ASCII white space; null texts are taken for empty ones.

Largest fitting runs of words are found by doubling and halving: a piece of n words asks for some 2 log n counts of texts of at
most 2n words, so that a text's cost grows with its length, however long it is.

Many tokenizers never let a token reach from a word into the white space after it. Of one that says so (``apart``), white space with
the word after it is counted once for each worker and looked up from then on; what is asked of longer texts are sums, by the same steps.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Generator, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Count = Callable[[list[str]], list[int]]
#: A walk yields texts to be counted, is sent their counts one by one, and returns what it makes of its text. What has their counts already yields these.
Walk = Generator[str | int, int, object]

#: Characters of texts that are walked side by side, and of what is counted at once; a longer text goes by itself.
HELD = 1 << 19

#: Runs whose counts a worker remembers, and characters of the longest one.
REMEMBERED, LONGEST = 1 << 19, 64

_BLANK = " \t\n\x0b\f\r"
_WORD = re.compile(f"[^{_BLANK}]+")
#: A word with the white space before it, and white space that isn't one space.
_RUN = re.compile(f"[{_BLANK}]*[^{_BLANK}]+")
_UNEVEN = re.compile(f"[{_BLANK[1:]}]|  ")
#: A word that ends in white space beyond ASCII, which may belong together with what follows.
_OPEN_END = re.compile(f"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff](?:[{_BLANK}]|\\Z)")


def quarters(texts: list[str]) -> list[int]:
    """A rough tokenizer without a vocabulary: four characters, spaces included, are a token."""
    return [-(-len(t) // 4) for t in texts]


@lru_cache(maxsize=4)
def _file(path: str):
    from tokenizers import Tokenizer

    read = Tokenizer.from_file(path)
    read.encode_special_tokens = True
    read.no_truncation()
    read.no_padding()
    return read


#: Byte-level pieces of texts of ASCII, Latin letters and common marks; of others the file's own pattern makes them.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(f"[!-~{_BLANK}{_LATIN}\u2013\u2014\u2018-\u201e\u2026]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")
_AS_THEMSELVES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _AS_THEMSELVES)}


class Sizes(dict):
    """Tokens of white space with the word after it, and of words alone; those not met yet are counted."""

    def __init__(self, count: Count, model=None):
        super().__init__()
        self.count, self.model = count, model

    def __missing__(self, run: str) -> int:
        if self.model is None or not _PLAIN.fullmatch(run):
            n = self.count([run])[0]
        elif run.removeprefix(" ").isalpha() or len(pieces := _PIECE.findall(run)) == 1:
            n = len(self.model.tokenize(run.replace(" ", _BYTES[32]) if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(_BYTES)))
        else:
            n = sum(map(self.__getitem__, pieces))
        if len(run) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[run] = n
        return n

    def of(self, text: str) -> int:
        rest = text[len(text.rstrip(_BLANK)) :]
        return sum(map(self.__getitem__, _RUN.findall(text))) + (self[rest] if rest else 0)


class OfFile:
    """The tokenizer of a ``tokenizers`` file, without special tokens, read once by each worker; ``path`` must lie on every one."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(e) for e in _file(self.path).encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self) -> Sizes | None:
        """What it counts of runs, where no token reaches from a word into the white space after it; else nothing."""
        return _sizes(self.path)


def of_file(path: str) -> Count:
    return OfFile(path)


@lru_cache(maxsize=4)
def _sizes(path: str) -> Sizes | None:
    """Byte-level pieces are cut by a pattern in which white space only begins a piece, or is one; nothing else may see more of the text than them."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    cut, model = said.get("pre_tokenizer") or {}, said["model"]
    if cut.get("type") != "ByteLevel" or not cut.get("use_regex", True) or cut.get("add_prefix_space") or said.get("normalizer"):
        return None
    if model.get("type") != "BPE" or model.get("dropout") or not all(t["special"] for t in said.get("added_tokens") or []):
        return None
    return Sizes(OfFile(path), _file(path).model)


def _slices(texts: Iterable, size: Callable[[object], int]) -> Iterator[list]:
    """The texts in order, in lists of at most ``HELD`` characters, or of one text."""
    out, held = [], 0
    for t in texts:
        n = size(t)
        if out and held + n > HELD:
            yield out
            out, held = [], 0
        out.append(t)
        held += n
    if out:
        yield out


def _counts(texts: Iterable[str], count: Count) -> list[int]:
    return [n for some in _slices(texts, len) for n in count(some)]


def _side_by_side(walks: Iterable[Walk], count: Count) -> list:
    """What the walks return, all of them a step further after each call of ``count``."""
    walks = list(walks)
    done, send = [None] * len(walks), dict.fromkeys(range(len(walks)))
    while send:
        asked = {}
        for i, n in send.items():
            try:
                asked[i] = walks[i].send(n)
            except StopIteration as end:
                done[i] = end.value
        send = dict(zip(asked, _counts(asked.values(), count), strict=True)) if asked else {}
    return done


def _most(of: Callable[[int], str | int], words: int, n: int, least: int) -> Walk:
    """How many of ``words`` words have at most ``n`` tokens, by the text ``of`` so many; ``least`` at least, if there are as many."""
    fits, over = min(least, words), words + 1
    step = max(1, n // 2)
    while over - fits > 1:
        m = fits + step if fits + step < over else (fits + over) // 2
        if (yield of(m)) <= n:
            fits, step = m, step * 2
        else:
            over = m
    return fits


def _cuts(of: Callable[[int, int], str | int], words: int, n: int) -> Walk:
    """How many words each piece takes, by the text ``of`` so many words from a place."""
    at, out = 0, []
    size = 2 * max(1, n)  # of the words left, so many are looked at before more are
    while at < words:
        fit = yield from _most(lambda m: of(at, m), min(size, words - at), n, 1)
        if fit == size and at + size < words:
            size *= 2
            continue
        out.append(fit)
        at += fit
    return out


def _tail(text: str, n: int) -> Walk:
    words = _WORD.findall(text)
    fit = (yield from _most(lambda m: " ".join(words[len(words) - m :]), len(words), n, 0)) if n > 0 else 0
    return " ".join(words[len(words) - fit :])


def _pieces(text: str, n: int) -> Walk:
    words = _WORD.findall(text)
    fits = yield from _cuts(lambda at, m: " ".join(words[at : at + m]), len(words), n)
    return [" ".join(words[end - m : end]) for end, m in zip(accumulate(fits), fits, strict=True)]


def _told(walk: Walk) -> object:
    """What a walk returns that asks for nothing but counts it has."""
    n = None
    try:
        while True:
            n = walk.send(n)
    except StopIteration as end:
        return end.value


def _spaced(text: str, runs: list[str]) -> list[str]:
    """The runs of a text with one space before each word."""
    uneven = len(runs) if _UNEVEN.search(text) else 1
    return [" " + r.lstrip(_BLANK) for r in runs[:uneven]] + runs[uneven:]


def _summed(spaced: list[str], size: Sizes) -> Callable[[int, int], int]:
    """Tokens of so many words from a place on, one space between them."""
    upto = [0, *accumulate(map(size.__getitem__, spaced))]
    return lambda at, m: size[spaced[at][1:]] + upto[at + m] - upto[at + 1] if m else 0


def _sized_tail(text: str, n: int, size: Sizes) -> tuple[str, int]:
    """The tail and its tokens."""
    spaced = _spaced(text, _RUN.findall(text))
    of = _summed(spaced, size)
    fit = _told(_most(lambda m: of(len(spaced) - m, m), len(spaced), n, 0)) if n > 0 else 0
    return "".join(spaced[len(spaced) - fit :])[1:], of(len(spaced) - fit, fit)


def _sized_pieces(text: str, n: int, size: Sizes, runs: list[str] | None = None) -> list[tuple[str, int]]:
    """The pieces, each with its tokens."""
    spaced = _spaced(text, _RUN.findall(text) if runs is None else runs)
    of = _summed(spaced, size)
    fits = _told(_cuts(of, len(spaced), n))
    return [("".join(spaced[end - m : end])[1:], of(end - m, m)) for end, m in zip(accumulate(fits), fits, strict=True)]


def _sized_passages(blocks: Iterable[str], most: int, overlap: int, size: Sizes) -> list[tuple[str, int]]:
    """``_passages`` by sums, each with its tokens: of the open passage, those without white space at its ends are known, and the white space that it ends in."""
    out, open_, core, rest = [], "", 0, ""

    def close() -> None:
        if body := open_.strip(_BLANK):
            out.append((body, core))

    def put(before: str, core: int, rest: str) -> int:
        """Tokens of what is open with the block after it, both ends trimmed."""
        if not runs:
            return core
        first = rest + "\n\n" + runs[0] if before.strip(_BLANK) else runs[0].lstrip(_BLANK)
        return core + size[first] + inner

    for block in blocks:
        runs = _RUN.findall(block)
        if len(runs) <= most:  # else it has more tokens than that
            every = list(map(size.__getitem__, runs))
            inner, end = sum(every[1:]), block[len(block.rstrip(_BLANK)) :]
            whole = sum(every) + (size[end] if end else 0)
            alone = (block, size[runs[0].lstrip(_BLANK)] + inner if runs else 0, end)
            if not open_:
                if whole <= most:
                    open_, core, rest = alone
                    continue
            elif (n := put(open_, core, rest)) <= most:
                open_, core, rest = f"{open_}\n\n{block}".strip(_BLANK), n, ""
                continue
            elif whole <= most:
                close()
                tail, held = _sized_tail(out[-1][0], overlap, size) if out else ("", 0)
                open_, core, rest = (f"{tail}\n\n{block}".strip(_BLANK), put(tail, held, ""), "") if tail else alone
                continue
        close()
        made = _sized_pieces(block, most, size, runs)
        out += made[:-1]
        open_, core = made[-1] if made else ("", 0)
        rest = ""
    close()
    return out


def _passages(blocks: Iterable[str], most: int, overlap: int) -> Walk:
    out, open_ = [], ""

    def close() -> None:
        if body := open_.strip(_BLANK):
            out.append(body)

    def with_block(before: str, block: str) -> str:
        return f"{before}\n\n{block}".strip(_BLANK) if before else block

    for block in blocks:
        longer = with_block(open_, block)
        if (yield longer) <= most:
            open_ = longer
        elif open_ and (yield block) <= most:
            close()
            open_ = with_block((yield from _tail(out[-1], overlap)) if out else "", block)
        else:
            close()
            made = yield from _pieces(block, most)
            out += made[:-1]
            open_ = made[-1] if made else ""
    close()
    return out


def _walked(column: Iterable, walk: Callable[..., Walk], count: Count, sized: Callable[..., object] | None) -> Iterator:
    """What ``walk`` makes of each text or list of blocks, in their order; ``sized`` makes the same of a tokenizer's sizes."""
    texts = lambda x: [x] if isinstance(x, str) else x
    sizes = count.apart() if sized and hasattr(count, "apart") else None
    for some in _slices(column, lambda x: sum(map(len, texts(x)))):
        slow = [x for x in some if sizes is None or any(map(_OPEN_END.search, texts(x)))]
        asked = iter(_side_by_side(map(walk, slow), count))
        if len(slow) == len(some):
            yield from asked
            continue
        ids = set(map(id, slow))
        yield from (next(asked) if id(x) in ids else sized(x, sizes) for x in some)


def _udf(walk: Callable[..., Walk], count: Count, kind: str, sized: Callable[..., object] | None = None):
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list(_walked(column, walk, count, sized)), dtype=object)

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def _asked(text: str) -> Walk:
    return (yield text)


def token_count(text: Column, count: Count) -> Column:
    def run(column: pd.Series) -> pd.Series:
        return pd.Series(list(_walked(column, _asked, count, lambda t, size: size.of(t))), dtype="int64")

    run.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(F.coalesce(text, F.lit("")))


def last_tokens(text: Column, n: int, count: Count) -> Column:
    """The longest run of last words of at most ``n`` tokens; empty if the last word alone has more."""
    return _udf(lambda t: _tail(t, n), count, "string", lambda t, size: _sized_tail(t, n, size)[0])(F.coalesce(text, F.lit("")))


def token_pieces(text: Column, n: int, count: Count) -> Column:
    """Pieces of as many words as fit ``n`` tokens; a word of more is a piece by itself. A text without words has none."""
    return _udf(lambda t: _pieces(t, n), count, "array<string>", lambda t, size: [p for p, _ in _sized_pieces(t, n, size)])(F.coalesce(text, F.lit("")))


def _counted_passages(blocks: Iterable[str], most: int, overlap: int) -> Walk:
    out = []
    for p in (yield from _passages(blocks, most, overlap)):
        out.append((p, (yield p)))
    return out


def passages(blocks: Column, most: int, overlap: int, count: Count, counted: bool = False) -> Column:
    """Blocks (array of strings) packed into passages of at most ``most`` tokens, each begun with the last one's ``overlap``.

    The overlap comes on top of a passage's first block, so that the two may exceed ``most``. A block that is too long is cut
    into pieces, of which the last stays open. No blocks make no passages. With ``counted``, structs of each text and its n_tokens.
    """
    kind = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int64())])) if counted else pa.list_(pa.string())
    walk = (lambda b: _counted_passages(b, most, overlap)) if counted else (lambda b: _passages(b, most, overlap))
    sized = lambda b, size: [x if counted else x[0] for x in _sized_passages(b, most, overlap, size)]

    def run(column: pa.Array) -> pa.Array:
        made = _walked((x.as_py() for x in column), walk, count, sized)
        some = [pa.array(list(islice(made, 500)), kind) for _ in range(0, len(column), 500)]
        return pa.concat_arrays(some) if some else pa.array([], kind)

    made = "array<struct<text:string,n_tokens:long>>" if counted else "array<string>"
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, made)(F.coalesce(blocks, F.array().cast("array<string>")))
