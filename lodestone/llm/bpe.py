"""Byte-pair segmentation as a relaxation over a graph of vocabulary edges.

An edge is one occurrence of a piece in a unit of text. Segmenting by merges
has a local characterisation: a row of pieces is the result of merging exactly
if every two neighbours would stay apart when merged alone. So every prefix of
a unit has exactly one last piece, found from the pieces that end there and
the last pieces of shorter prefixes. ``relax`` does this for many units at
once; where the edges come from (suffix array or trie) is up to the caller.

Text is cut into units first: a run of spaces with the characters up to the
next space or line end. No piece crosses such a cut, so that units are
independent, and a unit seen before is not worked on again.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

SPACE = "▁"
#: A line end alone, a run of spaces with what follows it, or what follows a line end.
UNIT = re.compile("\n| +[^ \n]*|[^ \n]+")
BIG = np.int32(2**31 - 1)
#: Units longer than this are relaxed one by one.
LONG = 256


def units_of(text: str) -> list[str]:
    """The independent units of a text, with plain spaces; the model puts one in front."""
    if not text:
        return []
    return UNIT.findall(" " + (text.replace(SPACE, " ") if SPACE in text else text))


class IntMap:
    """Open-addressing table from non-negative int64 keys to int32 values."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        mask = (1 << self.bits) - 1
        slots = self.slot(keys)
        rest = np.arange(len(keys))
        while len(rest):
            at = slots[rest]
            free = self.keys[at] < 0
            first = np.zeros(len(rest), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = free & first
            self.keys[at[take]] = keys[rest[take]]
            self.values[at[take]] = values[rest[take]]
            rest = rest[~take]
            slots[rest] = (slots[rest] + 1) & mask

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, -1 where a key is missing."""
        slots = self.slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        rest = np.flatnonzero((found != keys) & (found >= 0))
        mask = len(self.keys) - 1
        while len(rest):
            slots[rest] = (slots[rest] + 1) & mask
            found = self.keys[slots[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = self.values[slots[rest[hit]]]
            rest = rest[~hit & (found >= 0)]
        return out


class Bpe:
    """Vocabulary of a byte-pair model with byte fallback.

    Pieces are numbered by the order in which merging prefers them: single
    characters first, then merges from best to worst, then runs of spaces, which
    this kind of model ranks last and all alike. ``unknown`` stands for a
    character without a piece, which is written as its UTF-8 bytes.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        plain, self.byte_ids = [], np.zeros(256, np.int32)
        self.special: dict[int, str] = {}  # what pieces without a text of their own decode to
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.special[i] = sp.decode([i])
            else:
                plain.append((sp.id_to_piece(i), sp.get_score(i), i))
        run = lambda p: len(p) > 1 and not p.strip(SPACE)
        plain.sort(key=lambda x: (len(x[0]) > 1, run(x[0]), len(x[0]) if run(x[0]) else 0, -x[1], x[2]))
        self.pieces = [p for p, _, _ in plain]
        self.ids = np.array([i for _, _, i in plain], np.int32)
        self.unknown = len(plain)
        self.at = {p: k for k, p in enumerate(self.pieces)}
        crossing = [p for p in self.pieces if "\n" in p or SPACE in p[1:] and p.strip(SPACE)]
        alone = [p for p in self.pieces if not all(c in self.at for c in p)]
        if crossing or alone:
            raise ValueError(f"unsupported pieces: {(crossing + alone)[:3]}")
        self.run_length = np.array([len(p) if not p.strip(SPACE) else 0 for p in self.pieces] + [0], np.int16)
        self.first_run = next((k for k, p in enumerate(self.pieces) if run(p)), len(self.pieces))
        self.length = np.array([len(p) for p in self.pieces] + [1], np.int16)
        self.longest = int(self.length.max())
        self._merges()
        top = int(self.run_length.max())
        self.runs_apart = np.zeros((top + 1, top + 1), bool)
        for i in range(1, top + 1):
            for j in range(1, top + 1):
                self.runs_apart[i, j] = [len(self.pieces[k]) for k in self._merged(SPACE * (i + j))[0]] == [i, j]
        self._trie()
        self.cache_key = np.full(1 << 21, -1, np.int64)
        self.cache_ok = np.zeros(1 << 21, bool)
        self.single: dict[tuple[int, int], bool] = {}

    def _merges(self) -> None:
        n, at = len(self.pieces), self.at
        self.left, self.right = np.arange(n + 1, dtype=np.int32), np.arange(n + 1, dtype=np.int32)
        reachable = np.ones(n + 1, bool)
        keys, values = [], []
        for k, p in enumerate(self.pieces):
            if len(p) == 1:
                continue
            for i in range(1, len(p)):
                if (a := at.get(p[:i])) is not None and (b := at.get(p[i:])) is not None:
                    keys.append(a << 20 | b)
                    values.append(k)
            parts, last = self._merged(p)
            if len(parts) == 1:
                self.left[k], self.right[k] = last
            else:
                reachable[k] = False
        self.reachable = reachable
        self.merge = IntMap(np.array(keys, np.int64), np.array(values, np.int32))

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Pieces left after merging a short text step by step, and the last merge."""
        n = len(self.pieces)
        parts, last = [self.at[c] for c in text], (n, n)
        while len(parts) > 1:
            made = [self.at.get(self.pieces[a] + self.pieces[b], n) for a, b in zip(parts, parts[1:], strict=False)]
            # Runs of spaces are all ranked alike, so that the leftmost goes first.
            i = min(range(len(made)), key=lambda i: (min(made[i], n if made[i] == n else self.first_run), i))
            if made[i] >= n:
                break
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [made[i]]
        return parts, last

    def _trie(self) -> None:
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110001, np.int32)  # one more than there are code points, for a separator
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        number = {c: k + 1 for k, c in enumerate(letters)}
        nodes, ends = {}, [-1]
        for k, p in enumerate(self.pieces):
            node = 0
            for c in p:
                key = node << 20 | number[c]
                if key not in nodes:
                    nodes[key] = len(ends)
                    ends.append(-1)
                node = nodes[key]
            if self.reachable[k]:
                ends[node] = k
        self.ends = np.array(ends, np.int32)
        self.next = IntMap(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int32))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece ``a`` before piece ``b`` stays unmerged."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        out = self.cache_ok[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            one, back = np.unique(key[miss], return_inverse=True)
            value = self._walk((one >> 20).astype(np.int32), (one & 0xFFFFF).astype(np.int32))[back]
            out[miss] = value
            self.cache_key[slot[miss]] = -1
            self.cache_ok[slot[miss]] = value
            # Slots that two keys of this call share keep the last of them: write the answers again by key.
            self.cache_key[slot[miss]] = key[miss]
            owner = self.cache_key[slot[miss]] == key[miss]
            self.cache_ok[slot[miss[owner]]] = value[owner]
        return out

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        runs = (self.run_length[a] > 0) & (self.run_length[b] > 0)
        out[runs] = self.runs_apart[self.run_length[a[runs]], self.run_length[b[runs]]]
        todo = np.flatnonzero(~runs & (a != self.unknown) & (b != self.unknown))
        a, b, limit = a[todo], b[todo], np.full(len(todo), BIG, np.int32)
        while len(todo):
            made = self.merge.get(a.astype(np.int64) << 20 | b)
            bad = (made >= 0) & (made < limit)
            out[todo[bad]] = False
            # Undo the later of the two merges; a merge across the cut that comes before it would have been made.
            first = a > b
            part_a, part_b = self.right[a], self.left[b]
            leaf_a, leaf_b = part_a == a, part_b == b
            use_a = np.where(first, ~leaf_a, leaf_b & ~leaf_a)
            use_b = np.where(first, leaf_a & ~leaf_b, ~leaf_b)
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, part_a, a), np.where(use_b, part_b, b)
            keep = np.flatnonzero(~bad & (use_a | use_b))
            todo, a, b, limit = todo[keep], a[keep], b[keep], limit[keep]
        return out

    def apart_one(self, a: int, b: int) -> bool:
        if (known := self.single.get((a, b))) is None:
            if len(self.single) > 1_000_000:
                self.single.clear()
            known = self.single[a, b] = bool(self._walk(np.array([a], np.int32), np.array([b], np.int32))[0])
        return known

    def trie_edges(self, codes: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All edges (start, end, piece) of the text ``codes``; ``stop`` is the end of each position's unit."""
        letters = self.letter[codes].astype(np.int64)
        at = np.arange(len(codes))
        node = np.zeros(len(codes), np.int64)
        out = []
        for depth in range(1, self.longest + 1):
            node = self.next.get(node << 20 | letters[at + depth - 1]).astype(np.int64)
            if depth == 1:
                lost = np.flatnonzero((node < 0) | (letters == 0))
                out.append((lost, lost + 1, np.full(len(lost), self.unknown, np.int32)))
            go = node >= 0
            at, node = at[go], node[go]
            piece = self.ends[node]
            hit = piece >= 0
            out.append((at[hit], at[hit] + depth, piece[hit]))
            more = at + depth < stop[at]
            at, node = at[more], node[more]
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def relax(self, starts: np.ndarray, n: int, edges: tuple[np.ndarray, np.ndarray, np.ndarray], widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last piece and number of ids at every prefix.

        starts: first position of each unit in the joined text of ``n``
        characters; widths: UTF-8 bytes of each character. Both results are
        indexed by the position of a prefix's last character.
        """
        last = np.full(n, -1, np.int32)
        count = np.zeros(n, np.int32)
        if not n:
            return last, count
        lengths = np.diff(np.append(starts, n))
        begin = np.repeat(starts, lengths)
        long_unit = np.repeat(lengths > LONG, lengths)
        s, e, t = edges
        slow = long_unit[s]
        order = np.lexsort((-(e[slow] - s[slow]), e[slow])) if slow.any() else []
        if len(order):
            self._relax_slowly(s[slow][order], e[slow][order], t[slow][order], begin, widths, last, count)
        if slow.any():
            s, e, t = s[~slow], e[~slow], t[~slow]
        key = ((e - begin[s]) * 64 + (63 - np.minimum(e - s, 63))).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(key[order], prepend=np.uint16(0))), len(order))
        if len(order) and cuts[0] != 0:
            cuts = np.insert(cuts, 0, 0)
        s, e, t = s[order], e[order] - 1, t[order]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            es, ee, et = s[lo:hi], e[lo:hi], t[lo:hi]
            open_ = last[ee] < 0
            es, ee, et = es[open_], ee[open_], et[open_]
            inner = es > begin[es]
            ok = ~inner
            where = np.flatnonzero(inner)
            ok[where] = self.apart(last[es[where] - 1], et[where])
            es, ee, et, inner = es[ok], ee[ok], et[ok], inner[ok]
            last[ee] = et
            count[ee] = np.where(et == self.unknown, widths[es], 1) + np.where(inner, count[es - 1], 0)
        return last, count

    def _relax_slowly(self, s, e, t, begin, widths, last, count) -> None:
        for a, b, p in zip(s.tolist(), (e - 1).tolist(), t.tolist(), strict=True):
            if last[b] >= 0:
                continue
            inner = a > begin[a]
            if inner and not self.apart_one(int(last[a - 1]), p):
                continue
            last[b] = p
            count[b] = (widths[a] if p == self.unknown else 1) + (count[a - 1] if inner else 0)

    def traced(self, starts: np.ndarray, last: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every unit, joined, and where each unit's ids begin."""
        n = len(codes)
        ends = np.append(starts[1:], n) - 1
        unit = np.arange(len(starts))
        at, rows = ends.copy(), []
        while len(unit):
            piece = last[at]
            rows.append((unit, at, piece))
            at = at - self.length[piece]
            go = at >= starts[unit]
            unit, at = unit[go], at[go]
        if not rows:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        unit, at, piece = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(at)
        unit, at, piece = unit[order], at[order], piece[order]
        wide = np.where(piece == self.unknown, utf8_widths(codes[at]), 1)
        offset = np.concatenate([[0], np.cumsum(wide)])
        ids = np.zeros(offset[-1], np.int32)
        known = piece != self.unknown
        ids[offset[:-1][known]] = self.ids[piece[known]]
        for k in np.flatnonzero(~known):
            raw = chr(codes[at[k]]).encode("utf-8", "surrogatepass")
            ids[offset[k] : offset[k] + len(raw)] = self.byte_ids[list(raw)]
        first = np.searchsorted(unit, np.arange(len(starts) + 1))
        return ids, offset[first]


def utf8_widths(codes: np.ndarray) -> np.ndarray:
    return (1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)).astype(np.int32)


def joined(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the joined units, first positions, and each position's unit end."""
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes == 32, np.uint32(ord(SPACE)), codes)
    lengths = np.fromiter(map(len, units), np.int64, len(units))
    ends = np.cumsum(lengths)
    return codes, ends - lengths, np.repeat(ends, lengths)


@lru_cache(maxsize=2)
def model(data: bytes) -> Bpe:
    """The vocabulary of these model bytes, built once in each Python worker."""
    return Bpe(data)
