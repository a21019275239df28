"""Byte-level BPE over batches: pre-tokens as ragged arrays, merged rank by rank.

The vocabulary file is a parameter and is read where the work is done; it is
never trained or copied here.
"""

from __future__ import annotations

import functools
import json

import numpy as np

from .kernels import TextSlice, ragged, span_hashes

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@functools.cache
def character_classes() -> np.ndarray:
    """White space, letter, number or other for each code point, as the tokenizer library's own patterns see them."""
    import tokenizers

    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x40000)])  # beyond lie no letters, numbers or spaces
    everything = "".join(map(chr, points.tolist()))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
        for _, (lo, hi) in split.pre_tokenize_str(everything):
            out[points[lo:hi]] = kind
    return out


def pretokens(part: TextSlice) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of the usual byte-level pattern: contractions, then runs of letters, numbers or
    other characters with one space before them, then white space, whose last character is left to what follows."""
    if not len(part.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if part.data.max() < 0x80:
        points, at = part.data, None
        heads = part.offsets
    else:
        points = np.frombuffer(part.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = (part.data & 0xC0) != 0x80
        at = np.append(np.flatnonzero(lead), len(part.data))
        heads = np.searchsorted(at, part.offsets)
    n = len(points)
    kinds = character_classes()[points]
    head = np.zeros(n + 1, bool)
    head[heads] = True
    begins = head[:n].copy()
    begins[0] = True
    begins[1:] |= kinds[1:] != kinds[:-1]
    runs = np.append(np.flatnonzero(begins), n)
    lo, hi = runs[:-1], runs[1:]
    kind = kinds[lo]
    followed = ~head[hi]  # by a run of the same row
    white = kind == _SPACE
    last = points[hi - 1] == 32
    cut = white & followed
    begins[hi[cut] - 1] = True
    lent = cut & last
    begins[hi[lent]] = False
    joined = np.zeros(len(lo), bool)
    joined[1:] = lent[:-1]
    quote = (kind == _OTHER) & (hi - lo == 1) & (points[lo] == 39) & ~joined & followed
    quote = np.flatnonzero(quote)
    quote = quote[kind[quote + 1] == _LETTER] if len(quote) else quote
    if len(quote):
        a, size = lo[quote + 1], (hi - lo)[quote + 1]
        one = points[a]
        two = points[np.minimum(a + 1, n - 1)]
        single = np.isin(one, [ord(x) for x in "stmd"])
        double = (size > 1) & (((np.isin(one, [ord("r"), ord("v")])) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        take = np.where(single, 1, np.where(double, 2, 0))
        hit = take > 0
        begins[a[hit]] = False
        rest = hit & (size > take)
        begins[(a + take)[rest]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    return (starts, ends) if at is None else (at[starts], at[ends])


class Merges:
    """The merge table of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocabulary = model["model"]["vocab"]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.first = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["model"]["merges"]]
        left, right = (np.array([vocabulary[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.width = max(vocabulary.values()) + 1
        keys = left * self.width + right
        order = np.argsort(keys)
        self.rank, self.made = order.astype(np.int64), made[order]
        # an open hash table: searching 50,000 sorted keys is slower
        self.bits = 18
        self.slots = np.full((1 << self.bits) + 64, -1, np.int64)
        self.place = np.zeros((1 << self.bits) + 64, np.int64)
        for i, (key, slot) in enumerate(zip(keys[order].tolist(), self._slot(keys[order]).tolist(), strict=True)):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot], self.place[slot] = key, i
        self.special = {x["content"]: x["id"] for x in model.get("added_tokens", [])}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each pair in the table, or -1."""
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.slots[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[(there >= 0) & ~hit]
            slot[open_] += 1
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each byte span: every round applies each span's pair of lowest rank, wherever it stands in it."""
        lengths = ends - starts
        out = lengths.astype(np.int64).copy()
        symbols = self.first[data[ragged(starts, lengths)]]
        owner = np.repeat(np.arange(len(starts)), lengths)
        none = 1 << 40
        while len(symbols) > 1:
            same = owner[1:] == owner[:-1]
            found = np.full(len(symbols), -1, np.int64)
            at = np.flatnonzero(same)
            found[at] = self.find(symbols[at] * self.width + symbols[at + 1])
            rank = np.where(found >= 0, self.rank[found], none)
            first = np.flatnonzero(np.concatenate([[True], ~same]))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(symbols)))
            lowest = np.repeat(least, sizes)
            merge = (rank == lowest) & (rank < none)
            # of overlapping equal pairs, every second one, from the left
            run = merge.copy()
            run[1:] &= ~merge[:-1]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(merge)), 0))
            merge &= ((np.arange(len(merge)) - begin) & 1) == 0
            hits = np.flatnonzero(merge)
            symbols = symbols.copy()
            symbols[hits] = self.made[found[hits]]
            out -= np.bincount(owner[hits], minlength=len(out))
            keep = lowest < none
            keep[hits + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class Cache:
    """Values by 64-bit key, as sorted arrays; beyond ``most`` entries, new ones are worked out each time."""

    def __init__(self, most: int = 1 << 20):
        self.keys, self.values, self.most = np.zeros(0, np.uint64), np.zeros(0, np.int64), most

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of sorted unique keys, and which were found."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        room = self.most - len(self.keys)
        if room <= 0 or not len(keys):
            return
        keys, values = keys[:room], values[:room]
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values = np.insert(self.keys, at, keys), np.insert(self.values, at, values)


def split_at_specials(part: TextSlice, specials: list[bytes]) -> tuple[TextSlice, np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut at special strings, as the library does before anything else: the pieces as rows of a slice, the row of
    each piece, and the rows and indexes of the specials that follow piece after piece (row, special) in text order.

    The returned special array holds, for each piece, the index of the special string after it, or -1.
    """
    raw = part.data.tobytes()
    if not any(s in raw for s in specials):
        rows = np.arange(part.rows)
        return part, rows, np.full(part.rows, -1), part.offsets[:-1]
    datas, rows, after, begins = [], [], [], []
    for r in range(part.rows):
        lo, end = int(part.offsets[r]), int(part.offsets[r + 1])
        while True:
            hits = [(raw.find(s, lo, end), i) for i, s in enumerate(specials)]
            hits = [(at, -len(specials[i]), i) for at, i in hits if at >= 0]
            rows.append(r)
            begins.append(lo)
            if not hits:
                datas.append(raw[lo:end])
                after.append(-1)
                break
            at, _, i = min(hits)
            datas.append(raw[lo:at])
            after.append(i)
            lo = at + len(specials[i])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in datas])]).astype(np.int64)
    pieces = TextSlice(part.first, len(datas), np.frombuffer(b"".join(datas), np.uint8), offsets)
    return pieces, np.array(rows), np.array(after), np.array(begins)


def unique_spans(part: TextSlice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pre-token starts and ends, their distinct hashes, an example of each, and which one each pre-token is."""
    starts, ends = pretokens(part)
    keys, example, inverse = np.unique(span_hashes(part.data, starts, ends), return_index=True, return_inverse=True)
    return starts, ends, keys, example, inverse.ravel()
