"""Byte-pair encoding by segment trees, many words at once.

Every word has a tree over the ranks of its adjacent pairs. The root holds the lowest rank and, among
equal ranks, the leftmost pair; a merge changes three leaves and the nodes above them. Trees of words of
a similar length stand side by side in one array, so one array operation advances thousands of words.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.iinfo(np.int64).max
MISSES = 1 << 12  # words in one array
ODD = np.uint64(0x9E3779B97F4A7C15)
LONG = 64  # bytes; longer words have a tree of their own


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PairTable:
    """Ranks and products of mergeable pairs as arrays, found by hashes."""

    BITS = 18

    def __init__(self, model: dict):
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        product = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * self.size + right
        # a pair listed twice counts with its last rank
        order = np.lexsort((-np.arange(len(key)), key))
        first = np.r_[True, np.diff(key[order]) > 0] if len(key) else np.zeros(0, bool)
        order = order[first]
        self.key, self.rank, self.product = key[order], order, product  # product: by rank
        self._lookup = None
        letters, end = byte_letters(), model.get("end_of_word_suffix") or ""
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int64)
        # one table of places after another: a pair that finds its place taken goes to the next table
        self.known = np.append(self.key, -1)  # the last one is no pair
        self.rank_or_none = np.append(self.rank, NONE)
        self.tables: list[np.ndarray] = []
        left, level = np.arange(len(self.key)), 0
        while len(left):
            table = np.full(1 << self.BITS, len(self.key), np.int32)
            slot = self._slot(self.key[left], level)
            table[slot] = left
            self.tables.append(table)
            left, level = left[table[slot] != left], level + 1

    def lookup(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, product)."""
        if self._lookup is None:
            left, right = np.divmod(self.key, self.size)
            self._lookup = dict(zip(zip(left.tolist(), right.tolist()),
                                    zip(self.rank.tolist(), self.product[self.rank].tolist())))
        return self._lookup

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it cannot be merged."""
        key = a * self.size + b
        if not self.tables:
            return np.full(len(key), NONE, np.int64)
        at = self.tables[0][self._slot(key, 0)]
        other = np.flatnonzero((self.known[at] != key) & (at < len(self.key)))
        for level in range(1, len(self.tables)):
            if not len(other):
                break
            at[other] = self.tables[level][self._slot(key[other], level)]
            other = other[(self.known[at[other]] != key[other]) & (at[other] < len(self.key))]
        at[other] = len(self.key)
        return self.rank_or_none[at]

    def _slot(self, key: np.ndarray, level: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * (ODD + np.uint64(2 * level))) >> np.uint64(64 - self.BITS)


def _merge_all(pairs: PairTable, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left after all merges (flat), and how many of each row. ``symbols``: rows x longest length."""
    rows, longest = symbols.shape
    width = 1 << max(1, (longest - 1).bit_length())
    shift = width.bit_length()
    mask = (1 << shift) - 1
    alive = np.arange(longest) < length[:, None]
    tree = np.full((rows, 2 * width), NONE, np.int64)
    r, c = np.nonzero(alive[:, 1:])
    rank = pairs.ranks(symbols[r, c], symbols[r, c + 1])
    ok = rank != NONE
    tree[r[ok], width + c[ok]] = (rank[ok] << shift) | c[ok]
    level = width
    while level > 1:
        np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2], out=tree[:, level // 2:level])
        level //= 2
    levels = width.bit_length() - 1

    # flat views: one index instead of two
    after = np.tile(np.arange(1, longest + 1), rows)
    before = np.tile(np.arange(-1, longest - 1), rows)
    symbol, live, tree = symbols.reshape(-1), alive.reshape(-1), tree.reshape(-1)
    row = np.flatnonzero(tree[1::2 * width] != NONE)
    cell, top, end = row * longest, row * (2 * width), length[row]
    while len(row):
        root = tree[top + 1]
        at = root & mask
        new = pairs.product[root >> shift]
        gone = after[cell + at]
        following = after[cell + gone]
        symbol[cell + at] = new
        live[cell + gone] = False
        after[cell + at] = following
        right = np.full(len(row), NONE, np.int64)
        has = np.flatnonzero(following < end)
        if len(has):
            f = cell[has] + following[has]
            before[f] = at[has]
            rank = pairs.ranks(new[has], symbol[f])
            found = rank != NONE
            right[has[found]] = (rank[found] << shift) | at[has[found]]
        tree[top + (width + gone)] = NONE
        tree[top + (width + at)] = right
        previous = before[cell + at]
        has = np.flatnonzero(previous >= 0)
        p = previous[has]
        rank = pairs.ranks(symbol[cell[has] + p], new[has])
        tree[top[has] + (width + p)] = np.where(rank == NONE, NONE, (rank << shift) | p)
        base = np.concatenate([top, top, top[has]])
        node = np.concatenate([gone, at, p]) + width
        for _ in range(levels):
            node >>= 1
            child = base + 2 * node
            tree[base + node] = np.minimum(tree[child], tree[child + 1])
        more = tree[top + 1] != NONE
        if not more.all():
            row, cell, top, end = row[more], cell[more], top[more], end[more]
    return symbols[alive], alive.sum(axis=1)


def _merge_long(pairs: PairTable, symbols: list[int]) -> list[int]:
    """The same tree for one long word, node by node."""
    n, rank_of = len(symbols), pairs.lookup()
    width = 1 << max(1, (n - 1).bit_length())
    none = (NONE, 0)
    tree = [none] * (2 * width)
    for i in range(n - 1):
        rank = rank_of.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            tree[width + i] = (rank[0], i)
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    gone = bytearray(n)

    def put(i, value):
        i += width
        tree[i] = value
        i >>= 1
        while i:
            low = min(tree[2 * i], tree[2 * i + 1])
            if low == tree[i]:
                break
            tree[i] = low
            i >>= 1

    while tree[1] is not none:
        _, at = tree[1]
        other = after[at]
        symbols[at] = rank_of[symbols[at], symbols[other]][1]
        gone[other] = 1
        following = after[at] = after[other]
        put(other, none)
        rank = None
        if following < n:
            before[following] = at
            rank = rank_of.get((symbols[at], symbols[following]))
        put(at, none if rank is None else (rank[0], at))
        if before[at] >= 0:
            rank = rank_of.get((symbols[before[at]], symbols[at]))
            put(before[at], none if rank is None else (rank[0], before[at]))
    return [x for x, out in zip(symbols, gone) if not out]


def encode_words(pairs: PairTable, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and the number of ids of each word."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    return encode_ranges(pairs, np.frombuffer(b"".join(words), np.uint8), np.cumsum(length) - length, length)


def encode_ranges(pairs: PairTable, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``encode_words`` of ranges of one buffer."""
    counts = np.zeros(len(length), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    i, short = 0, int(np.searchsorted(length[order], LONG, "right"))
    for k in order[short:]:
        word = data[begin[k]:begin[k] + length[k]]
        symbols = pairs.first[word]
        symbols[-1] = pairs.last[word[-1]]
        left = np.array(_merge_long(pairs, symbols.tolist()), np.int64)
        counts[k] = len(left)
        parts.append((np.array([k]), left, counts[k:k + 1]))
    order = order[:short]
    while i < len(order):
        longest = int(length[order[i]])
        longest = 1 << (longest - 1).bit_length()
        j = min(i + MISSES, int(np.searchsorted(length[order], longest, "right")))
        rows = order[i:j]
        n = length[rows]
        longest = int(n[-1])
        flat = data[spread(begin[rows], n)]
        inside = np.arange(longest) < n[:, None]
        symbols = np.zeros((len(rows), longest), np.int64)
        symbols[inside] = pairs.first[flat]
        tail = flat[np.cumsum(n) - 1]
        symbols[np.arange(len(rows)), n - 1] = pairs.last[tail]
        left, count = _merge_all(pairs, symbols, n)
        counts[rows] = count
        parts.append((rows, left, count))
        i = j
    start = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(start[-1], np.int64)
    for rows, left, count in parts:
        out[spread(start[rows], count)] = left
    return out, counts


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start+1, ..., start+count-1 of every range, one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(start - begin, count)


def load_model(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
