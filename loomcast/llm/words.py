"""Words of many texts at once: one pass of array arithmetic over a text buffer, no object per word.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; hashes take A-Z as a-z.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 18
_ODD, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * _MIX1
        x = (x ^ (x >> U(27))) * _MIX2
        return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _BYTE = mix((FOLD.astype(np.uint64) + U(1)) * _ODD)
    _EXACT = mix((np.arange(256, dtype=np.uint64) + U(1)) * _ODD)
def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 byte of every word; a word never crosses the border of two texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hash of every range of bytes, in blocks of a quarter of a megabyte.

    A byte and its place are mixed together before they are summed, so words of equal bytes in other places have
    no structure in common. A range longer than a block is hashed part by part.
    """
    value = _BYTE if fold else _EXACT
    out = np.empty(len(starts), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo > BLOCK:
                total = U(0)
                for at in range(lo, hi, BLOCK):
                    place = np.arange(at - lo, min(at + BLOCK, hi) - lo, dtype=np.uint64)
                    total += mix(value[data[at:at + len(place)]] + place * _ODD).sum(dtype=np.uint64)
                out[i] = mix(total + U(hi - lo) * _ODD)
            else:
                a, length = starts[i:j] - lo, ends[i:j] - starts[i:j]
                begin = np.cumsum(length) - length
                place = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(begin, length)
                own = data[lo:hi][place + np.repeat(a, length)]
                mixed = mix(value[own] + place.astype(np.uint64) * _ODD)
                sums = np.zeros(len(a), np.uint64)
                has = length > 0
                if has.any():
                    sums[has] = np.add.reduceat(mixed, begin[has])
                out[i:j] = mix(sums + length.astype(np.uint64) * _ODD)
            i = j
    return out


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin (one longer than the texts)."""
    data, offsets = buffer_of(texts)
    starts, ends = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles of one text; fewer words make one shingle, none make none."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    with np.errstate(over="ignore"):
        acc = mix(words[:n - width + 1] + U(width) * _ODD)
        for j in range(1, width):
            acc = mix(acc * _ODD + words[j:n - width + 1 + j])
    return acc


def slices(texts: pa.Array, most: int = 1 << 20):
    """Ranges of rows with about ``most`` bytes of text, at least one row each."""
    _, offsets = buffer_of(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j
