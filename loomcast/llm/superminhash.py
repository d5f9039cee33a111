"""SuperMinHash signatures (Ertl 2017) of many sets at once.

An element draws, for step j = 0, 1, ..., a number r in [0, 1) and a position from its own random
permutation, and offers r + j there; a position keeps the least offer. Offers of step j can matter only while
some position still holds more than j, so a set stops early: large sets after a step or two.
"""

from __future__ import annotations

import numpy as np

from loomcast.llm.words import U, mix

_STEP = U(0x9E3779B97F4A7C15)
_TO_UNIT = 1.0 / (1 << 53)
CHUNK = 1 << 15


def _draw(seed: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of step j and the offset of its exchange partner in the permutation."""
    with np.errstate(over="ignore"):
        first = mix(seed + U(2 * j + 1) * _STEP)
        second = mix(seed + U(2 * j + 2) * _STEP)
    r = (first >> U(11)).astype(np.float64) * _TO_UNIT
    k = ((second >> U(32)) * U(m - j) >> U(32)).astype(np.int64)
    return r, k + j


def signatures(elements: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """One row of m numbers per set; set i has elements[offsets[i]:offsets[i+1]], distinct 64-bit hashes.
    An empty set has infinities."""
    n = len(offsets) - 1
    out = np.full(n * m, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for lo in range(0, len(elements), CHUNK):
        seed, row = elements[lo:lo + CHUNK], owner[lo:lo + CHUNK]
        first, last = int(row[0]), int(row[-1]) + 1
        r, k = _draw(seed, 0, m)
        np.minimum.at(out, row * m + k, r)
        order = at = None
        for j in range(1, m):
            worst = out[first * m:last * m].reshape(-1, m).max(axis=1)
            going = worst[row - first] > j
            if not going.any():
                break
            if order is None:  # permutations only of elements that go on
                seed, row, k = seed[going], row[going], k[going]
                order = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.int32), (len(seed), 1))
                at = np.arange(len(seed))
                order[at, k] = 0
            elif not going.all():
                seed, row, order = seed[going], row[going], order[going]
                at = np.arange(len(seed))
            r, k = _draw(seed, j, m)
            place = order[at, k]
            order[at, k] = order[at, j]
            np.minimum.at(out, row * m + place.astype(np.int64), r + j)
    return out.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per set and band: the hash of the band's numbers and its own number."""
    bits = np.ascontiguousarray(signature[:, :bands * rows]).view(np.uint64).reshape(len(signature), bands, rows)
    key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), (len(signature), 1))
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * _STEP + bits[:, :, r])
    return key
