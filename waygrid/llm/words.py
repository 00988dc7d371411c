"""Words of whole batches of texts as NumPy arrays, without a Python object for each word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
#: Odd multipliers of the polynomial hashes over bytes and over words.
BYTE_P, WORD_P = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Words are runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are lower-cased: digits, a-z and all beyond ASCII.
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), p, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """Words of rows i..j: byte spans in `low` (lower-cased bytes from row i on), 64-bit hashes, row numbers from 0."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    n_rows: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n_rows).astype(np.int64)

    def text(self, k: int, n: int) -> bytes:
        """n words from word k on, joined by one space."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.start[k : k + n], self.end[k : k + n], strict=True))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words of one row, and the first word of each."""
        last = len(self.hash) - n + 1
        if last <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[:last] == self.row[n - 1 :])
        h = np.zeros(last, dtype=_U)
        for j in range(n):
            h *= WORD_P
            h += self.hash[j : j + last]
        return mix(h[at]), at


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the rows whose bytes are data[offsets[k]:offsets[k + 1]]."""
    base, n = int(offsets[0]), len(offsets) - 1
    low = LOWER[data[base : int(offsets[-1])]]
    inside = IS_WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offsets - base] = True
    if not len(low) or not inside.any():
        z = np.zeros(0, np.int64)
        return Words(low, z, z, np.zeros(0, _U), z, n)
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    first = inside & (~before | edge[:-1])
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(inside & (~after | edge[1:])) + 1
    length = end - start
    kept = low[inside]
    at = np.cumsum(length) - length
    place = np.arange(len(kept)) - np.repeat(at, length)
    value = powers(BYTE_P, int(length.max()))[place]
    value *= kept.astype(_U) + _U(1)
    return Words(low, start, end, mix(np.add.reduceat(value, at)), np.searchsorted(offsets - base, start, side="right") - 1, n)
