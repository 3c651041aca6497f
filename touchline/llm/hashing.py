"""64-bit hashes of words and word windows for many texts at once.

Words are runs of bytes other than space and 0x09-0x0D. A word is read in pieces of eight bytes; each piece is mixed with its
number in the word before the sum, so no Python code runs for each word and no identity of sums carries over to words.
"""

from __future__ import annotations

import numpy as np

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Rolling hashes of byte windows (``suffix_dedup``): a polynomial over random byte values, modulo 2^64.
_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}

_ONE, _TWO = np.random.default_rng(20240229).integers(1, 2**63, 2, dtype=np.uint64)

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _series(base: int, length: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < length:
        steps = np.full(max(length, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:length]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of several texts: byte range (in ``data``), hash, and the first word of each text (one more entry at the end)."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b" ".join(texts) + b" "
        if lower:
            data = data.lower()
        self.data = data
        line = np.frombuffer(data, np.uint8)
        blank = BLANK[line]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = self._hashes(data)
        at = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text_at = at
        self.first = np.searchsorted(self.start, at)

    def _hashes(self, data: bytes) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.empty(0, np.uint64)
        pieces = (size + 7) // 8
        first = np.cumsum(pieces) - pieces
        word = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(len(word)) - first[word]
        eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))[self.start[word] + 8 * number]
        left = np.minimum(size[word] - 8 * number, 8).astype(np.uint64)
        eight &= np.uint64(2**64 - 1) >> (np.uint64(64) - np.uint64(8) * left)
        sums = np.add.reduceat(mix(mix(eight + _ONE) ^ (number.astype(np.uint64) * M1 + _TWO)), first)
        return mix(sums + size.astype(np.uint64) * M2)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` consecutive words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= M1
        out ^= out >> np.uint64(29)
        out += hashes[k : n + k]
    return mix(out)
