"""A minimal perfect hash over 64-bit keys: levels of bit arrays, ranked by counts of set bits.

Keys that are alone in their place of a level are settled there; the others go on to the next level. A key's
slot is the number of bits set before its own. Building and probing many keys are NumPy passes over all keys;
:func:`probe` finds one key in a stored table with a few reads of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEVELS = 48
_SPREAD = 2.0


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes.astype(np.uint64), words.astype("<u8")
        bits = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(bits)])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64."""
        sizes, parts, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, (int(len(left) * _SPREAD) + 63) // 64 * 64)
            place = mix(left, level) % np.uint64(size)
            counts = np.bincount(place.astype(np.int64), minlength=size)
            alone = counts == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place.astype(np.int64)]]
        if len(left):
            raise ValueError("keys repeat")
        return cls(np.array(sizes, np.uint64), np.concatenate(parts) if parts else np.zeros(0, "<u8"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots of ``keys``; -1 where no level has the key's bit. Other keys get a slot of some key."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = (mix(keys[open_], level) % size).astype(np.int64) + self.starts[level]
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            there = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[open_[there]] = (self.ranks[bit >> 6] + below)[there]
            open_ = open_[~there]
        return out

    def block_ranks(self) -> np.ndarray:
        """Bits set before each block of ``BLOCK`` words, as stored for :func:`probe`."""
        return self.ranks[:-1:BLOCK].astype("<u8")


#: Words of a block, whose rank is stored.
BLOCK = 8


def probe(key: int, sizes: np.ndarray, words: Callable[[int], np.ndarray], rank: Callable[[int], int]) -> int:
    """The slot of one key, -1 if no level has its bit.

    ``words(b)`` reads block ``b`` of the bit arrays and ``rank(b)`` its rank: two short reads for each level.
    """
    start = 0
    for level, size in enumerate(sizes.tolist()):
        bit = start + int(mix(np.array([key], np.uint64), level)[0]) % size
        block = words(bit // (64 * BLOCK))
        word, shift = bit // 64 % BLOCK, bit % 64
        if int(block[word]) >> shift & 1:
            below = int(np.bitwise_count(block[:word]).sum()) + (int(block[word]) & ((1 << shift) - 1)).bit_count()
            return rank(bit // (64 * BLOCK)) + below
        start += size
    return -1
