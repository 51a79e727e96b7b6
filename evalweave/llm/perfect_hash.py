"""A minimal perfect hash over 64-bit key hashes, in NumPy.

Level by level, every key left asks for one bit of a bit array twice as long as the keys left. Keys
alone on their bit are settled, the others go on. A key's slot is the number of set bits before its
own, so n keys have the slots 0 to n - 1, and a lookup reads a bounded number of bits. Stored
fingerprints tell keys that were never put in.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from evalweave.llm.batches import mix64, offsets_of

LOAD = 2
MAX_LEVELS = 64


class PerfectHash(NamedTuple):
    """``sizes``: bits of each level; ``words``: all bits; ``ranks``: set bits before each word."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray
    fingerprints: np.ndarray


def _bit(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    salted = mix64(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    return (salted % np.uint64(size)).astype(np.int64)


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


def build(hashes: np.ndarray) -> PerfectHash:
    """The index of distinct 64-bit hashes; equal ones are an error."""
    left, sizes, bits = hashes, [], []
    while len(left):
        if len(sizes) == MAX_LEVELS:
            raise ValueError("the key hashes are not distinct")
        size = -(-LOAD * len(left) // 64) * 64
        place = _bit(left, len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[place]]
    flat = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    words = np.packbits(flat, bitorder="little").view("<u8")
    ranks = offsets_of(np.bitwise_count(words).astype(np.int64))[:-1]
    index = PerfectHash(np.array(sizes, np.int64), words, ranks, np.zeros(len(hashes), np.uint32))
    slots = find(index, hashes, checked=False)
    index.fingerprints[slots] = fingerprints(hashes)
    return index


def find(index: PerfectHash, hashes: np.ndarray, checked: bool = True) -> np.ndarray:
    """The slot of each hash, or -1 where no key has it (but for 1 in 2**32 unknown keys)."""
    slots = np.full(len(hashes), -1, np.int64)
    open_, base = np.arange(len(hashes)), 0
    for level, size in enumerate(index.sizes.tolist()):
        if not len(open_):
            break
        bit = base + _bit(hashes[open_], level, size)
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        hit = (index.words[word] >> shift) & np.uint64(1) == 1
        below = index.words[word[hit]] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
        slots[open_[hit]] = index.ranks[word[hit]] + np.bitwise_count(below)
        open_, base = open_[~hit], base + size
    if checked and len(hashes):
        known = slots >= 0
        known[known] = index.fingerprints[slots[known]] == fingerprints(hashes[known])
        slots[~known] = -1
    return slots
