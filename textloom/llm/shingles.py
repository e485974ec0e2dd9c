"""Word shingles of texts as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**64, 256, np.uint64)
PLACE_FACTORS = _rng.integers(1, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
#: Word bytes are white space at these places; the words themselves are the runs between.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z taken as a-z, words parted by ASCII white space. Long texts are taken in blocks that end between words."""
    raw = LOWER[np.frombuffer(text.encode(), np.uint8)]
    if len(raw) <= BLOCK:
        return block_hashes(raw)
    out, at = [], 0
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        out.append(block_hashes(raw[at:end]))
        at = end
    return np.concatenate(out)


def block_hashes(raw: np.ndarray) -> np.ndarray:
    gap = SPACE[raw]
    edge = np.diff(np.concatenate(([True], gap, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    # A word's hash is the sum of its bytes' mixed values, each by its place in the word, mixed with the length.
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = (np.arange(int(lengths.sum())) - np.repeat(first, lengths)).astype(np.uint64)
    sums = np.add.reduceat(mix(BYTE_VALUES[raw[~gap]] + place * MULTIPLIER), first)
    return mix(sums + lengths.astype(np.uint64))


def shingle_set(text: str, words: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``words`` words; of a shorter text, one hash of the whole sequence; of none, nothing."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = max(1, len(w) - words + 1)
    if len(w) < words:
        n, words = 1, len(w)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total += mix(w[k : k + n] * PLACE_FACTORS[k])
    return np.unique(mix(total + np.uint64(words)))
