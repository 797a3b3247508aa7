"""Sets of distinct 5-word shingles, as 64-bit hashes, of many texts at a time.

A-Z count as lower case; words are runs of anything but ASCII white space. A text with fewer than five words holds the
whole sequence as its one element; a null, empty or blank text holds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SHINGLE = 5
WORD_BASE, SHINGLE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    at = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    solid = ~BLANK[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = at[1:-1][at[1:-1] < len(raw)]
    first[edges] = solid[edges]  # a text's first character begins a word
    begins = np.flatnonzero(first)
    body = LOWER[raw[solid]]
    order = np.cumsum(solid) - 1
    starts = order[begins]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    lengths = np.diff(np.append(starts, len(body)))
    place = np.arange(len(body)) - np.repeat(starts, lengths)
    power = np.multiply.accumulate(np.full(int(lengths.max()), WORD_BASE))
    hashes = mixed(np.add.reduceat(BYTES[body] * power[place], starts) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(begins, at)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' sets, each in ascending order, flat, and where each begins (one more than texts)."""
    words, at = word_hashes(texts)
    n = np.diff(at)
    many = np.maximum(n - SHINGLE + 1, 0)
    of = np.repeat(np.arange(len(n)), many)
    where = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[:-1], many)
    sums = np.zeros(len(where), np.uint64)
    factor = 1
    for k in range(SHINGLE):
        factor = factor * int(SHINGLE_BASE) % (1 << 64)
        sums += words[where + k] * np.uint64(factor)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        extra = []
        for i in short.tolist():
            factor, total = 1, int(n[i])
            for w in words[at[i] : at[i + 1]].tolist():
                factor = factor * int(SHINGLE_BASE) % (1 << 64)
                total = (total + w * factor) % (1 << 64)
            extra.append(total)
        of, sums = np.concatenate([of, short]), np.concatenate([sums, np.array(extra, np.uint64)])
    hashes = mixed(sums)
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    if len(of):
        new = np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1]))
        of, hashes = of[new], hashes[new]
    return hashes, np.searchsorted(of, np.arange(len(n) + 1))


def class_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set."""
    raw = memoryview(np.ascontiguousarray(hashes)).cast("B")
    ends = (8 * at).tolist()
    return np.array([xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.uint64).view(np.int64)
