"""Counting Bloom filter over 128-bit keys: which keys may occur twice or more.

Every task turns its keys into bit positions and sends only those, sorted by segment of the bit array; a second,
streaming pass merges a segment at a time, so a task holds one segment. The driver gets the finished bit array, whose
size is bounded by ``MAX_BITS`` (64 MB). Past the capacity that this gives, the filter fills up and answers "maybe" more
often: more rows take the exact path, and none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
HASHES = 4
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
SEGMENT = 1 << 19

Keys = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def bits_for(n_keys: int) -> int:
    want = max(MIN_BITS, min(MAX_BITS, BITS_PER_KEY * max(1, n_keys)))
    return 1 << (want - 1).bit_length()


def positions(hi: np.ndarray, lo: np.ndarray, bits: int) -> np.ndarray:
    """(keys, HASHES) bit positions by double hashing."""
    step = lo | np.uint64(1)
    return np.stack([(hi + np.uint64(i) * step) >> np.uint64(64 - bits.bit_length() + 1) for i in range(HASHES)], axis=1)


def build(df: DataFrame, keys: Keys, n_keys: int, least: int = 2) -> tuple[object, int]:
    """A broadcast of the bit array in which a bit is set if at least two keys set it, and its size in bits.

    With ``least`` 1 a bit is set if any key sets it, which makes a plain membership filter.
    ``keys`` gives the two 64-bit halves of every key of a record batch. A key that occurs twice finds all its bits
    set; a key that occurs once finds them all set only by chance (0.3 % within the capacity).
    """
    bits = bits_for(n_keys)
    segment = min(SEGMENT, bits)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = keys(batch)
            if not len(hi):
                continue
            own = np.sort(positions(hi, lo, bits), axis=1)
            own[:, 1:][own[:, 1:] == own[:, :-1]] = bits  # one key counts a bit once
            at = np.sort(own[own < bits].ravel())
            cut = np.flatnonzero(np.diff(at // np.uint64(segment))) + 1
            parts = np.split(at, cut)
            yield pa.RecordBatch.from_pydict({
                "segment": pa.array([int(p[0]) // segment for p in parts], pa.int32()),
                "at": pa.array([(p % np.uint64(segment)).astype("<u4").tobytes() for p in parts], pa.binary()),
            })

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None

        def done():
            return pa.RecordBatch.from_pydict({"segment": pa.array([now], pa.int32()), "bitmap": pa.array([np.packbits(counts >= least).tobytes()], pa.binary())})

        for batch in batches:
            for s, at in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if s != now:
                    if now is not None:
                        yield done()
                    now, counts = s, np.zeros(segment, np.uint8)
                found, n = np.unique(np.frombuffer(at.as_buffer(), "<u4"), return_counts=True)
                counts[found] = np.minimum(2, counts[found] + np.minimum(n, 2))
        if now is not None:
            yield done()

    parts = max(1, min(bits // segment, 64))
    rows = (
        df.mapInArrow(local, "segment int, at binary")
        .repartition(parts, "segment").sortWithinPartitions("segment")
        .mapInArrow(merge, "segment int, bitmap binary")
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in rows.collect():  # MAX_BITS in all
        start = row["segment"] * segment // 8
        bitmap[start : start + segment // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return df.sparkSession.sparkContext.broadcast(bitmap), bits


def maybe_repeated(bitmap: np.ndarray, bits: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    at = positions(hi, lo, bits)
    return ((bitmap[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)


def probe(bloom: tuple[object, int], keys: Callable[..., tuple[np.ndarray, np.ndarray]]) -> Callable[..., Column]:
    """A column function: whether a row's key may be in the filter; the row's other columns stay where they are."""
    bitmap, bits = bloom

    @F.arrow_udf("boolean")
    def found(column: pa.Array) -> pa.Array:
        return pa.array(maybe_repeated(bitmap.value, bits, *keys(column)) if len(column) else np.zeros(0, bool))

    return found
