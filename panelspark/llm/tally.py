"""How many sets hold each element: counted by segments of the hash range, not by a shuffled row for each element.

A task gathers some ``GATHERED`` elements of its sets and sends each segment of the hash range one row with the
remainders of its elements; the segment's task answers with a byte for each of them, the number of sets in the whole
table that hold it (``MOST`` at most). A third step brings the answers back to what the sender kept of its sets, the
roster. Both ways a row carries many elements, so the exchange moves about five bytes for each, at any number of
segments that is small against ``GATHERED``; the number of segments follows the session's shuffle partitions. A very
frequent element comes once from each sender, with its count there.

Remainders have 32 bits. Two elements of one segment that share them are counted together, so a count is never too
low: an element is told to be shared when it may not be, never the other way round. Rows are keyed by the content of
the sets, so a task that runs again sends the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

GATHERED = 2_000_000
#: Sets of one roster, which are numbered by 16 bits.
SETS = 60_000
MOST = 255
PASS, ASK, ROSTER = 0, 1, 2
#: Rows of other kinds are dealt by negative segments.
SPREAD = 997

SCHEMA = "seg int, slice long, kind int, doc_id long, n long, cls long, data binary"
NAMES = ["seg", "slice", "kind", "doc_id", "n", "cls", "data"]


def _batch(seg, slice_, kind, doc_id=None, n=None, cls=None, data=None) -> pa.RecordBatch:
    rows = len(seg)
    longs = [pa.array(c) if c is not None else pa.nulls(rows, pa.int64()) for c in (doc_id, n, cls)]
    return pa.RecordBatch.from_arrays(
        [pa.array(seg, pa.int32()), pa.array(slice_, pa.int64()), pa.array([kind] * rows, pa.int32()), *longs, pa.array(data, pa.binary()) if data is not None else pa.nulls(rows, pa.binary())], names=NAMES
    )


def passed(doc_id: pa.Array, n: np.ndarray, cls: np.ndarray) -> pa.RecordBatch:
    """Rows that only travel along."""
    return _batch((-1 - np.abs(cls % SPREAD)).astype(np.int32), np.zeros(len(n), np.int64), PASS, doc_id, n, cls)


def asked(elements: np.ndarray, counts: np.ndarray, segments: int, key: bytes, roster: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of one sender: its elements (distinct, ascending) with the number of its sets that hold each, and its roster."""
    own = np.int64(xxhash.xxh3_64_intdigest(key) - (1 << 63))
    seg = ((elements >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int32)
    begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else np.zeros(0, np.int64)
    rest, few = elements.astype("<u4"), np.minimum(counts, MOST).astype(np.uint8)
    data = [rest[a:b].tobytes() + few[a:b].tobytes() for a, b in zip(begin, [*begin[1:], len(seg)], strict=True)]
    if data:
        yield _batch(seg[begin], np.full(len(data), own), ASK, data=data)
    yield _batch([-1 - abs(int(own) % SPREAD)], [own], ROSTER, data=[roster])


def answered(rows: DataFrame, parts: int) -> DataFrame:
    """The rows of ``asked`` and ``passed``; in the data of ASK rows the counts of all sets, a byte each."""

    def reply(held: list[tuple[int, bytes]], seg: int) -> pa.RecordBatch:
        sizes = [len(d) // 5 for _, d in held]
        rest = np.concatenate([np.frombuffer(d, "<u4", n) for (_, d), n in zip(held, sizes, strict=True)])
        few = np.concatenate([np.frombuffer(d, np.uint8, n, 4 * n) for (_, d), n in zip(held, sizes, strict=True)])
        order = np.argsort(rest, kind="stable")
        by = rest[order]
        begin = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        sums = np.minimum(np.add.reduceat(few[order].astype(np.int64), begin), MOST).astype(np.uint8)
        full = np.empty(len(rest), np.uint8)
        full[order] = np.repeat(sums, np.diff(np.append(begin, len(rest))))
        ends = np.cumsum(sizes).tolist()
        return _batch([seg] * len(held), [s for s, _ in held], ASK, data=[full[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            kind = batch.column(2).to_numpy()
            other = np.flatnonzero(kind != ASK)
            if len(other):
                yield batch.take(pa.array(other))
            ask = batch.take(pa.array(np.flatnonzero(kind == ASK)))
            for seg, own, data in zip(ask.column(0).to_pylist(), ask.column(1).to_pylist(), ask.column(6).to_pylist(), strict=True):
                if seg != now and held:
                    yield reply(held, now)
                    held = []
                now = seg
                held.append((own, data))
        if held:
            yield reply(held, now)

    return rows.repartition(parts, "seg").sortWithinPartitions("seg").mapInArrow(segment, SCHEMA)


def returned(rows: DataFrame, work: Callable[[bytes, np.ndarray], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """``work(roster, counts)`` of every sender, the counts in the order of its elements."""

    def sender(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, roster, data = None, None, None, []
        for batch in batches:
            for own, kind, seg, d in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (own, kind, seg) == last:  # another sender had the same sets: its answers are the same
                    continue
                if own != now and now is not None:
                    yield from work(roster, np.frombuffer(b"".join(data), np.uint8))
                    data = []
                now, last = own, (own, kind, seg)
                if kind == ROSTER:
                    roster = d
                else:
                    data.append(d)
        if now is not None:
            yield from work(roster, np.frombuffer(b"".join(data), np.uint8))

    back = rows.filter(F.col("kind") != PASS).select("slice", "kind", "seg", "data")
    return back.repartition(parts, "slice").sortWithinPartitions("slice", F.desc("kind"), "seg").mapInArrow(sender, schema)


def segments(rows: DataFrame) -> int:
    return 2 * max(1, partitions(rows.sparkSession))
