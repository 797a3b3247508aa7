"""Token ids as flat binary files.

Documents are dealt to ranges of ascending doc_id. The task of a range encodes its documents, ends each with ``end_id``
and writes three files: ``ids`` (unsigned 16- or 32-bit little-endian integers), ``offsets`` (64-bit, one more than
documents, from the range's first id) and ``docs`` (64-bit doc_ids). A file takes its name only when it is complete, so
a repeated task replaces it with the same content. The manifest, one row per range, gets each range's base from the
prefix sums of the ranges' id counts. Readers map the files into memory where they are local.

Null texts are empty and hold ``end_id`` alone. Rows are ordered by doc_id, a null doc_id first (stored as the least
64-bit integer), rows that repeat a doc_id by text. An empty table gives a manifest without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written
from .tokens import encoder, slices

#: Documents are dealt so that a range holds about so many bytes of text, or more where that would make too many ranges.
RANGE_BYTES = 16 << 20
MOST_RANGES = 20_000
NULL_ID = -(1 << 63)
MANIFEST = "range_id int, folder string, n_docs long, n_tokens long"


def _located(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _renamed(store: fs.FileSystem, part: str, name: str) -> None:
    try:
        store.move(part, name)
    except OSError:
        if store.get_file_info(name).type == fs.FileType.NotFound:
            raise
        store.delete_file(part)  # another attempt has written the same content


def _range_bounds(docs: DataFrame, doc_id: str, text: str) -> list[int]:
    """Upper ends of the ranges but the last, from approximate quantiles of doc_id: ``MOST_RANGES`` numbers at most."""
    seen = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(1, min(MOST_RANGES, round((seen["bytes"] or 0) / RANGE_BYTES)))
    if parts == 1:
        return []
    at = docs.agg(F.percentile_approx(F.col(doc_id).cast("long"), [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return sorted(set(at or []))


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes the files and returns the manifest: range_id, folder, n_docs, n_tokens, base."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    bounds = np.array(_range_bounds(docs, doc_id, text), np.int64)
    dtype = "<u2" if len(encoder(tokenizer).names) <= 1 << 16 and end_id < 1 << 16 else "<u4"

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
            yield batch.append_column("range_id", pa.array(np.searchsorted(bounds, key), pa.int32()))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        where, base = _located(folder)
        where.create_dir(base, recursive=True)
        own, out, paths, seen, total = None, None, [], None, 0

        def opened(range_id: int) -> None:
            nonlocal own, out, paths, seen, total
            own, seen, total = range_id, [], 0
            paths = [f"{base}/{range_id:08d}.{kind}" for kind in ("ids", "offsets", "docs")]
            mark = uuid.uuid4().hex
            out = [(where.open_output_stream(f"{p}.{mark}"), f"{p}.{mark}", p) for p in paths]
            out[1][0].write(np.zeros(1, "<i8").tobytes())

        def closed() -> pa.RecordBatch:
            for stream, part, name in out:
                stream.close()
                _renamed(where, part, name)
            return pa.RecordBatch.from_pydict({
                "range_id": pa.array([own], pa.int32()), "folder": pa.array([folder]),
                "n_docs": pa.array([sum(seen)], pa.int64()), "n_tokens": pa.array([total], pa.int64()),
            })

        for whole in batches:
            for batch in slices(whole):
                of = batch.column("range_id").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        continue
                    if of[a] != own:
                        if own is not None:
                            yield closed()
                        opened(int(of[a]))
                    part = batch.slice(a, b - a)
                    ids, at = encoder(tokenizer).encode_arrow(part.column("text"))
                    out[0][0].write(np.insert(ids, at[1:], end_id).astype(dtype).tobytes())
                    ends = at[1:] + np.arange(1, len(at)) + total
                    out[1][0].write(ends.astype("<i8").tobytes())
                    out[2][0].write(part.column("doc_id").fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                    seen.append(b - a)
                    total = int(ends[-1])
        if own is not None:
            yield closed()

    dealt = (
        docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
        .mapInArrow(ranges, "doc_id long, text string, range_id int")
        .repartitionById(len(bounds) + 1, F.col("range_id"))
        .sortWithinPartitions("range_id", F.col("doc_id").asc_nulls_first(), "text")
    )
    made = written(dealt.mapInArrow(store, MANIFEST), "manifest")
    # one row per range: the prefix sum is over MOST_RANGES numbers at most
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")).withColumn("dtype", F.lit(dtype))


def _mapped(where: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if where.get_file_info(path).size else np.zeros(0, dtype)
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start (ids before it), n_tokens, and its ids or their crc32."""
    last = pa.field("ids_crc32", pa.int64()) if digest else pa.field("ids", pa.list_(pa.int64()))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                where, folder = _located(row["folder"])
                name = f"{folder}/{row['range_id']:08d}"
                ids = _mapped(where, f"{name}.ids", row["dtype"])
                at, docs = _mapped(where, f"{name}.offsets", "<i8"), _mapped(where, f"{name}.docs", "<i8")
                for a in range(0, len(docs), 2000):
                    ends = np.array(at[a : a + 2001])
                    own = ids[ends[0] : ends[-1]].astype("<u4")
                    rel = ends - ends[0]
                    key = np.array(docs[a : a + 2000])
                    if digest:
                        raw = memoryview(own.tobytes())
                        rel4 = (4 * rel).tolist()
                        value = pa.array([zlib.crc32(raw[x:y]) for x, y in zip(rel4[:-1], rel4[1:], strict=True)], pa.int64())
                    else:
                        value = pa.ListArray.from_arrays(pa.array(rel, pa.int32()), pa.array(own.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key, mask=key == NULL_ID), pa.array(row["base"] + ends[:-1]), pa.array(np.diff(ends)), value], schema=schema
                    )

    parts = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.repartition(parts, "range_id").mapInArrow(load, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")
