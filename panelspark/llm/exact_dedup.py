"""Exact dedup: a two-pass Bloom filter finds possibly repeated hashes, and only those rows shuffle.

Texts are equal when they are identical without ASCII white space; a null text counts as an empty one, and all empty
texts are equal. Of equal texts the row with the most code points stays, then the one with the smallest doc_id (a null
doc_id comes last); of rows that repeat with the same doc_id one stays. An empty table gives an empty result.
Other columns of the table are carried along and never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats
from .shared import whole_row, written


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """rid, doc_id, n_points, sha (32 bytes) of every row; the text itself goes no further."""
    t = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.char_length(t).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", ""), 256)).alias("sha"),
    ).withColumn("rid", F.monotonically_increasing_id())


def halves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The first two 64-bit words of 32-byte hashes."""
    raw = np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, 4)
    return raw[:, 0].copy(), raw[:, 1].copy()


def decide(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: rid, doc_id, n_points, sha, keep_id, group_size, kept."""
    rows = written(fingerprints(docs, text, doc_id), "fingerprints")
    bitmap, bits = repeats.build(rows.select("sha"), lambda b: halves(b.column(0)), rows.count())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = repeats.maybe_repeated(bitmap.value, bits, *halves(batch.column(batch.schema.get_field_index("sha")))) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, "maybe"])

    probed = written(rows.mapInArrow(probe, "doc_id long, n_points long, sha binary, rid long, maybe boolean"), "probed")
    single = probed.filter(~F.col("maybe")).select(
        "rid", "doc_id", "n_points", "sha", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")
    )
    again = probed.filter("maybe").drop("maybe")
    groups = written(again.groupBy("sha").agg(F.min(_best()).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    shared = again.join(groups, "sha").select(
        "rid", "doc_id", "n_points", "sha", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept")
    )
    return single.unionByName(shared)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose hash is not repeated pass where they are. Only those that the filter holds are written with a number and
    grouped by hash, without their texts; the numbers that stay then pick the rows.
    """
    t = F.coalesce(docs[text], F.lit(""))
    sha = F.unhex(F.sha2(F.regexp_replace(t, "[\\x20\\x09-\\x0D]+", ""), 256))
    own = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.char_length(t).cast("long").alias("n_points"), sha.alias("sha"), whole_row(docs).alias("whole"))
    bloom = repeats.build(own.select("sha"), lambda b: halves(b.column(0)), docs.count())
    probed = own.withColumn("maybe", repeats.probe(bloom, halves)("sha"))
    again = written(probed.filter("maybe").drop("maybe").withColumn("rid", F.monotonically_increasing_id()), "again")
    stay = again.groupBy("sha").agg(F.min(_best()).alias("best")).select(F.col("best.rid").alias("rid"))
    return probed.filter(~F.col("maybe")).select("whole.*").unionByName(again.join(stay, "rid", "left_semi").select("whole.*"))


def _best() -> Column:
    """Of equal texts the row with the least value stays; ~x falls where x grows, at every 64-bit integer."""
    return F.struct(F.bitwise_not("n_points").alias("long"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "rid")
