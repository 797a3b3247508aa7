"""Sharding by extendible hashing: a directory indexed by hash-prefix bits in which only oversized buckets split.

Every row has a 32-bit hash of its key. All rows begin in one bucket; a bucket that exceeds the limit splits on another
bit, until each fits. Splitting goes in steps of ``STEP`` bits: a step sums the prefixes below buckets that are oversized
so far, and of no others, and takes as buckets those that fit and whose parent does not. The sums come from one
aggregation of the rows by their first ``FIRST`` bits, and of those under a prefix that does not fit even there by all.

Rows find their bucket by the directory: the first bits of the hash, as many as the deepest bucket has, are its index,
and a bucket of fewer bits stands at all entries that begin with them. The directory has two levels, of ``FIRST`` bits at
most and of the rest below its oversized entries, so a deep bucket does not double all the others.

Rows whose 32 bits are all equal cannot be parted; if they exceed the limit together, their bucket has depth 32 and is
marked ``oversized``. The key is doc_id with the text's hash, so a repeated doc_id with other text may part; a null
doc_id or text hashes as the empty string. An empty table has no buckets, and writing it writes no shard. Other columns
are carried along by ``write_shards`` and not looked at; if one of them is called ``shard``, the folders' column is the
first of ``_shard``, ``__shard``, ... that is free.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

DEPTH = 32
#: Levels that one sum over the rows can tell apart at first; deeper ones are summed only below oversized buckets.
FIRST = 20
#: Bits that one step of splitting goes down.
STEP = 4


def key_hash(doc_id: Column, text: Column) -> Column:
    """The first 32 bits of the key's MD5, as a number."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def _split(sums: DataFrame, top: int, bottom: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """prefix, bytes, n_rows of depth ``bottom`` below oversized buckets of depth ``top`` -> the buckets found, and the sums still oversized at ``bottom``."""
    leaves, depth, open_sums = None, top, sums
    while depth <= bottom:
        last = min(depth + STEP - 1, bottom)
        each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("prefix", bottom - d).alias("at")) for d in range(depth, last + 1)]))
        level = open_sums.withColumn("e", each).groupBy("e.depth", "e.at").agg(F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"))
        level = written(level, "level")
        over = level.filter((F.col("bytes") > limit) & (F.col("depth") < DEPTH))
        parent = over.select((F.col("depth") + 1).alias("depth"), F.col("at").alias("up"))
        fits = level.filter((F.col("bytes") <= limit) | (F.col("depth") == DEPTH))
        found = fits.filter(F.col("depth") == depth).unionByName(
            fits.filter(F.col("depth") > depth).withColumn("up", F.shiftright("at", 1)).join(parent, ["depth", "up"], "left_semi").drop("up")
        )
        leaves = found if leaves is None else leaves.unionByName(found)
        still = over.filter(F.col("depth") == last).select("at")
        depth = last + 1
        if still.isEmpty():
            break
        open_sums = open_sums.withColumn("at", F.shiftright("prefix", bottom - last)).join(still, "at", "left_semi").drop("at")
    over = open_sums if depth > bottom and not still.isEmpty() else open_sums.limit(0)
    return leaves.withColumnRenamed("at", "prefix"), over


def buckets(hashed: DataFrame, limit: int) -> DataFrame:
    """hash, bytes of every row -> the buckets: depth, prefix, shard_bytes, shard_rows, oversized."""

    def sums(rows: DataFrame, bits: int) -> DataFrame:
        return written(rows.groupBy(F.shiftright("hash", DEPTH - bits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")), "sums")

    found, over = _split(sums(hashed, FIRST), 0, FIRST, limit)
    over = written(over.select("prefix"), "oversized")
    if not over.isEmpty():
        below = hashed.withColumn("prefix", F.shiftright("hash", DEPTH - FIRST)).join(over, "prefix", "left_semi").select("hash", "bytes")
        found = found.unionByName(_split(sums(below, DEPTH), FIRST + 1, DEPTH, limit)[0])
    return written(found.select("depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows"), (F.col("bytes") > limit).alias("oversized")), "directory")


def _looked_up(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows, by their column ``__hash``, with all columns of their bucket as ``__bucket``."""
    bucket = F.struct("depth", "prefix", "shard_bytes", "shard_rows", "oversized").alias("__bucket")
    out = None
    for level in (found.filter(F.col("depth") <= FIRST), found.filter(F.col("depth") > FIRST)):
        bits = level.agg(F.max("depth")).first()[0]  # one number
        if bits is None:
            continue
        spare = (F.lit(bits) - F.col("depth")).cast("int")
        first = F.call_function("shiftleft", F.col("prefix"), spare)
        last = F.call_function("shiftleft", F.col("prefix") + 1, spare) - 1
        entries = level.select(F.explode(F.sequence(first, last)).alias("__entry"), bucket)
        hit = rows.withColumn("__entry", F.shiftright("__hash", DEPTH - bits)).join(entries, "__entry").drop("__entry")
        out = hit if out is None else out.unionByName(hit)
    return rows.withColumn("__bucket", F.lit(None).cast("struct<depth:int,prefix:bigint,shard_bytes:bigint,shard_rows:bigint,oversized:boolean>")).limit(0) if out is None else out


def _name() -> Column:
    return F.expr("if(__bucket.depth = 0, '', substring(lpad(bin(__bucket.prefix), 32, '0'), 33 - __bucket.depth, __bucket.depth))")


def assign(docs: DataFrame, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, bytes, shard (the prefix as bits, depth of them), depth, shard_bytes, shard_rows, oversized of every row."""
    hashed = written(
        docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("bytes"), key_hash(docs[doc_id], docs[text]).alias("__hash")),
        "hashed",
    )
    placed = _looked_up(hashed, buckets(hashed.select(F.col("__hash").alias("hash"), "bytes"), limit))
    return placed.select("doc_id", "bytes", _name().alias("shard"), "__bucket.depth", "__bucket.shard_bytes", "__bucket.shard_rows", "__bucket.oversized")


def write_shards(docs: DataFrame, limit: int, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes ``docs`` with a folder per shard, and returns the buckets: depth, prefix, shard_bytes, shard_rows, oversized."""
    own = docs.withColumn("__hash", key_hash(docs[doc_id], docs[text]))
    found = buckets(docs.select(key_hash(docs[doc_id], docs[text]).alias("hash"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("bytes")), limit)
    folder = "shard"
    while folder in docs.columns:
        folder = f"_{folder}"
    placed = _looked_up(own, found).withColumn(folder, F.concat(F.lit("s"), _name())).select(*docs.columns, folder)
    placed.repartition(folder).write.partitionBy(folder).parquet(path)
    return found
