"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation many times, each time a few turns longer. A turn's hash is that of its number in the
conversation, its role and its text; a prefix has the exclusive or of its turns' hashes, in two 64-bit words, so equal
prefixes have equal hashes and each follows from the one before. Conversations with the same turns count as one (the
smallest conv_id stays), and a conversation whose turns begin a longer one is dropped by an anti-join against the
distinct proper prefixes of all. The others are rendered.

Turns are dealt by ranges of conversation and turn, so a very long conversation lies in several; numbers and prefix
hashes are made within each range and lifted by those of the ranges before. Texts come together only in a conversation
that is rendered.

Turns are ordered by turn number (null first), then role and text; rows that repeat a turn exactly count once. Null
roles and texts render as empty strings but differ from them in the hash. A row with a null conv_id is a conversation of
one turn, and equal ones count once. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, written

#: Fixed template of a turn.
TURN = "<|{role}|>\n{text}\n"


def rendered(role: Column, text: Column) -> Column:
    before, rest = TURN.split("{role}")
    between, after = rest.split("{text}")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(between), F.coalesce(text, F.lit("")), F.lit(after))


def turn_hash(role: Column, text: Column) -> Column:
    def part(c: Column) -> Column:
        return F.coalesce(F.md5(c.cast("binary")), F.lit("-"))

    return F.md5(F.concat(part(role), part(text)).cast("binary"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, alone (tells rows without a conv_id apart), role, text, k, n, a, b: the hash of the prefix of k of n turns."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", turn_hash(F.col("role"), F.col("text")).alias("h"))
    own = own.groupBy("conv_id", "turn", "role", "h").agg(F.any_value("text").alias("text"))
    own = own.withColumns({
        "alone": F.when(F.col("conv_id").isNull(), F.concat(F.coalesce(F.col("turn").cast("string"), F.lit("-")), F.lit(":"), "h")).otherwise(F.lit("")),
        "by_turn": F.coalesce("turn", F.lit(-(1 << 63))), "by_role": F.coalesce("role", F.lit("")), "by_text": F.coalesce("text", F.lit("")),
    })
    dealt = own.repartitionByRange(max(partitions(turns.sparkSession), 1), "conv_id", "alone", "by_turn", "by_role", F.substring("by_text", 1, 32))
    dealt = written(dealt.withColumn("block", F.spark_partition_id()), "turns")
    conv = ["conv_id", "alone"]
    within = Window.partitionBy(*conv, "block").orderBy("by_turn", "by_role", "by_text", "h")
    along = Window.partitionBy(*conv).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def lifted(rows: DataFrame, sums: DataFrame) -> DataFrame:
        s = sums.withColumnsRenamed({c: f"__{c}" for c in (*conv, "block")})
        return rows.join(s, rows["conv_id"].eqNullSafe(s["__conv_id"]) & (rows["alone"] == s["__alone"]) & (rows["block"] == s["__block"])).drop("__conv_id", "__alone", "__block")

    counts = dealt.groupBy(*conv, "block").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.select(*conv, "block", F.coalesce(F.sum("m").over(along), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(*conv)).alias("n"))
    numbered = lifted(dealt.withColumn("k", F.row_number().over(within)), counts).withColumn("k", F.col("k") + F.col("before"))
    numbered = written(numbered.select(*conv, "block", "role", "text", "k", "n", F.xxhash64("k", "h").alias("a"), F.xxhash64("h", "k").alias("b")), "numbered")
    sums = numbered.groupBy(*conv, "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    sums = sums.select(*conv, "block", *[F.coalesce(F.bit_xor(c).over(along), F.lit(0)).alias(f"before_{c}") for c in "ab"])
    inside = Window.partitionBy(*conv, "block").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chained = lifted(numbered.withColumns({c: F.bit_xor(c).over(inside) for c in "ab"}), sums)
    return written(chained.select(*conv, "role", "text", "k", "n", *[F.col(c).bitwiseXOR(F.col(f"before_{c}")).alias(c) for c in "ab"]), "prefixes")


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (conversations with the same turns), turns: the maximal conversations."""
    own = prefixes(turns)
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "alone")).alias("first")
    whole = own.filter("k = n").groupBy("n", "a", "b").agg(first, F.count(F.lit(1)).alias("n_copies"))
    shorter = own.filter("k < n").select(F.col("k").alias("n"), "a", "b").distinct()
    maximal = whole.join(shorter, ["n", "a", "b"], "left_anti").select(F.col("first.conv_id").alias("__id"), F.col("first.alone").alias("__alone"), "n_copies")
    kept = own.join(maximal, own["conv_id"].eqNullSafe(maximal["__id"]) & (own["alone"] == maximal["__alone"]))
    chats = kept.groupBy("conv_id", "alone", F.col("n").alias("n_turns"), "n_copies").agg(F.array_sort(F.collect_list(F.struct("k", "role", "text"))).alias("turns"))
    return chats.select("conv_id", "n_turns", "n_copies", "turns")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: the rendered maximal conversations."""
    chat = F.array_join(F.transform("turns", lambda t: rendered(t["role"], t["text"])), "")
    return collapse(turns).select("conv_id", "n_turns", "n_copies", chat.alias("chat"))
