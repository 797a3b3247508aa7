"""Mixing sources to target weights, with DataFrame functions only.

Documents get hash-random keys, are sorted by key within their source, and a distributed prefix sum of their sizes cuts
each source at its exact budget; a budget above a source's size repeats the source by whole epochs first.

The prefix sum never brings a source together: the first hex digits of the key give a range, ranges are summed (a few
rows per source), the sums are accumulated over the ranges, and only the rows of one range are sorted together. The
number of ranges grows with the number of rows.

Sizes are words; a null or empty text has size 0 and is taken 0 times. A null source is a source of its own, last in
order. Rows that repeat id and text have the same key and go through the sums as one, so it does not matter how many
there are. An empty table gives an empty result. The sources themselves (names and sizes) are expected to
fit one task; their documents are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import n_words, whole_row, words, written

#: Fixed weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
ROWS_PER_RANGE = 20_000
HEX = 16


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """source, source_size -> with weight and target.

    Sources whose cap (``most`` times their size) is small for their weight reach it; the others share the rest by
    weight. With sources ordered by cap per weight, the level that the others reach follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("level", F.col("cap") / F.col("weight"))
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open_weight": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)),
        "budget": F.sum("source_size").over(every) * F.lit(float(share)),
    })
    s = s.withColumn("reach", (F.col("budget") - F.col("capped")) / F.col("open_weight"))
    # the first source, in this order, whose level is not below what the open ones reach
    s = s.withColumn("water", F.min(F.when(F.col("level") >= F.col("reach"), F.struct("level", "reach"))).over(every)["reach"])
    return s.withColumn("target", F.when((F.col("level") < F.col("water")) | F.col("water").isNull(), F.col("cap")).otherwise(F.col("water") * F.col("weight")))


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """Of id and text, so that rows without an id do not share one."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), own).cast("binary"))


def _placed(docs: DataFrame, seed: int, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, key, doc_id, size, rows (that are equal in these), source_size, target, before (words before them in their source's order)."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"], n_words(docs["text"]).alias("size"), random_key(docs["doc_id"], docs["text"], seed).alias("key"))
    # equal rows go as one from here on, so no number of them meets in a task
    sized = written(rows.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("rows")), "sized")
    digits = 1
    while HEX**digits < sized.count() / ROWS_PER_RANGE and digits < 6:
        digits += 1
    ranged = sized.withColumns({"range": F.substring("key", 1, digits), "words": F.col("size") * F.col("rows")})
    sums = ranged.groupBy("source", "range").agg(F.sum("words").alias("range_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most).select("source", "source_size", "target")
    along = Window.partitionBy("s.source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
        .select("s.source", "range", "source_size", "target", F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("base"))
    )
    base = written(base, "bases")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("words").over(within), F.lit(0)))
    return (
        inside.alias("d").join(base.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.range") == F.col("b.range")))
        .select("d.source", "key", "doc_id", "size", "rows", "source_size", "target", (F.col("base") + F.col("inside")).alias("before"))
    )


def _budget() -> tuple[Column, Column]:
    """Whole epochs of a source, and the words that its last, cut epoch takes."""
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return epochs, budget - epochs * F.col("source_size")


def mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    epochs, left = _budget()
    each = _placed(docs, seed, weights, share, most).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    cut = F.least(F.greatest(left - F.col("before") - F.col("i") * F.col("size"), F.lit(0)), F.col("size"))
    return each.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, seed: int = 7, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``docs`` as the mix takes them: a row for each epoch, and the first words, joined by blanks, of a document that the cut divides.

    A source's budget ends at one key: rows with a smaller key are taken once more than whole epochs say, rows with a
    greater one are not, so documents meet their source's line and are neither looked up nor shuffled. Rows that share the
    key at the cut are equal in id and text: they are numbered, by partition and place, and the first ones are taken.
    Documents of size 0 hold no words to mix and are left out.
    """
    epochs, left = _budget()
    placed = _placed(docs, seed, weights, share, most).withColumns({"epochs": epochs, "left": left})
    line = F.max_by(F.struct("key", "size", (F.col("left") - F.col("before")).alias("rest")), F.when((F.col("before") < F.col("left")) & (F.col("size") > 0), F.col("key")))
    lines = placed.groupBy("source").agg(F.max("epochs").alias("epochs"), line.alias("cut")).select(F.col("source").alias("of"), "epochs", "cut.*")
    lines = written(lines, "lines")  # a row for each source
    text = F.coalesce(docs["text"], F.lit(""))
    solid = text.rlike("[^\\x20\\x09-\\x0D]")
    own = docs.filter(solid).select(docs["source"].alias("source"), random_key(docs["doc_id"], docs["text"], seed).alias("own_key"), whole_row(docs).alias("whole"))
    met = own.join(lines, own["source"].eqNullSafe(lines["of"])).select("own_key", "epochs", "key", "size", "rest", "whole")
    once_more = F.coalesce(F.col("own_key") < F.col("key"), F.lit(False)).cast("int")
    times = F.col("epochs").cast("int") + once_more
    full = met.select(F.explode(F.array_repeat(F.lit(0), times)).alias("part"), "whole")
    tied = written(met.filter("own_key = key").select("own_key", "size", "rest", "whole").withColumn("row", F.monotonically_increasing_id()), "tied")
    place = F.shiftright("row", 33).alias("place")  # the partition that the number was given in
    counts = tied.groupBy("own_key", place).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("own_key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("own_key").alias("tied_key"), F.col("place").alias("tied_place"), before.alias("n_before"), "low")
    # a partition's rows of one key need not be neighbours, so they are numbered among themselves
    inside = F.row_number().over(Window.partitionBy("own_key", place).orderBy("row")) - 1
    numbered = tied.withColumns({"place": F.shiftright("row", 33), "inside": inside}).join(counts, (F.col("own_key") == F.col("tied_key")) & (F.col("place") == F.col("tied_place")))
    part = F.least(F.greatest(F.col("rest") - (F.col("n_before") + F.col("inside")) * F.col("size"), F.lit(0)), F.col("size"))
    # a document that is taken as a whole keeps its text
    parts = numbered.select(F.when(part == F.col("size"), F.lit(0)).otherwise(part).cast("int").alias("part"), "whole", part.alias("own")).filter("own > 0").drop("own")
    out = full.unionByName(parts)
    first_words = F.array_join(F.slice(words(F.col("whole.text")), F.lit(1), F.col("part")), " ")
    cut_text = F.when(F.col("part") > 0, first_words).otherwise(F.col("whole.text"))
    columns = []
    for c in docs.columns:
        value = F.col("whole").getField(c)
        if c == "text":
            value = cut_text
        elif c == "n_chars":
            value = F.when(F.col("part") > 0, F.char_length(cut_text).cast(docs.schema["n_chars"].dataType)).otherwise(value)
        columns.append(value.alias(c))
    return out.select(*columns)
