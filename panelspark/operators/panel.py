"""Panel construction: eligibility, snapshots, links, deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import tied_last
from ..schemas import ratio, require_columns


def trailing_adv(prices: DataFrame, dates: DataFrame, days: int = 40) -> DataFrame:
    """date, permno, adv: mean dollar volume over the calendar days up to each date.

    ``dates`` is a calendar, a few rows a month; its days are listed, so prices meet them by equality.
    """
    dollars = F.abs(F.col("prc")) * F.col("vol")
    each = F.explode(F.sequence(F.date_sub("date", days - 1), F.col("date"))).alias("date")
    near = prices.join(F.broadcast(dates.select(F.col("date").alias("as_of"), each)), "date")
    return near.groupBy(F.col("as_of").alias("date"), "permno").agg(F.avg(dollars).alias("adv"))


def valid_names(facts: DataFrame, names: DataFrame) -> DataFrame:
    """Facts with the name record that is valid on their date."""
    n = names.withColumnRenamed("permno", "__permno")
    hit = (F.col("permno") == F.col("__permno")) & F.col("date").between(F.col("namedt"), F.col("nameenddt"))
    return facts.join(n, hit).drop("__permno")


def top_by_cap(rows: DataFrame, n: int, eligible: Column) -> DataFrame:
    """The n largest eligible names per date, with their rank; equal caps by permno."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("marketcap"), "permno"))
    return rows.filter(eligible).withColumn("rank", rank).filter(F.col("rank") <= n)


def returns_panel(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Adjusted price and market cap of rows with a return in the inclusive window."""
    rows = prices.filter(F.col("ret").isNotNull() & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return rows.withColumns({
        "prc_adj": ratio(F.abs("prc"), F.nullif("cumfac", F.lit(0.0))), "marketcap": F.abs("prc") * F.col("shrout") * 1000, "is_delisting": F.lit(False),
    })


def with_delistings(panel: DataFrame, delistings: DataFrame) -> DataFrame:
    """Delisting rows appended: their return counts as retx too, other measures are NULL."""
    own = delistings.select("permno", "date", "ret", F.col("ret").alias("retx"), F.lit(True).alias("is_delisting"))
    return panel.unionByName(own, allowMissingColumns=True)


def one_row_per_day(panel: DataFrame) -> DataFrame:
    """Of several rows with one key the one that is no delisting row."""
    w = Window.partitionBy("permno", "date").orderBy("is_delisting")
    return require_columns(panel, "permno", "date", "is_delisting").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def wide(panel: DataFrame, value: str, ids: Sequence[int]) -> DataFrame:
    """date x permno, for the given ids; an edge operation."""
    return panel.groupBy("date").pivot("permno", list(ids)).agg(F.first(value))


def latest_name(names: DataFrame) -> DataFrame:
    return tied_last(names, "permno", [F.desc("namedt"), F.desc("ncusip")])


def link_table(names: DataFrame, companies: DataFrame) -> DataFrame:
    """permno, gvkey over the upper 8-character identifier; unmatched names keep a NULL, one name may have several."""
    key = F.upper(F.substring("ncusip", 1, 8)).alias("__k")
    c = companies.select("gvkey", F.upper(F.substring("cusip", 1, 8)).alias("__k")).distinct()
    return names.select("permno", key).distinct().join(c, "__k", "left").select("permno", "gvkey")


def first_snapshot(universe: DataFrame) -> DataFrame:
    return universe.groupBy("permno").agg(F.min("date").alias("first_snapshot_date"), F.countDistinct("date").alias("n_snapshots"))


def members_since(first: DataFrame, dates: DataFrame) -> DataFrame:
    """date, permno of every date on or after a name's first snapshot."""
    return first.join(F.broadcast(dates.select("date")), F.col("date") >= F.col("first_snapshot_date")).select("date", "permno")


def normal_id(c: Column) -> Column:
    """An identifier as a number's text: no leading zeros, no decimals; NULL if it is no number."""
    return F.try_to_number(F.regexp_extract(c, "^0*([0-9]+)(\\.0*)?$", 1), F.lit("9999999999999999")).cast("bigint")


def merge_ids(a: DataFrame, b: DataFrame, counts: DataFrame) -> DataFrame:
    """key, id, status of two sources; disagreements go to the id with more filings, ties to the second source."""
    both = a.select("key", F.col("id").alias("ida")).join(b.select("key", F.col("id").alias("idb")), "key", "full_outer")
    na = counts.select(F.col("id").alias("ida"), F.col("n").alias("na"))
    nb = counts.select(F.col("id").alias("idb"), F.col("n").alias("nb"))
    both = both.join(na, "ida", "left").join(nb, "idb", "left")
    x, y = F.col("ida"), F.col("idb")
    status = F.when(x.isNull() & y.isNull(), "none").when(y.isNull(), "a_only").when(x.isNull(), "b_only").when(x == y, "agree").otherwise("disagree")
    best = F.when(status == "disagree", F.when(F.coalesce("na", F.lit(0)) > F.coalesce("nb", F.lit(0)), x).otherwise(y)).otherwise(F.coalesce(x, y))
    return both.select("key", best.alias("id"), status.alias("status"))
