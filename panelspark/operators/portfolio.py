"""Holding-period returns, sorted portfolios, exposures, betas and covariances."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import trailing, xs
from ..schemas import ratio, require_columns
from .asof import asof_by_key, last_before


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("permno").orderBy("date")))


def forward_returns(returns: DataFrame, dates: DataFrame, n: int = 21, max_days: float | None = None) -> DataFrame:
    """rebalance_date, permno, fwd_return, n_days: the first n rows strictly after each date, compounded.

    The n-row product is a window over each security's rows, and an as-of join forward picks the first row after the
    date, so no row is repeated per holding period. With ``max_days`` rows later than that many calendar days a row are
    left out: the as-of join then gives the first row's number, and the n rows are joined by number.
    """
    rows = require_columns(returns, "permno", "date", "ret").filter(F.col("ret").isNotNull())
    grid = rows.select("permno").distinct().crossJoin(F.broadcast(dates.select(F.col("date").alias("rebalance_date"))))
    if max_days:
        own = _numbered(rows.select("permno", "date", F.log1p("ret").alias("g")))
        first = asof_by_key(grid, own, ["permno"], "rebalance_date", "date", ["k"], forward=True).filter("k is not null")
        held = first.select("permno", "rebalance_date", F.explode(F.sequence(F.col("k"), F.col("k") + n - 1)).alias("k")).join(own, ["permno", "k"])
        got = held.filter(F.datediff("date", "rebalance_date") <= int(max_days * n)).groupBy("rebalance_date", "permno").agg(F.sum("g").alias("log_return"), F.count(F.lit(1)).alias("n_days"))
    else:
        w = Window.partitionBy("permno").orderBy("date").rowsBetween(0, n - 1)
        ahead = rows.select("permno", "date", F.sum(F.log1p("ret")).over(w).alias("log_return"), F.count(F.lit(1)).over(w).alias("n_days"))
        got = asof_by_key(grid, ahead, ["permno"], "rebalance_date", "date", ["log_return", "n_days"], forward=True).filter(F.col("n_days").isNotNull())
    return got.select("rebalance_date", "permno", F.expm1("log_return").alias("fwd_return"), "n_days")


def long_short(sorted_: DataFrame, fwd: DataFrame, n: int = 5, long_top: bool = True, weight: str | None = None, by: Sequence[str] = ("date",), bucket: str = "quintile") -> DataFrame:
    """date, long_return, short_return, ls_return, n_long, n_short of the outer buckets, equal or value weighted."""
    got = sorted_.join(fwd.withColumnRenamed("rebalance_date", "date"), ["date", "permno"], "left").filter(F.col("fwd_return").isNotNull())
    ends = (n, 1) if long_top else (1, n)

    def leg(k: int) -> Column:
        inside = F.col(bucket) == k
        if not weight:
            return F.avg(F.when(inside, F.col("fwd_return")))
        some = inside & F.col(weight).isNotNull()
        return ratio(F.sum(F.when(some, F.col(weight) * F.col("fwd_return"))), F.sum(F.when(some, F.col(weight))))

    got = got.groupBy(*by).agg(leg(ends[0]).alias("long_return"), leg(ends[1]).alias("short_return"), F.count_if(F.col(bucket) == ends[0]).alias("n_long"), F.count_if(F.col(bucket) == ends[1]).alias("n_short"))
    return got.select(*by, "long_return", "short_return", (F.col("long_return") - F.col("short_return")).alias("ls_return"), "n_long", "n_short")


def bucket_stats(df: DataFrame, bucket: Sequence[str] = ("quintile",), r: str = "fwd_return", periods: int = 12) -> DataFrame:
    """Mean, deviation, count, annual return and Sharpe ratio over dates of each bucket's mean return per date."""
    per = df.filter(F.col(r).isNotNull()).groupBy("date", *bucket).agg(F.avg(r).alias("m"), F.count(F.lit(1)).alias("n"))
    got = per.groupBy(*bucket).agg(F.avg("m").alias("mean_return"), F.stddev_samp("m").alias("std_return"), F.count(F.lit(1)).alias("n_dates"), F.avg("n").alias("mean_names"))
    return got.withColumns({"ann_return": F.pow(1 + F.col("mean_return"), F.lit(periods)) - 1, "sharpe": ratio(F.col("mean_return"), F.col("std_return")) * F.sqrt(F.lit(float(periods)))})


def betas(returns: DataFrame, factors: DataFrame, dates: DataFrame, window: int = 60, least: int = 20, floor: float = 1e-20) -> DataFrame:
    """date, permno, beta, n_obs: slope on the market over the last ``window`` factor dates at or before each date."""
    ranked = factors.select("date", "mktrf", F.row_number().over(Window.orderBy("date")).alias("k"))  # one row a day
    last = dates.select(F.col("date").alias("as_of")).join(F.broadcast(factors.select(F.col("date").alias("__d"))), F.col("__d") <= F.col("as_of")).groupBy("as_of").agg(F.count(F.lit(1)).alias("k0"))
    days = last.join(ranked, (F.col("k") <= F.col("k0")) & (F.col("k") > F.col("k0") - window)).select("as_of", "date", "mktrf")
    got = returns.filter(F.col("ret").isNotNull()).join(F.broadcast(days), "date").groupBy(F.col("as_of").alias("date"), "permno").agg(
        F.covar_pop("ret", "mktrf").alias("c"), F.var_pop("mktrf").alias("v"), F.count(F.lit(1)).alias("n_obs")
    )
    return got.select("date", "permno", F.when((F.col("n_obs") >= least) & (F.col("v") >= floor), F.col("c") / F.col("v")).alias("beta"), "n_obs")


def complete_dates(returns: DataFrame) -> DataFrame:
    """Rows of the dates on which every security has a return."""
    rows = returns.filter(F.col("ret").isNotNull())
    total = rows.agg(F.countDistinct("permno").alias("total"))
    full = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).filter(F.col("n") == F.col("total")).select("date")
    return rows.join(full, "date", "left_semi")


#: Securities whose vectors one task multiplies with those of as many others.
BLOCK = 256
#: Days a bitmap word holds.
WORD = 32


def _day_bits(returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calendar (day, k) of all rows with a return, and each security's days on it as words of bits (permno, word, bits)."""
    rows = returns.filter(F.col("ret").isNotNull()).select("permno", F.col("date").alias("day"))
    days = rows.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day")) - 1)  # one row a day
    bits = rows.join(F.broadcast(days), "day").groupBy("permno", F.floor(F.col("k") / WORD).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(k % {WORD} as int))")).alias("bits"))
    return days, bits


#: Why a period is skipped, in the order in which it is looked for.
SKIPS = ("no universe", "no returns up to the date", "no returns after the date", "no composite", "short covariance window", "short holding period", "few common names")


def period_inputs(dates: DataFrame, members: DataFrame, returns: DataFrame, composite: DataFrame, beta: DataFrame, sector: DataFrame, window: int = 252, holding: int = 21, least: int = 5) -> DataFrame:
    """One row per date of ``dates``: what a period's portfolio could be made of, and why it is skipped, if it is.

    Only a date's universe counts. n_days and n_holding are the days up to and after the date on which one of its names
    has a return: bitmaps of names, joined by OR. n_composite, n_beta, n_sector, n_past and n_future are its names with a
    composite row, a beta, a sector, a return up to the date and one after it; n_common those with all five, n_alpha
    those of them whose composite is not missing. ``skip_reason`` is the first of SKIPS that holds, NULL for a period to run.
    """
    days, bits = _day_bits(returns)
    own = members.select("date", "permno").distinct()
    at = own.select("date").distinct().join(F.broadcast(days), F.col("day") <= F.col("date"), "left").groupBy("date").agg(F.coalesce(F.max("k"), F.lit(-1)).alias("k"))
    union = own.join(bits, "permno").groupBy("date", "word").agg(F.bit_or("bits").alias("bits")).join(F.broadcast(at), "date")
    full = (1 << WORD) - 1
    last = F.floor(F.col("k") / WORD).cast("int")
    past = F.when(F.col("word") < last, F.lit(full)).when(F.col("word") == last, F.expr(f"shiftleft(2L, cast(k % {WORD} as int)) - 1")).otherwise(F.lit(0))
    past = F.when(F.col("k") < 0, F.lit(0)).otherwise(past)
    counted = union.groupBy("date").agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(past))).alias("n_days"), F.sum(F.bit_count(F.col("bits").bitwiseAND(F.lit(full) - past))).alias("n_holding"))
    ends = returns.filter(F.col("ret").isNotNull()).groupBy("permno").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    yes = F.lit(True)
    names = own.join(ends, "permno", "left").join(composite.select("date", "permno", F.col("composite_z").alias("alpha"), yes.alias("in_composite")), ["date", "permno"], "left")
    names = names.join(beta.filter("beta is not null").select("date", "permno", yes.alias("in_beta")), ["date", "permno"], "left").join(sector.filter("sector is not null").select("date", "permno", yes.alias("in_sector")), ["date", "permno"], "left")
    parts = {"n_composite": F.col("in_composite"), "n_beta": F.col("in_beta"), "n_sector": F.col("in_sector"), "n_past": F.col("first") <= F.col("date"), "n_future": F.col("last") > F.col("date")}
    parts = {c: F.coalesce(e, F.lit(False)) for c, e in parts.items()}
    every = functools.reduce(lambda p, q: p & q, parts.values())
    g = names.groupBy("date").agg(F.count(F.lit(1)).alias("n_universe"), *[F.count_if(e).alias(c) for c, e in parts.items()], F.count_if(every).alias("n_common"), F.count_if(every & F.col("alpha").isNotNull()).alias("n_alpha"))
    got = dates.select("date").distinct().join(g, "date", "left").join(counted, "date", "left").fillna(0, ["n_universe", *parts, "n_common", "n_alpha", "n_days", "n_holding"])
    tests = [F.col("n_universe") == 0, F.col("n_days") == 0, F.col("n_holding") == 0, F.col("n_composite") == 0, F.col("n_days") < window, F.col("n_holding") < holding, F.col("n_common") < least]
    reason = F.lit(None).cast("string")
    for text, test in reversed(list(zip(SKIPS, tests, strict=True))):
        reason = F.when(test, text).otherwise(reason)
    return got.withColumn("skip_reason", reason)


def covariance_windows(returns: DataFrame, members: DataFrame, window: int) -> DataFrame:
    """date, days: for each date of ``members`` the complete days among its last ``window`` days.

    Days are those on which a member of the date has a return, at or before the date; a day is complete if all members
    have one. Each security's days are a bitmap over the calendar; a date's days are the bitwise OR of its members'
    bitmaps, its complete days the AND, so no row is made for a member and a day. Dates with fewer than ``window`` days or
    fewer than two complete ones are left out.
    """
    days, bits = _day_bits(returns)
    words = F.floor(F.col("k") / WORD).cast("int")
    last = members.select("date").distinct().join(F.broadcast(days), F.col("day") <= F.col("date"), "left").groupBy("date").agg(F.max("k").alias("k"))
    size = members.groupBy("date").agg(F.countDistinct("permno").alias("n_members"))
    own = members.select("date", "permno").distinct().join(bits, "permno").join(F.broadcast(last), "date").filter(F.col("word") <= words)
    past = F.when(F.col("word") < words, F.lit((1 << WORD) - 1)).otherwise(F.expr(f"shiftleft(2L, cast(k % {WORD} as int)) - 1"))
    held = own.groupBy("date", "word", "k").agg(F.bit_or("bits").alias("some"), F.bit_and("bits").alias("every"), F.count(F.lit(1)).alias("n")).join(F.broadcast(size), "date")
    held = held.select("date", "word", F.col("some").bitwiseAND(past).alias("some"), F.when(F.col("n") == F.col("n_members"), F.col("every").bitwiseAND(past)).otherwise(F.lit(0)).alias("every"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))
    each = held.select("date", (F.col("word") * WORD).alias("base"), "some", "every", bit.alias("bit")).filter(F.getbit("some", F.col("bit")) == 1)
    each = each.select("date", (F.col("base") + F.col("bit")).alias("k"), (F.getbit("every", F.col("bit")) == 1).alias("complete"))
    order = Window.partitionBy("date").orderBy(F.desc("k"))
    near = each.withColumns({"back": F.row_number().over(order), "n": F.count(F.lit(1)).over(Window.partitionBy("date"))}).filter((F.col("back") <= window) & (F.col("n") >= window) & F.col("complete"))
    got = near.join(F.broadcast(days), "k").groupBy("date").agg(F.array_sort(F.collect_list("day")).alias("days"))
    return got.filter(F.size("days") >= 2)


_ENTRY = "date date, permno_i long, permno_j long, cov double, shrinkage double"
_TERMS = "date date, corr double, pairs double, pi double, ss double, sd_s double, sd2 double"


def _block_rows(returns: DataFrame, members: DataFrame, windows: DataFrame) -> DataFrame:
    """date, p, q and two blocks of vectors: the date's members over its complete days, cut to blocks of ``BLOCK`` names.

    A vector belongs to one name and date; it is sent to each pair of blocks that its own is in.
    """
    number = F.row_number().over(Window.partitionBy("date").orderBy("permno")) - 1
    named = members.select("date", "permno").distinct().join(F.broadcast(windows.select("date").distinct()), "date").withColumn("own", F.floor(number / BLOCK).cast("int"))
    blocks = named.groupBy("date").agg((F.max("own") + 1).alias("blocks"))
    days = windows.select("date", F.explode("days").alias("day"))
    x = named.join(F.broadcast(days), "date").join(returns.select("permno", F.col("date").alias("day"), "ret"), ["permno", "day"])
    vectors = x.groupBy("date", "permno", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "ret"))), lambda v: v["ret"]).alias("x"))
    spread = vectors.join(F.broadcast(blocks), "date").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("date", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "permno", "x")


def _product(key: tuple, table: pa.Table) -> tuple[np.ndarray, ...] | None:
    """Names, covariances and fourth moments of two blocks, and which entries are to be kept (i < j, or i <= j)."""
    own = table["own"].to_numpy()
    parts = []
    for k in key:
        some = table.filter(pa.array(own == k)).sort_by("permno")
        x = some["x"].combine_chunks()
        parts.append((some["permno"].to_numpy(), x.flatten().to_numpy().reshape(len(x), -1) if len(x) else np.zeros((0, 1))))
    (i, a), (j, b) = parts
    if not len(i) or not len(j):
        return None
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    t = a.shape[1]
    m4 = (a * a) @ (b * b).T / t
    return i, j, a @ b.T / t, m4, (a * a).mean(1), (b * b).mean(1), t


def _terms(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums of a block that the shrinkage of its date needs; off-diagonal entries count twice."""
    date, p, q = key[0].as_py(), key[1].as_py(), key[2].as_py()
    got = _product((p, q), table)
    if got is None:
        return pa.table({c.split()[0]: [] for c in _TERMS.split(", ")}, schema=_arrow(_TERMS))
    i, j, s, m4, vi, vj, _ = got
    sd = np.sqrt(vi[:, None] * vj[None, :])
    off = i[:, None] < j[None, :]
    fine = off & (sd > 0)
    weight = np.where(off, 2.0, 0.0) + (i[:, None] == j[None, :])
    corr = np.divide(s, sd, out=np.zeros_like(s), where=sd > 0)
    row = [corr[fine].sum(), fine.sum(), (weight * (m4 - s * s)).sum(), 2 * (s * s)[off].sum(), 2 * (sd * s)[off].sum(), 2 * (sd * sd)[off].sum()]
    return pa.table([pa.array([date], pa.date32()), *[pa.array([float(v)]) for v in row]], schema=_arrow(_TERMS))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"date": pa.date32(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _entries(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    date, p, q = key[0].as_py(), key[1].as_py(), key[2].as_py()
    got = _product((p, q), table)
    if got is None:
        return pa.table({c.split()[0]: [] for c in _ENTRY.split(", ")}, schema=_arrow(_ENTRY))
    i, j, s, _, vi, vj, _ = got
    rho, shrinkage, periods = (table[c][0].as_py() for c in ("rho", "shrinkage", "periods"))
    same = i[:, None] == j[None, :]
    target = np.where(same, s, rho * np.sqrt(vi[:, None] * vj[None, :]))
    v = (shrinkage * target + (1 - shrinkage) * s) * periods
    keep = i[:, None] <= j[None, :]
    a, b = np.broadcast_to(i[:, None], s.shape)[keep], np.broadcast_to(j[None, :], s.shape)[keep]
    n = len(a)
    return pa.table([pa.array(np.full(n, np.datetime64(date, "D"))), pa.array(a), pa.array(b), pa.array(v[keep]), pa.array(np.full(n, shrinkage))], schema=_arrow(_ENTRY))


def covariance(returns: DataFrame, members: DataFrame, window: int, shrink: bool = False, periods: float = 1.0) -> DataFrame:
    """date, permno_i, permno_j (i <= j), cov, shrinkage: maximum-likelihood covariance of each date's members.

    Moments are over the complete days among the date's last ``window`` days. With ``shrink`` the matrix is moved towards
    constant correlation: ``pi`` is the summed variance of the sample entries, ``gamma`` the squared distance to the
    target, off-diagonal entries count twice, and the covariance of sample and target is left out. A task multiplies two
    blocks of vectors of one date; what the shrinkage needs are sums of blocks, so pairs are never joined or shuffled.
    """
    windows = covariance_windows(returns, members, window)
    rows = _block_rows(returns.filter(F.col("ret").isNotNull()), members, windows)
    if not shrink:
        return rows.withColumns({"rho": F.lit(0.0), "shrinkage": F.lit(0.0), "periods": F.lit(float(periods))}).groupBy("date", "p", "q").applyInArrow(_entries, _ENTRY)
    sums = rows.groupBy("date", "p", "q").applyInArrow(_terms, _TERMS).groupBy("date").agg(*[F.sum(c).alias(c) for c in ("corr", "pairs", "pi", "ss", "sd_s", "sd2")])
    sums = sums.withColumn("rho", F.coalesce(ratio(F.col("corr"), F.col("pairs")), F.lit(0.0)))
    gamma = F.col("rho") * F.col("rho") * F.col("sd2") - 2 * F.col("rho") * F.col("sd_s") + F.col("ss")
    n = windows.select("date", F.size("days").alias("t"))
    share = sums.join(F.broadcast(n), "date").withColumn("shrinkage", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio(F.col("pi"), gamma) / F.col("t"), F.lit(0.0)))))
    both = rows.join(F.broadcast(share.select("date", "rho", "shrinkage")), "date").withColumn("periods", F.lit(float(periods)))
    return both.groupBy("date", "p", "q").applyInArrow(_entries, _ENTRY)


def sector_last(fund: DataFrame, dates: DataFrame) -> DataFrame:
    """date, permno, sector: the latest known sector by announcement date."""
    members = fund.select("permno").distinct().crossJoin(F.broadcast(dates.select("date")))
    return asof_by_key(members, fund.filter(F.col("gsector").isNotNull()), ["permno"], "date", "rdq", ["gsector"], ties=["gsector"]).filter(F.col("gsector").isNotNull()).select("date", "permno", F.col("gsector").alias("sector"))


def realized_returns(weights: DataFrame, returns: DataFrame, n: int = 21, keys: Sequence[str] = ("date",), calendar: DataFrame | None = None) -> DataFrame:
    """Portfolio return over the first n dates of the whole panel after each date, names held from the start; no return is 0.

    Returns are compounded per date and security before they meet the weights, so no weight is repeated per day.
    ``calendar`` has the panel's dates, where they are known; ``weights`` is read twice.
    """
    calendar = returns if calendar is None else calendar
    days = calendar.select(F.col("date").alias("day")).distinct().withColumn("k", F.row_number().over(Window.orderBy("day")))  # one row a day
    starts = weights.select("date").distinct()
    first = starts.join(F.broadcast(days), F.col("day") > F.col("date")).groupBy("date").agg(F.min("k").alias("k0"))
    window = first.join(F.broadcast(days), (F.col("k") >= F.col("k0")) & (F.col("k") < F.col("k0") + n)).select("date", "day")
    r = returns.select("permno", F.col("date").alias("day"), "ret").join(F.broadcast(window), "day")
    grown = r.groupBy("date", "permno").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("hold"))
    held = weights.join(F.broadcast(first.select("date")), "date", "left_semi").join(grown, ["date", "permno"], "left")
    return held.groupBy(*keys).agg(F.sum(F.col("weight") * F.coalesce("hold", F.lit(0.0))).alias("realized_return"), F.count(F.lit(1)).alias("n_names"))


def exposures(weights: DataFrame, keys: Sequence[str] = ("date",), tolerance: float = 1e-8) -> DataFrame:
    w = F.col("weight")
    return weights.groupBy(*keys).agg(
        F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.count_if(w > tolerance).alias("n_long"), F.count_if(w < -tolerance).alias("n_short"),
        F.sum(w * F.col("beta")).alias("portfolio_beta"), F.sum(w * F.col("alpha")).alias("expected_alpha"),
    )


def zero_volume_share(prices: DataFrame, dates: DataFrame, n: int = 60, calendar: DataFrame | None = None) -> DataFrame:
    """date, permno, zero_share, longest_run over the last n rows: rows without volume, and the longest run of unmoved returns.

    Shares and runs are taken in a frame of each security's rows, of which only the last one before a date is kept; the
    as-of join then sees one row a date at most. ``calendar`` has the days of the prices, where they are known.
    """
    idle = F.when(F.coalesce("vol", F.lit(0.0)) == 0, 1.0).otherwise(0.0)
    flat = F.when(F.coalesce("ret", F.lit(0.0)) == 0, 1).otherwise(0)
    run = F.aggregate(F.col("flats"), F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")), lambda a, f: F.struct(F.when(f == 1, a["now"] + 1).otherwise(0).alias("now"), F.greatest(a["top"], F.when(f == 1, a["now"] + 1).otherwise(0)).alias("top")))
    frame, line = trailing(n), Window.partitionBy("permno").orderBy("date")
    own = last_before(prices.select("permno", "date", idle.alias("idle"), flat.alias("flat")), dates, lambda rows: rows.withColumns({
        "zero_share": F.avg("idle").over(frame), "flats": F.collect_list("flat").over(frame), "n_rows": F.least(F.row_number().over(line), F.lit(n)).cast("long"),
    }), calendar=calendar)
    own = own.select("permno", "date", "zero_share", run["top"].alias("longest_run"), "n_rows")
    grid = prices.select("permno").distinct().crossJoin(F.broadcast(dates.select(F.col("date").alias("as_of"))))
    got = asof_by_key(grid, own, ["permno"], "as_of", "date", ["zero_share", "longest_run", "n_rows"])
    return got.filter("matched_time is not null").select(F.col("as_of").alias("date"), "permno", "zero_share", "longest_run", "n_rows")
