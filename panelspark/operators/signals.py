"""Signals from fundamentals, returns and text."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stop_words import ENGLISH
from ..functions.windows import trailing_sums
from ..schemas import mean_of, ratio, require_columns


def gross_profitability(fund: DataFrame) -> DataFrame:
    """permno, date_filed, raw_signal: (revenue - cost) / assets; NULL where assets are zero or a part is missing."""
    return require_columns(fund, "permno", "rdq", "revtq", "cogsq", "atq").select("permno", F.col("rdq").alias("date_filed"), ratio(F.col("revtq") - F.col("cogsq"), F.col("atq")).alias("raw_signal"))


def _pair(c: str, e: str) -> str:
    return f"s_{min(c, e)}_{max(c, e)}"


def rolling_ols3(df: DataFrame, y: str, x: Sequence[str], n: int, key: str = "permno", moments: bool = False) -> DataFrame:
    """Rolling regression of y on three columns and an intercept over the last n rows, in one pass over running sums.

    Values are taken from their key's mean, so that the sums of products hold few digits that cancel. The centred 3 x 3
    system is solved by its adjugate. Adds b1, b2, b3, residual_std (sqrt(SSR / (n - 1))) and n_obs; rows with fewer than
    n rows behind them are dropped. Rows with a missing value are to be dropped before. With ``moments`` the centred
    products stay, as s_<column>_<column> with the names in order.
    """
    cols = sorted([y, *x])
    own = df.withColumn("n_obs", F.row_number().over(Window.partitionBy(key).orderBy("date")))
    own = own.withColumns({f"d_{c}": F.col(c) - F.avg(c).over(Window.partitionBy(key)) for c in cols})
    pairs = [(c, e) for i, c in enumerate(cols) for e in cols[i:]]
    own = trailing_sums(own, {f"m_{c}": F.col(f"d_{c}") for c in cols} | {f"t_{c}_{e}": F.col(f"d_{c}") * F.col(f"d_{e}") for c, e in pairs}, n, key)
    own = own.filter(F.col("n_obs") >= n).withColumns({_pair(c, e): F.col(f"t_{c}_{e}") / n - F.col(f"m_{c}") * F.col(f"m_{e}") / (n * n) for c, e in pairs})

    def s(c: str, e: str) -> Column:
        return F.col(_pair(c, e))

    a, b, c = x
    own = own.withColumns({
        "c11": s(b, b) * s(c, c) - s(b, c) * s(b, c), "c12": s(a, c) * s(b, c) - s(a, b) * s(c, c), "c13": s(a, b) * s(b, c) - s(a, c) * s(b, b),
        "c22": s(a, a) * s(c, c) - s(a, c) * s(a, c), "c23": s(a, b) * s(a, c) - s(a, a) * s(b, c), "c33": s(a, a) * s(b, b) - s(a, b) * s(a, b),
    })
    det = s(a, a) * F.col("c11") + s(a, b) * F.col("c12") + s(a, c) * F.col("c13")
    own = own.withColumns({
        f"b{i}": ratio(F.col(p) * s(y, a) + F.col(q) * s(y, b) + F.col(r) * s(y, c), det) for i, (p, q, r) in enumerate((("c11", "c12", "c13"), ("c12", "c22", "c23"), ("c13", "c23", "c33")), 1)
    })
    ssr = F.greatest(s(y, y) - F.col("b1") * s(y, a) - F.col("b2") * s(y, b) - F.col("b3") * s(y, c), F.lit(0.0)) * n
    own = own.withColumn("residual_std", F.sqrt(ssr / (n - 1)))
    gone = [f"{p}_{q}" for p in "dm" for q in cols] + [f"t_{p}_{q}" for p, q in pairs] + ["c11", "c12", "c13", "c22", "c23", "c33"]
    return own.drop(*gone, *([] if moments else [_pair(p, q) for p, q in pairs]))


def rolling_durbin_watson(df: DataFrame, y: str, x: Sequence[str], n: int, key: str = "permno") -> DataFrame:
    """``rolling_ols3`` with dw, the Durbin-Watson statistic of the n residuals less their mean.

    Squared residuals and squared changes are quadratic forms of the coefficients in moments of the rows and of their
    changes, so no residual is made for a row and a window.
    """
    cols = [y, *x]
    w = Window.partitionBy(key).orderBy("date")
    own = df.withColumns({f"g_{c}": F.col(c) - F.lag(c).over(w) for c in cols})
    pairs = [(c, e) for i, c in enumerate(cols) for e in cols[i:]]
    own = trailing_sums(own, {f"q_{c}_{e}": F.col(f"g_{c}") * F.col(f"g_{e}") for c, e in pairs}, n - 1, key)
    own = rolling_ols3(own, y, x, n, key, moments=True)
    weight = dict(zip(cols, (F.lit(1.0), -F.col("b1"), -F.col("b2"), -F.col("b3")), strict=True))
    twice = {(c, e): (1.0 if c == e else 2.0) * weight[c] * weight[e] for c, e in pairs}
    changes = sum((v * F.col(f"q_{c}_{e}") for (c, e), v in twice.items()), F.lit(0.0))
    squares = sum((v * F.col(_pair(c, e)) * n for (c, e), v in twice.items()), F.lit(0.0))
    return own.withColumn("dw", ratio(changes, squares)).drop(*[f"g_{c}" for c in cols], *[f"q_{c}_{e}" for c, e in pairs], *[_pair(c, e) for c, e in pairs])


def idiosyncratic_volatility(returns: DataFrame, factors: DataFrame, n: int = 60) -> DataFrame:
    """permno, date_filed, b1, b2, b3, residual_std, raw_signal (annualised)."""
    own = returns.join(F.broadcast(factors), "date").withColumn("excess", F.col("ret") - F.col("rf")).filter(F.col("excess").isNotNull())
    got = rolling_ols3(own.select("permno", "date", "excess", "mktrf", "smb", "hml"), "excess", ["mktrf", "smb", "hml"], n)
    return got.select("permno", F.col("date").alias("date_filed"), "b1", "b2", "b3", "residual_std", (F.col("residual_std") * F.sqrt(F.lit(252.0))).alias("raw_signal"))


def monthly(returns: DataFrame) -> DataFrame:
    """permno, month, ret (compounded), marketcap (last known), last_date."""
    g = returns.groupBy("permno", F.trunc("date", "MM").alias("month"))
    return g.agg((F.product(1 + F.col("ret")) - 1).alias("ret"), F.max_by("marketcap", F.when(F.col("marketcap").isNotNull(), F.col("date"))).alias("marketcap"), F.max("date").alias("last_date"))


def cross_residual(rows: DataFrame, by: str = "month", group: str = "ggroup", least: int = 5) -> DataFrame:
    """Adds residual (and fitted): return less its regression on group dummies and log size, per month.

    Return and size are demeaned within groups; the slope on size comes from what is left. Months below ``least`` names
    are dropped; without variation in size the slope is 0.
    """
    own = rows.filter(F.col("ret").isNotNull() & (F.col("marketcap") > 0) & F.col(group).isNotNull()).withColumn("log_size", F.ln("marketcap"))
    cell, day = Window.partitionBy(by, group), Window.partitionBy(by)
    own = own.withColumns({"y_": F.col("ret") - F.avg("ret").over(cell), "s_": F.col("log_size") - F.avg("log_size").over(cell), "n_names": F.count(F.lit(1)).over(day), "n_cell": F.count(F.lit(1)).over(cell)})
    own = own.withColumns({"sxx": F.sum(F.col("s_") * F.col("s_")).over(day), "sxy": F.sum(F.col("y_") * F.col("s_")).over(day)})
    slope = F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    own = own.filter(F.col("n_names") >= least).withColumn("residual", F.col("y_") - slope * F.col("s_"))
    leverage = 1 / F.col("n_cell") + F.when(F.col("sxx") > 1e-12, F.col("s_") * F.col("s_") / F.col("sxx")).otherwise(0.0)
    return own.withColumns({"fitted": F.col("ret") - F.col("residual"), "leverage": leverage}).drop("y_", "s_", "sxx", "sxy")


def cross_residual_as_of(rows: DataFrame, members: DataFrame, span: int = 24, group: str = "ggroup", least: int = 5) -> DataFrame:
    """rebalance_date, month, permno, last_date, residual: ``cross_residual`` of each date's own universe, month by month.

    A date's regressions hold its members only and the months that ended by then, ``span`` of them at most, so a
    name's residual of a month depends on the date. Members meet their months by name, and the regressions come from
    moments per date, month and group, which are broadcast: a row of a name, date and month is never shuffled.
    """
    r = rows.filter(F.col("ret").isNotNull() & (F.col("marketcap") > 0) & F.col(group).isNotNull()).select("permno", "month", "last_date", "ret", group, F.ln("marketcap").alias("log_size"))
    near = F.col("month").between(F.add_months(F.trunc("date", "MM"), 1 - span), F.trunc("date", "MM")) & (F.col("last_date") <= F.col("date"))
    own = members.select("date", "permno").repartition("permno").distinct().join(r, "permno").filter(near)
    n = F.count(F.lit(1))
    cell = own.groupBy("date", "month", group).agg(n.alias("n"), F.avg("ret").alias("y_"), F.avg("log_size").alias("s_"), (F.var_pop("log_size") * n).alias("sxx"), (F.covar_pop("ret", "log_size") * n).alias("sxy"))
    day = cell.groupBy("date", "month").agg(F.sum("n").alias("n_names"), F.sum("sxx").alias("sxx"), F.sum("sxy").alias("sxy")).filter(F.col("n_names") >= least)
    slope = F.when(F.col("sxx") > 1e-12, F.col("sxy") / F.col("sxx")).otherwise(0.0)
    lines = cell.select("date", "month", group, "y_", "s_").join(day.select("date", "month", slope.alias("slope")), ["date", "month"])  # a few rows a date and month
    got = own.join(F.broadcast(lines), ["date", "month", group])
    return got.select(F.col("date").alias("rebalance_date"), "month", "permno", "last_date", (F.col("ret") - F.col("y_") - F.col("slope") * (F.col("log_size") - F.col("s_"))).alias("residual"))


def residual_momentum_as_of(resid: DataFrame, first: int = 12, last: int = 2, least: int = 9) -> DataFrame:
    """rebalance_date, permno, date_filed, raw_signal, n_obs: the sum of a name's residuals of its own months t-first..t-last.

    t is its latest month known on the date, whose last day is date_filed; ``first`` months have to lie behind it.
    """
    w = Window.partitionBy("rebalance_date", "permno")
    back = resid.withColumns({"back": F.row_number().over(w.orderBy(F.desc("month"))) - 1, "n": F.count(F.lit(1)).over(w)}).filter((F.col("n") > first) & (F.col("back") <= first))
    inside = F.col("back") >= last
    g = back.groupBy("rebalance_date", "permno").agg(F.max("last_date").alias("date_filed"), F.sum(F.when(inside, F.col("residual"))).alias("raw_signal"), F.count(F.when(inside, F.col("residual"))).alias("n_obs"))
    return g.filter(F.col("n_obs") >= least)


def residual_momentum(resid: DataFrame, first: int = 12, last: int = 2) -> DataFrame:
    """Sum of residuals over each name's own months t-first..t-last; needs ``first`` months behind."""
    w = Window.partitionBy("permno").orderBy("month")
    total = F.sum("residual").over(w.rowsBetween(-first, -last))
    return resid.select("permno", "month", total.alias("raw_signal"), F.row_number().over(w).alias("k")).filter(F.col("k") > first).drop("k")


def seasonal_eps(fund: DataFrame) -> DataFrame:
    """Adds eps_adj and surprise: its change against four rows earlier in fiscal order."""
    eps = F.when(F.col("ajexq") > 0, F.col("epspxq") / F.col("ajexq"))
    w = Window.partitionBy("permno").orderBy("fyearq", "fqtr")
    own = fund.withColumn("eps_adj", eps)
    return own.withColumn("surprise", F.col("eps_adj") - F.lag("eps_adj", 4).over(w))


def earnings_drift(fund: DataFrame, n: int = 8, clip: float = 3.0) -> DataFrame:
    """permno, date_filed, surprise, sue: surprise over its deviation in the last n rows (all needed), clipped."""
    w = Window.partitionBy("permno").orderBy("fyearq", "fqtr").rowsBetween(1 - n, 0)
    own = seasonal_eps(fund).withColumns({"sd": F.stddev_samp("surprise").over(w), "k": F.count("surprise").over(w)})
    sue = F.when((F.col("k") == n) & (F.col("sd") > 0), F.greatest(F.least(F.col("surprise") / F.col("sd"), F.lit(clip)), F.lit(-clip)))
    return own.select("permno", F.col("rdq").alias("date_filed"), "surprise", sue.alias("raw_signal"))


# text ---------------------------------------------------------------------------------------------------------------


def latest_filing(sections: DataFrame) -> DataFrame:
    """Rows of the latest accession of each firm and year, without cross-references."""
    own = sections.filter(~F.col("is_cross_reference")).withColumn("year", F.year("filing_date"))
    best = own.groupBy("permno", "year").agg(F.max_by("accession_no", F.struct("filing_date", "accession_no")).alias("accession_no"))
    return own.join(best, ["permno", "year", "accession_no"], "left_semi")


#: Terms in more than one of so many documents of a corpus are common: a document holds few of them, so there are at most
#: this many times as many as a document has terms on average, and they are broadcast.
COMMON = 1000


def dictionary(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], stop: Sequence[str] = ENGLISH, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """(section_id, doc_id, term, tf of every document; section_id, term, idf, common) with smooth idf, per section corpus.

    Term counts are read several times, so they are kept.

    Terms are runs of two or more ASCII letters between non-word characters, in lower case, without the stop words.
    """
    words = F.explode(F.split(F.lower("text"), "[^\\p{L}\\p{N}_]+")).alias("term")
    t = docs.select("doc_id", "section_id", words).filter(F.col("term").rlike("^[a-z]{2,}$"))
    t = t.filter(~F.col("term").isin(*stop)) if stop else t
    tf = keep(t.groupBy("section_id", "doc_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = tf.groupBy("section_id", "term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    n = docs.groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    return tf, df.join(F.broadcast(n), "section_id").select("section_id", "term", idf.alias("idf"), (F.col("df") * COMMON > F.col("n")).alias("common"))


def _raw_weights(tf: DataFrame, terms: DataFrame, parts: int | None = None) -> DataFrame:
    """tf with the columns of its term and w = tf * idf: common terms are broadcast, so no key of the shuffled join is hot.

    With ``parts`` the result is dealt by doc_id into so many partitions, as ``tf`` has to be: only rows of other terms move.
    """
    often, seldom = terms.filter("common").drop("common"), terms.filter(~F.col("common")).drop("common")
    key = ["section_id", "term"]
    hot = tf.join(F.broadcast(often), key)
    rest = tf.join(F.broadcast(often.select(*key)), key, "left_anti").join(seldom, key)
    return hot.unionByName(rest.repartition(parts, "doc_id") if parts else rest).withColumn("w", F.col("tf") * F.col("idf"))


def term_weights(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], stop: Sequence[str] = ENGLISH, min_df: int = 2) -> DataFrame:
    """doc_id, section_id, term, weight: tf-idf, each document of length 1. ``keep`` writes a table and reads it back."""
    w = Window.partitionBy("section_id", "doc_id")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tf, terms = dictionary(docs, keep, stop, min_df)
    own = _raw_weights(tf.repartition(parts, "doc_id"), terms, parts)
    return own.select("doc_id", "section_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(w))).alias("weight"))


def term_vectors(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], stop: Sequence[str] = ENGLISH, min_df: int = 2) -> DataFrame:
    """doc_id, section_id, ids, weights: one sparse vector per document, sorted by id and of length 1.

    Ids come from the dictionary of all sections, numbered where it is kept: ``keep`` writes a table and reads it back.
    """
    tf, terms = dictionary(docs, keep, stop, min_df)
    numbered = keep(terms.withColumn("id", F.monotonically_increasing_id()))
    each = _raw_weights(tf, numbered).groupBy("doc_id").agg(F.first("section_id").alias("section_id"), F.array_sort(F.collect_list(F.struct("id", "w"))).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return each.select("doc_id", "section_id", F.transform("v", lambda x: x["id"]).alias("ids"), F.transform("v", lambda x: x["w"] / F.col("norm")).alias("weights"))


@F.arrow_udf(T.DoubleType())
def sparse_dot(ids: pa.Array, weights: pa.Array, other_ids: pa.Array, other_weights: pa.Array) -> pa.Array:
    """Dot products of sparse vectors with ascending ids; NULL where a vector is."""
    out = []
    for a, x, b, y in zip(ids, weights, other_ids, other_weights, strict=True):
        if not (a.is_valid and b.is_valid):
            out.append(None)
            continue
        _, i, j = np.intersect1d(a.values.to_numpy(), b.values.to_numpy(), assume_unique=True, return_indices=True)
        out.append(float(x.values.to_numpy()[i] @ y.values.to_numpy()[j]))
    return pa.array(out, pa.float64())


def yearly_cosine(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """permno, section_id, year, similarity of each filing to the firm's filing one year before; 0 without a term in common.

    Pairs are found without vectors; then a vector moves once, to the filing that follows.
    """
    w = Window.partitionBy("permno", "section_id").orderBy("year")
    own = docs.select("permno", "section_id", "year", "doc_id", F.lag("doc_id").over(w).alias("prior"), F.lag("year").over(w).alias("p_year")).filter(F.col("year") == F.col("p_year") + 1)
    v = vectors.select("doc_id", "ids", "weights")
    before = own.select("prior", F.col("doc_id").alias("next")).join(v.withColumnRenamed("doc_id", "prior"), "prior")
    before = before.select(F.col("next").alias("doc_id"), F.col("ids").alias("p_ids"), F.col("weights").alias("p_weights"))
    both = own.join(v, "doc_id", "left").join(before, "doc_id", "left")
    return both.select("permno", "section_id", "year", F.coalesce(sparse_dot("ids", "weights", "p_ids", "p_weights"), F.lit(0.0)).alias("similarity"))


SECTIONS = {"Item 1": "sim_item1", "Item 1A": "sim_item1a", "Item 7": "sim_item7"}


def text_change(similarity: DataFrame) -> DataFrame:
    """permno, year, the sections' similarities, raw_signal = 1 - their mean."""
    g = similarity.groupBy("permno", "year").pivot("section_id", list(SECTIONS)).agg(F.first("similarity"))
    g = g.withColumnsRenamed(SECTIONS)
    return g.withColumn("raw_signal", 1 - mean_of(*[F.col(c) for c in SECTIONS.values()])).filter(F.col("raw_signal").isNotNull())


def html_sections(pages: DataFrame, heading: str = "h1", least: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(sections, failures) of HTML pages: the heading's text and the paragraphs' text, its length, and whether it is a mere reference."""
    title = F.regexp_extract("html", f"(?s)<{heading}>(.*?)</{heading}>", 1)
    body = F.array_join(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), "\n")
    own = pages.select("page_id", title.alias("section"), F.regexp_replace(body, "<[^>]*>", "").alias("body"))
    own = own.withColumn("length", F.char_length("body"))
    reason = F.when(F.col("section") == "", "no heading").when(F.col("length") == 0, "no text")
    own = own.withColumn("reason", reason)
    ok = own.filter("reason is null").select("page_id", "section", "length", (F.col("length") < least).alias("is_cross_reference"), "body")
    return ok, own.filter("reason is not null").select("page_id", "reason")
