"""Panels derived from the test tables, each as a DataFrame and as the SQL that DuckDB repeats.

Suppliers stand for securities and line items for their trades. Values are rounded here, so that both engines start from
the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..schemas import ratio


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns_daily(spark: SparkSession, d: str) -> DataFrame:
    """A security trades about once a day, so trades are dealt by security before they are added up: what follows per
    security needs no shuffle of its own. The number of partitions is given, as few large ones would need much memory."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = table(spark, d, "lineitem").withColumns({"permno": F.col("l_suppkey"), "date": F.col("l_shipdate").cast("date")}).repartition(parts, "permno")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return t.groupBy("permno", "date").agg(
        F.round(F.avg("l_discount") - 0.05, 8).alias("ret"), F.round(F.sum("l_quantity"), 2).alias("vol"), F.round(F.avg(unit), 10).alias("prc"),
        F.round(F.max(unit), 10).alias("high"), F.round(F.min(unit), 10).alias("low"), F.round(F.sum("l_extendedprice"), 2).alias("marketcap"),
    )


def trading_days(spark: SparkSession, d: str) -> DataFrame:
    """date: the days of ``returns_daily``."""
    return table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()


def returns_monthly(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), "MM")
    return t.groupBy(F.col("l_suppkey").alias("permno"), F.last_day(month).alias("date")).agg(
        F.round(F.avg("l_discount") - 0.05, 8).alias("ret"), F.round(F.sum("l_extendedprice"), 2).alias("marketcap")
    )


def factors_daily(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    x = F.col("l_discount")

    def gap(cond) -> object:
        return F.round(F.coalesce(F.avg(F.when(cond, x)) - F.avg(F.when(~cond, x)), F.lit(0.0)), 8)

    return t.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(
        F.round(F.avg(x) - 0.05, 8).alias("mktrf"), gap(F.col("l_quantity") < 25).alias("smb"), gap(F.col("l_tax") < 0.04).alias("hml"), F.round(F.avg("l_tax") / 252, 8).alias("rf")
    )


def factors_monthly(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem")
    x = F.col("l_discount")

    def gap(cond) -> object:
        return F.round(F.coalesce(F.avg(F.when(cond, x)) - F.avg(F.when(~cond, x)), F.lit(0.0)), 8)

    return t.groupBy(F.last_day(F.col("l_shipdate").cast("date")).alias("date")).agg(
        F.round(F.avg(x) - 0.05, 8).alias("mkt_rf"), gap(F.col("l_quantity") < 25).alias("smb"), gap(F.col("l_tax") < 0.04).alias("hml"),
        gap(F.col("l_linestatus") == "O").alias("rmw"), gap(F.col("l_returnflag") == "A").alias("cma"), gap(F.col("l_linenumber") < 3).alias("mom"),
    )


def fundamentals(spark: SparkSession, d: str) -> DataFrame:
    ep, day = F.col("l_extendedprice"), F.col("l_shipdate").cast("date")
    q = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("permno"), F.trunc(day, "quarter").alias("q")).agg(
        F.round(F.sum(ep * (1 - F.col("l_discount"))), 5).alias("revtq"), F.round(0.6 * F.sum(ep), 5).alias("cogsq"), F.round(F.sum(ep) + 1, 2).alias("atq")
    )
    q = q.withColumn("datadate", F.last_day(F.add_months("q", 2)))
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    s = s.select(F.col("s_suppkey").alias("permno"), F.col("n_regionkey").cast("string").alias("gsector"), F.col("n_nationkey").cast("string").alias("ggroup"))
    return q.join(s, "permno").select(
        "permno", F.format_string("G%06d", "permno").alias("gvkey"), F.date_add("datadate", 45).alias("rdq"), "datadate", F.year("q").alias("fyearq"), F.quarter("q").alias("fqtr"),
        F.round((F.col("revtq") - F.col("cogsq")) / 1e6, 12).alias("epspxq"), F.lit(1.0).alias("ajexq"), "revtq", "cogsq", "atq", "gsector", "ggroup",
    )


def names(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    half = F.explode(F.array(
        F.struct(F.lit(1).alias("half"), F.to_date(F.lit("1995-01-01")).alias("namedt"), F.to_date(F.lit("1998-03-31")).alias("nameenddt")),
        F.struct(F.lit(2).alias("half"), F.to_date(F.lit("1998-04-01")).alias("namedt"), F.to_date(F.lit("2001-12-31")).alias("nameenddt")),
    )).alias("h")
    return s.select("*", half).select(
        F.col("s_suppkey").alias("permno"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"),
        F.concat(F.lpad(F.col("s_suppkey").cast("string"), 8, "0"), F.col("h.half").cast("string")).alias("ncusip"), (10 + F.col("s_suppkey") % 3).cast("int").alias("shrcd"),
        (F.col("s_nationkey") % 3 + 1).cast("int").alias("exchcd"), (100 + F.col("s_suppkey") * 37 % 9000).cast("int").alias("siccd"), F.col("h.namedt").alias("namedt"), F.col("h.nameenddt").alias("nameenddt"),
    )


def month_ends(spark: SparkSession, d: str) -> DataFrame:
    """Last business day of every month that the price panel covers."""
    span = table(spark, d, "lineitem").agg(F.min("l_shipdate").cast("date").alias("start"), F.max("l_shipdate").cast("date").alias("end"))
    return cal.rebalance_dates(span)


def universe(spark: SparkSession, d: str) -> DataFrame:
    """date, permno: the four fifths of the securities with the largest sums of trades in the month."""
    m = returns_monthly(spark, d).select(F.trunc("date", "MM").alias("m"), "permno", "marketcap")
    c = month_ends(spark, d).select("date", F.trunc("date", "MM").alias("m"))
    from pyspark.sql import Window

    w = Window.partitionBy("date")
    ranked = c.join(m, "m").withColumn("rn", F.row_number().over(w.orderBy(F.desc("marketcap"), "permno"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.filter(F.col("rn") * 5 <= F.col("n") * 4).select("date", "permno")


def raw_signal(spark: SparkSession, d: str) -> DataFrame:
    """permno, date_filed, raw_signal: gross profit over assets, visible on the announcement date."""
    f = fundamentals(spark, d)
    return f.select("permno", F.col("rdq").alias("date_filed"), F.round(ratio(F.col("revtq") - F.col("cogsq"), F.col("atq")), 13).alias("raw_signal"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    docs = table(spark, d, "documents")
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    s = docs.select(F.regexp_extract("source", "([0-9]+)", 1).cast("long").alias("permno"), n.alias("seq"), "doc_id", "text", "n_chars")
    year = 2000 + F.floor(F.col("seq") / 3)
    section = F.element_at(F.array(F.lit("Item 1"), F.lit("Item 1A"), F.lit("Item 7")), (F.col("seq") % 3 + 1).cast("int"))
    return s.select(
        "permno", F.concat(F.lit("T"), F.col("permno").cast("string")).alias("ticker"), F.make_date(year.cast("int"), F.lit(3), F.lit(1)).alias("filing_date"),
        F.format_string("%03d-%05d", F.col("permno"), year.cast("int")).alias("accession_no"), section.alias("section_id"), "text", (F.col("n_chars") < 300).alias("is_cross_reference"), "doc_id",
    )


#: The same panels for DuckDB, by name; each may use those before it.
SQL = {
    "returns_daily": """select l_suppkey as permno, cast(l_shipdate as date) as date, round(avg(l_discount) - 0.05, 8) as ret, round(sum(l_quantity), 2) as vol,
       round(avg(l_extendedprice / l_quantity), 10) as prc, round(max(l_extendedprice / l_quantity), 10) as high, round(min(l_extendedprice / l_quantity), 10) as low,
       round(sum(l_extendedprice), 2) as marketcap from lineitem group by 1, 2""",
    "returns_monthly": """select l_suppkey as permno, last_day(cast(l_shipdate as date)) as date, round(avg(l_discount) - 0.05, 8) as ret, round(sum(l_extendedprice), 2) as marketcap
       from lineitem group by 1, 2""",
    "factors_daily": """select cast(l_shipdate as date) as date, round(avg(l_discount) - 0.05, 8) as mktrf,
       round(coalesce(avg(l_discount) filter (where l_quantity < 25) - avg(l_discount) filter (where not l_quantity < 25), 0), 8) as smb,
       round(coalesce(avg(l_discount) filter (where l_tax < 0.04) - avg(l_discount) filter (where not l_tax < 0.04), 0), 8) as hml, round(avg(l_tax) / 252, 8) as rf from lineitem group by 1""",
    "factors_monthly": "select last_day(cast(l_shipdate as date)) as date, round(avg(l_discount) - 0.05, 8) as mkt_rf, "
    + ", ".join(
        f"round(coalesce(avg(l_discount) filter (where {c}) - avg(l_discount) filter (where not {c}), 0), 8) as {n}"
        for n, c in (("smb", "l_quantity < 25"), ("hml", "l_tax < 0.04"), ("rmw", "l_linestatus = 'O'"), ("cma", "l_returnflag = 'A'"), ("mom", "l_linenumber < 3"))
    )
    + " from lineitem group by 1",
    "fundamentals": """select q.permno, 'G' || lpad(cast(q.permno as varchar), 6, '0') as gvkey, cast(datadate + 45 as date) as rdq, datadate, cast(year(q) as int) as fyearq, cast(quarter(q) as int) as fqtr,
       round((revtq - cogsq) / 1e6, 12) as epspxq, 1.0::double as ajexq, revtq, cogsq, atq, cast(n_regionkey as varchar) as gsector, cast(n_nationkey as varchar) as ggroup
       from (select *, last_day(cast(q + interval 2 month as date)) as datadate from (
         select l_suppkey as permno, date_trunc('quarter', cast(l_shipdate as date)) as q, round(sum(l_extendedprice * (1 - l_discount)), 5) as revtq,
                round(0.6::double * sum(l_extendedprice), 5) as cogsq, round(sum(l_extendedprice) + 1, 2) as atq from lineitem group by 1, 2)) q
       join supplier on s_suppkey = q.permno join nation on s_nationkey = n_nationkey""",
    "names": """select s_suppkey as permno, 'T' || s_suppkey as ticker, lpad(cast(s_suppkey as varchar), 8, '0') || half as ncusip, cast(10 + s_suppkey % 3 as int) as shrcd,
       cast(s_nationkey % 3 + 1 as int) as exchcd, cast(100 + s_suppkey * 37 % 9000 as int) as siccd, namedt, nameenddt
       from supplier, (values (1, date '1995-01-01', date '1998-03-31'), (2, date '1998-04-01', date '2001-12-31')) h(half, namedt, nameenddt)""",
    "month_ends": """select cast(m - cast(greatest(0, isodow(m) - 5) as int) as date) as date from (
       select last_day(cast(unnest(generate_series(date_trunc('month', min(l_shipdate)), max(l_shipdate), interval 1 month)) as date)) as m from lineitem)""",
    "universe": """select date, permno from (
       select c.date, m.permno, row_number() over (partition by c.date order by m.marketcap desc, m.permno) as rn, count(*) over (partition by c.date) as n
       from month_ends c join returns_monthly m on date_trunc('month', c.date) = date_trunc('month', m.date)) where rn * 5 <= n * 4""",
    "raw_signal": "select permno, rdq as date_filed, round((revtq - cogsq) / nullif(atq, 0), 13) as raw_signal from fundamentals",
    "sections": r"""select permno, 'T' || permno as ticker, make_date(2000 + seq // 3, 3, 1) as filing_date, lpad(cast(permno as varchar), 3, '0') || '-' || lpad(cast(2000 + seq // 3 as varchar), 5, '0') as accession_no,
       case seq % 3 when 0 then 'Item 1' when 1 then 'Item 1A' else 'Item 7' end as section_id, text, n_chars < 300 as is_cross_reference, doc_id
       from (select cast(regexp_extract(source, '([0-9]+)', 1) as bigint) as permno, row_number() over (partition by source order by doc_id) - 1 as seq, doc_id, text, n_chars from documents)""",
}
NEEDS = {"month_ends": [], "universe": ["month_ends", "returns_monthly"], "raw_signal": ["fundamentals"]}


def sql(body: str, *panels: str) -> str:
    """``body`` after the WITH entries of the named panels and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for p in panels:
        add(p)
    head = ",\n".join(f"{p} as ({SQL[p]})" for p in order)
    body = body.strip()
    if not head:
        return body
    word = "with recursive" if "dyk as (" in body else "with"
    return f"{word} {head},\n{body[5:]}" if body.lower().startswith("with ") else f"{word} {head}\n{body}"
