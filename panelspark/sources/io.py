"""Sources and sinks: Parquet, partitioned Parquet, CSV, factor files, dated files, filings JSON, JDBC."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import require_columns

CODECS = ("snappy", "gzip", "brotli", "lz4", "zstd")


def load_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return require_columns(df, *columns).select(*columns) if columns else df


def save_parquet(df: DataFrame, path: str, compression: str = "snappy", mode: str = "overwrite") -> str:
    if compression not in CODECS:
        raise ValueError(f"unknown codec {compression}")
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def save_partitioned(df: DataFrame, root: str, column: str) -> str:
    """One folder ``column=value`` per value; only folders of values that occur are replaced, so reruns resume."""
    require_columns(df, column)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(root)
    return root


def load_partitioned(spark: SparkSession, root: str, columns: Sequence[str] | None = None) -> DataFrame:
    return load_parquet(spark, root, columns)


def finished(spark: SparkSession, root: str, field: T.StructField) -> DataFrame:
    """The keys that runs of ``resumable`` below ``root`` have finished."""
    schema = T.StructType([field])
    manifest = f"{root.rstrip('/')}/finished"
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{manifest}/begin")  # so that there is a folder to read
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(manifest).distinct()


def resumable(keys: DataFrame, compute: Callable[[DataFrame], DataFrame], root: str, column: str = "rebalance_date", batch: int = 12) -> DataFrame:
    """The rows that ``compute`` gives for all keys, kept below ``root`` so that a run that breaks off is taken up again.

    ``compute`` gets open keys, ``batch`` at a time in ascending order, and returns their rows. They are written to one
    folder per key, which replaces what a broken run may have left there; only then are the keys entered in the manifest
    of finished ones, in a file of their own. A rerun computes the keys that the manifest lacks and no other, and rows of
    a key that is not in it are never read. Keys are those of a calendar, a few for each month, and not null.
    """
    spark, root = keys.sparkSession, root.rstrip("/")
    field = T.StructField(column, require_columns(keys, column).schema[column].dataType)
    done = finished(spark, root, field)
    todo = sorted(r[0] for r in keys.select(column).distinct().join(done, column, "left_anti").collect())
    nothing = spark.createDataFrame([], T.StructType([field]))
    schema = require_columns(compute(nothing), column).schema
    spark.createDataFrame([], schema).write.mode("append").partitionBy(column).parquet(f"{root}/rows")
    for i in range(0, len(todo), batch):
        some = spark.createDataFrame([(k,) for k in todo[i : i + batch]], T.StructType([field]))
        save_partitioned(compute(some), f"{root}/rows", column)
        some.coalesce(1).write.mode("overwrite").parquet(f"{root}/finished/from-{todo[i]}")
    return spark.read.schema(schema).parquet(f"{root}/rows").join(F.broadcast(finished(spark, root, field)), column, "left_semi")


def read_warehouse(df: DataFrame, ids: DataFrame, start: str, end: str, key: str = "permno", date: str = "date") -> DataFrame:
    """Rows of the ids within an inclusive date window, decimals as doubles; pushes the window to the scan."""
    rows = df.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).join(ids.select(key).distinct(), key, "left_semi")
    return rows.withColumns({f.name: F.col(f.name).cast("double") for f in rows.schema.fields if f.dataType.typeName() == "decimal"})


#: Ids that are written into the query of each partition; longer lists are joined after reading.
PUSHED_IDS = 1000


def read_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str], ids: DataFrame, start: str, end: str, key: str = "permno", date: str = "date", parts: int = 8, **options: str) -> DataFrame:
    """``read_warehouse`` of a database table: one query per slice of the date window, with the columns, the slice and the ids in it.

    Slices are half-open but for the last, so each row is read once. The list of ids goes into the queries as long as it
    has ``PUSHED_IDS`` entries at most; beyond that its least and greatest entry do, and the list is joined.
    """
    known = sorted(r[0] for r in ids.select(key).distinct().limit(PUSHED_IDS + 1).collect() if r[0] is not None)
    if len(known) <= PUSHED_IDS:
        wanted = f'"{key}" IN ({", ".join(map(_literal, known))})' if known else "1 = 0"
    else:
        least, most = ids.agg(F.min(key), F.max(key)).first()
        wanted = f'"{key}" BETWEEN {_literal(least)} AND {_literal(most)}'
    first, last = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    days = (last - first).days
    edges = [first + dt.timedelta(days * i // parts) for i in range(parts)] if days >= parts else [first]
    tests = [f"\"{date}\" >= {{d '{x}'}} AND \"{date}\" < {{d '{y}'}}" for x, y in zip(edges, edges[1:], strict=False)] + [f"\"{date}\" >= {{d '{edges[-1]}'}} AND \"{date}\" <= {{d '{last}'}}"]
    rows = spark.read.jdbc(url, table, predicates=[f"{t} AND {wanted}" for t in tests], properties=dict(options)).select(*columns)
    return read_warehouse(rows, ids, start, end, key, date)


def _literal(value: object) -> str:
    return str(value) if isinstance(value, int) else "'" + str(value).replace("'", "''") + "'"


def load_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def save_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True)
    return path


def parse_factor_lines(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """``value`` lines of a published factor file -> month-end date and factors: lines whose first field is YYYYMM."""
    f = F.split("value", "\\s*,\\s*")
    own = lines.filter(F.col("value").rlike("^\\s*\\d{6}\\s*,"))
    month = F.last_day(F.to_date(F.trim(f[0]), "yyyyMM")).alias("date")
    return own.select(month, *[F.expr(f"try_cast(trim(split(value, ',')[{i}]) as double)").alias(n) for i, n in enumerate(names, 1)])


def read_factors(spark: SparkSession, path: str, momentum: str | None = None, names: Sequence[str] = ("mkt_rf", "smb", "hml", "rmw", "cma", "rf")) -> DataFrame:
    base = parse_factor_lines(spark.read.text(path), names)
    return base.join(parse_factor_lines(spark.read.text(momentum), ["mom"]), "date", "left") if momentum else base


def read_dated(spark: SparkSession, root: str) -> DataFrame:
    """Parquet files below ``root`` whose name, or that of their folder, holds a date YYYY-MM-DD, with it as file_date."""
    day = F.regexp_extract(F.input_file_name(), ".*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    return spark.read.option("recursiveFileLookup", "true").parquet(root).withColumn("file_date", F.to_date(F.when(day != "", day)))


FILINGS = (
    "filings struct<recent: struct<form: array<string>, accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, primaryDocument: array<string>>,"
    " files: array<struct<name: string, filingTo: string>>>, cik string"
)


def filings(index: DataFrame, form: str = "10-K", earliest: str = "1900-01-01") -> DataFrame:
    """Parallel arrays of a filings index to rows: exactly the form, not before ``earliest``, one row per accession: its first filing date's, of equal ones the least document's."""
    r = "filings.recent"
    rows = index.select("cik", F.explode(F.arrays_zip(f"{r}.form", f"{r}.accessionNumber", f"{r}.filingDate", f"{r}.reportDate", f"{r}.primaryDocument")).alias("f"))
    rows = rows.select("cik", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession_number"), F.to_date("f.filingDate").alias("filing_date"), F.to_date("f.reportDate").alias("report_date"), F.col("f.primaryDocument").alias("primary_document"))
    rows = rows.filter((F.col("form") == form) & (F.col("filing_date") >= F.to_date(F.lit(earliest))))
    names = [c for c in rows.columns if c != "accession_number"]
    first = F.struct("filing_date", "primary_document", *[c for c in names if c not in ("filing_date", "primary_document")])
    return rows.groupBy("accession_number").agg(F.min(first).alias("f")).select("accession_number", *[f"f.{c}" for c in names])


def ticker_map(raw: DataFrame, column: str = "value") -> DataFrame:
    """A keyed JSON object of {ticker, cik_str} -> ticker (upper case), cik (10 digits)."""
    entries = raw.select(F.explode(F.from_json(column, "map<string, struct<ticker: string, cik_str: bigint>>")).alias("k", "v"))
    return entries.select(F.upper("v.ticker").alias("ticker"), F.lpad(F.col("v.cik_str").cast("string"), 10, "0").alias("cik")).distinct()


def resolve_tickers(tickers: DataFrame, known: DataFrame) -> DataFrame:
    """ticker, cik (NULL: not resolved)."""
    return tickers.select(F.upper("ticker").alias("ticker")).distinct().join(known, "ticker", "left")
