"""Pieces that several operators share: the common folder, written tables, the character classes."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every executor sees.

    Where the session names none and runs in one process, a local temporary folder becomes the setting; on a cluster
    that is an error, as every machine would see its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="panelspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and each row is computed once."""
    path = shared_dir(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text, an array without empty strings; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a URI names, and the path within it."""
    return fs.FileSystem.from_uri(path)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row in one struct, so that no name of theirs meets one of an operator's own."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])
