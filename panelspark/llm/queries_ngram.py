"""Query of the n-gram Jaccard join. Components have no plain SQL; the test compares with all pairs of a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ngram_join import join


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
SQL: dict[str, str] = {}
