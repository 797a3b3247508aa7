"""Query of the quality rules. The robust estimate has no SQL; tests compare the counts with brute force and the verdicts with planted cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .quality import judge


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL: dict[str, str] = {}
