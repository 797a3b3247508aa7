"""Query of exact dedup and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import decide


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decide(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

SQL = {
    "op6_exact_dedup": r"""
with t as (
  select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by h order by n desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
       count(*) over (partition by h) as group_size,
       row_number() over (partition by h order by n desc, doc_id) = 1 as kept,
       h as text_sha256
from t""",
}
