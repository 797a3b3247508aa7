"""Query of ZIP-packaged WARC archives and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import warc


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return warc.read(warc.write(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op11_warc": op11_warc}

SQL = {
    # five hex digits are four characters of base32
    "op11_warc": """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), d as (
  select page_id, payload_bytes,
         list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(5 * (k // 4) + 1 as integer), 5) as bigint) >> (15 - 5 * (k % 4))) & 31 as integer) + 1, 1)), 'string_agg', '') as payload_digest
  from p
), m as (
  select *, max(page_id) over (partition by payload_digest) as last_id from d
)
select page_id, payload_bytes, payload_digest, case when page_id = last_id then 'response' else 'revisit' end as record_type, case when page_id <> last_id then last_id end as refers_to
from m""",
}
