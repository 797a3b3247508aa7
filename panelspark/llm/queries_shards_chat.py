"""Queries of sharding and chat formatting, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, sharding

#: Bytes of text that a shard may hold.
SHARD_BYTES = 1 << 20


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), SHARD_BYTES)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES = {"op4_sharding": op4_sharding, "op5_chat_format": op5_chat_format}

SQL = {
    "op4_sharding": f"""
with h as (
  select doc_id, coalesce(strlen(text), 0) as bytes,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))), 1, 8))::bigint as hash
  from documents
), l as (
  select depth, hash >> (32 - depth) as prefix, sum(bytes) as shard_bytes, count(*) as shard_rows
  from h, (select unnest(generate_series(0, 32)) as depth) group by 1, 2
), m as (
  select h.*, l.depth, l.prefix, l.shard_bytes, l.shard_rows,
         row_number() over (partition by doc_id, hash order by l.depth) as rn
  from h join l on h.hash >> (32 - l.depth) = l.prefix
  where l.shard_bytes <= {SHARD_BYTES} or l.depth = 32
)
select doc_id, cast(bytes as bigint) as bytes, case when depth = 0 then '' else right(lpad(bin(prefix), 32, '0'), cast(depth as int)) end as shard, cast(depth as int) as depth,
       cast(shard_bytes as bigint) as shard_bytes, shard_rows, shard_bytes > {SHARD_BYTES} as oversized
from m where rn = 1""",
    "op5_chat_format": r"""
with d as (select distinct conv_id, turn, role, text from conversations),
t as (select *, case when conv_id is null then row_number() over (order by turn, role, text) else 0 end as alone from d),
p as (
  select conv_id, alone, row_number() over w as k, count(*) over (partition by conv_id, alone) as n,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10), '') over (w rows between unbounded preceding and current row) as chat
  from t window w as (partition by conv_id, alone order by turn nulls first, role, text)
), w as (
  select min(conv_id) as conv_id, n as n_turns, count(*) as n_copies, chat from p where k = n group by n, chat
)
select conv_id, n_turns, n_copies, chat from w where not exists (select 1 from p where p.chat = w.chat and p.k < p.n)""",
}
