"""Query of source mixing and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .mixing import mix

SEED = 7


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, seed=SEED).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mixing": op7_mixing}

SQL = {
    "op7_mixing": rf"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('{SEED}:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size from sized group by source
), w as (
  select *, cast(case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight,
         source_size * 2.0::double as cap
  from s
), l as (
  select *, cap / weight as level, (select cast(sum(source_size) as double) from s) * 1.5::double as budget from w
), r as (
  select *, (budget - coalesce(sum(cap) over (order by level, source nulls last rows between unbounded preceding and 1 preceding), 0::double))
         / sum(weight) over (order by level, source nulls last rows between current row and unbounded following) as reach
  from l
), g as (
  select r.source, source_size,
         case when water is null or level < water then cap else water * weight end as target
  from r, (select arg_min(reach, level) filter (where level >= reach) as water from r)
), p as (
  select d.doc_id, d.size, g.source_size, g.target, cast(floor(g.target) as bigint) as budget,
         coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from sized d join g on d.source is not distinct from g.source
), e as (
  select *, case when source_size > 0 then budget // source_size else 0 end as epochs from p
)
select doc_id, size, source_size, target,
       cast(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) as bigint) as taken
from e""",
}
