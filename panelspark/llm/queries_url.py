"""Query of the URL filter and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .url_filter import BEGIN, END, LOWER, ORDER, RULES, UNIFORM, UPPER, classify


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op2_url_filter": op2_url_filter}


def _fits(r) -> str:
    return f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"


def _sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r.name))
    rule = " ".join(f"when {_fits(r)} then '{r.name}'" for r in longest)
    verdict = " ".join(f"when {_fits(r)} then '{r.verdict}'" for r in longest)
    begin, end = f"repeat(chr({ord(BEGIN)}), {ORDER - 1})", f"chr({ord(END)})"
    orders = []
    for k in range(1, ORDER + 1):
        shorter = f"(select gram as short, p_allow as s_allow, p_block as s_block from p{k - 1})" if k > 1 else f"(select '' as short, {UNIFORM} as s_allow, {UNIFORM} as s_block)"
        key = f"right(o.gram, {k - 1})" if k > 1 else "''"
        orders.append(f"""
o{k} as (select right(gram, {k}) as gram, sum(n_allow) as n_allow, sum(n_block) as n_block from counts group by 1),
c{k} as (select left(gram, {k - 1}) as context, sum(n_allow) as all_allow, sum(n_block) as all_block,
                count(*) filter (where n_allow > 0) as kinds_allow, count(*) filter (where n_block > 0) as kinds_block from o{k} group by 1),
p{k} as (select o.gram,
                case when all_allow > 0 then (n_allow + kinds_allow * s_allow::double) / (all_allow + kinds_allow) else s_allow::double end as p_allow,
                case when all_block > 0 then (n_block + kinds_block * s_block::double) / (all_block + kinds_block) else s_block::double end as p_block
         from o{k} o join c{k} c on left(o.gram, {k - 1}) = c.context join {shorter} s on {key} = s.short)""")
    return rf"""
with t as (
  select page_id, coalesce(url, '') as text, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as after from pages
), h as (
  select page_id, text, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(after, '^[^/?#]*([^?#]*)', 1) as path from t
), j as (
  select *, case {rule} end as rule, case {verdict} end as verdict from h
), u as (
  select text, count(*) filter (where verdict = 'allow') as allow, count(*) filter (where verdict = 'block') as block from j group by 1
), a as (
  select text, allow, block, substr({begin} || text || {end}, i, {ORDER}) as gram
  from (select *, unnest(generate_series(1, length(text) + 1)) as i from u)
), counts as (
  select gram, sum(allow) as n_allow, sum(block) as n_block from a group by 1
),{",".join(orders)},
s as (
  select text, any_value(allow) as allow, any_value(block) as block, avg(ln(p_allow) - ln(p_block)) as score from a join p{ORDER} using (gram) group by text
), m as (
  select sum(score * allow) / sum(allow) as m_a, sum(score * block) / sum(block) as m_b,
         sum(score * score * allow) / sum(allow) as q_a, sum(score * score * block) / sum(block) as q_b from s
), d as (
  select *, sqrt(greatest(q_a - m_a * m_a, 1e-12)) as d_a, sqrt(greatest(q_b - m_b * m_b, 1e-12)) as d_b from m
), l as (
  select (m_a * d_b + m_b * d_a) / (d_a + d_b) as threshold from d
)
select j.page_id, host, path, rule, coalesce(verdict, case when score < threshold then 'block' else 'allow' end) as verdict
from j join s on s.text = j.text, l"""


SQL = {"op2_url_filter": _sql()}
