"""Query of phrase collocations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .phrases import LEAST, LONGEST, TOP, collocations


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


QUERIES = {"op12_collocations": op12_collocations}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = {
    "op12_collocations": rf"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces
), totals as (
  select lang, sum(len(w)) as n from w group by lang
), grams as (
  select lang, k as len, array_to_string(w[i : i + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, (select unnest(generate_series(1, {LONGEST})) as k) where len(w) >= k)
), f as (
  select lang, len, phrase, count(*) as f from grams group by all having count(*) >= {LEAST}
), cuts as (
  select c.lang, c.phrase, c.len, c.f as a, k, array_to_string(string_split(c.phrase, ' ')[1 : k], ' ') as head, array_to_string(string_split(c.phrase, ' ')[k + 1 : c.len], ' ') as tail
  from f c, (select unnest(generate_series(1, {LONGEST} - 1)) as k) where c.len > k
), scored as (
  select c.lang, c.phrase, c.a, k, h.f as l, t.f as r, n, (1000::hugeint * c.a::hugeint * n::hugeint) // (h.f::hugeint * t.f::hugeint) as score
  from cuts c join f h on h.lang = c.lang and h.phrase = c.head join f t on t.lang = c.lang and t.phrase = c.tail join totals on totals.lang = c.lang
), weakest as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inner_of as (
  select distinct s.lang, array_to_string(string_split(g.phrase, ' ')[i : i + j - 1], ' ') as phrase, g.f
  from f g, (select unnest(generate_series(2, {LONGEST} - 1)) as j), (select unnest(generate_series(1, {LONGEST} - 1)) as i), (select distinct lang from f) s
  where s.lang = g.lang and j < g.len and i + j - 1 <= g.len
), kept as (
  select * from weakest c where not exists (select 1 from inner_of x where x.lang = c.lang and x.phrase = c.phrase and 100 * x.f >= 100 * c.a)
)
select lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= {TOP}""",
}
