"""op7_source_mix and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.mixing import mixed_amounts
from weftline.session import table


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed_amounts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        F.col("mix_id").alias("doc_id"),
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


SQL = {
    "op7_source_mix": r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
         md5(doc_id::varchar || '|mix') k
  from documents
), s as (
  select source, sum(size)::bigint source_size, row_number() over (order by source is null, source) - 1 no
  from d group by source
), w as (
  select *, case no % 3 when 0 then 3 when 1 then 1 else 2 end weight, 2.0::double * source_size cap from s
), r as (
  select *, cap / weight ratio, 1.5::double * (sum(source_size) over ())::bigint budget from w
), l as (
  select *, (budget - coalesce(sum(cap) over (order by ratio, no rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over (order by ratio, no rows between current row and unbounded following))::bigint lev,
         row_number() over (order by ratio, no) rk
  from r
), v as (
  select min(rk) rk from l where cap >= lev * weight
), t as (
  select l.source, l.no, l.source_size, least(l.cap, coalesce((select lev from l m where m.rk = (select rk from v)) * l.weight, l.cap)) target from l
), q as (
  select row_number() over (order by d.doc_id) r, d.doc_id, d.size, t.source_size, t.target, t.no,
         coalesce(sum(d.size) over (partition by d.source order by k, d.size, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint b
  from d join t on d.source is not distinct from t.source
), c as (
  select r, no, target, b + source_size * copy b, size, unnest(generate_series(0, size - 1, 128))::bigint f
  from q, (values (0), (1)) copies(copy) where size > 0
), p as (
  select r, no, least(128, size - f) words, b + f + least(128, size - f) e, (b + f + least(128, size - f)) / target finish from c
), o as (
  select r, words, coalesce(sum(words) over (order by finish, no, e rows between unbounded preceding and 1 preceding), 0)::bigint before from p
), g as (
  select r, sum(greatest(0, least(words, (select floor(max(budget) + 1e-6) from r) - before)))::bigint taken from o group by r
)
select doc_id, size, source_size, target, coalesce(g.taken, 0)::bigint taken from q left join g using (r)
""",
}

QUERIES = {"op7_source_mix": op7_source_mix}
