"""op13_periodic_runs and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columns import crc32_sql
from weftline.llm.runs import periodic_runs
from weftline.session import table

#: Words of the contract.
WORD = r"[^\x20\x09-\x0D]+"


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in the texts of every tenth id, by its crc32, the words from one on repeat a passage."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.expr("h div 10")
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    d = d.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (g % F.col("n")).cast("int")))
    d = d.withColumn("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))
    rest = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("cast((n - a) div p + 1 as int)")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(rest, F.lit(1), F.col("n") - F.col("a")))
    return d.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(planted(table(spark, sf_dir, "documents")), ["doc_id"], "text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    out = out.withColumn("best", best)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


SQL = {
    "op13_periodic_runs": rf"""
with d as (
  select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w, {crc32_sql("doc_id::varchar")} h from documents
), e as (
  select *, len(w)::bigint n, h // 10 g from d
), f as (
  select *, case when n > 0 then g % n end a from e
), o as (
  select *, 1 + (n - a) // (3 + g % 8) p from f
), m as (
  select r, doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: case when i >= a then w[(a + (i - a) % p + 1)::int] else w[(i + 1)::int] end) else w end w from o
), t as (
  select r, n, unnest(w) x, unnest(range(0, n)) i from m
), pairs as (
  select a.r, a.i, b.i - a.i p from t a join t b on a.r = b.r and a.x = b.x and b.i > a.i and 4 * (b.i - a.i) <= a.n
), islands as (
  select r, p, i, i - row_number() over (partition by r, p order by i) k from pairs
), stretches as (
  select r, p, min(i) s, count(*) + p len from islands group by r, p, k having count(*) + p >= greatest(6, 4 * p)
), runs as (
  select r, s, len, min(p) p from stretches group by r, s, len
), told as (
  select r, count(*) n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' order by s, p) lines from runs group by r
), best as (
  select * from (select *, row_number() over (partition by r order by len desc, s, p) k from runs) where k = 1
), kept as (
  select r, string_agg(x, ' ' order by i) c from t where not exists (select 1 from runs u where u.r = t.r and t.i >= u.s + u.p and t.i < u.s + u.len) group by r
)
select doc_id, coalesce(n_runs, 0)::bigint n_runs, s::bigint as "start", len::bigint as length, p::bigint period, (1000 * len // p)::bigint exponent_milli,
       sha256(coalesce(lines, '')) runs_sha256, sha256(coalesce(c, '')) collapsed_sha256
from m left join told using (r) left join best using (r) left join kept using (r)
""",
}

QUERIES = {"op13_periodic_runs": op13_periodic_runs}
