"""op12_decontaminate and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.decontaminate import WINDOW, contamination
from weftline.session import table


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), ["doc_id"], "text", table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = {
    "op12_decontaminate": rf"""
with d as (
  select row_number() over () r, doc_id, {_WORDS} w from documents
), i as (
  select item_id, w, least(len(w), {WINDOW}) n from (select coalesce(item_id::varchar, '') item_id, {_WORDS} w from benchmark) where len(w) > 0
), items as (
  select distinct item_id, n, unnest(list_transform(range(0, len(w) - n + 1), lambda k: array_to_string(w[(k + 1)::int:(k + n)::int], ' '))) win from i
), starts as (
  select r, n, w, unnest(range(0, len(w) - n + 1)) k from d, (select distinct n from items) where len(w) >= n
), found as (
  select r, n, k, item_id from (select r, n, k, array_to_string(w[(k + 1)::int:(k + n)::int], ' ') win from starts) join items using (n, win)
), hit as (
  select r, count(*) n_hit from (select distinct r, unnest(range(k, k + n)) from found) group by r
), held as (
  select r, count(*) n_items, string_agg(item_id, ',' order by item_id) told from (select distinct r, item_id from found) group by r
)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(told, '')) items_sha256, n_hit is not null contaminated
from d left join hit using (r) left join held using (r)
""",
}

QUERIES = {"op12_decontaminate": op12_decontaminate}
