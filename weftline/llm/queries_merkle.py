"""op11_merkle_manifest and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.columns import crc32_sql
from weftline.llm.merkle import folded, manifest, row_digest, siblings_of
from weftline.session import table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = [F.translate("text", string.ascii_uppercase, string.ascii_lowercase) if c == "text" else F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, row_digest(other))
    out = manifest(docs, F.col("source"), [F.col("doc_id")], row_digest([F.col(c) for c in FIELDS]), [F.col("doc_id"), F.unhex(tampered).alias("tampered")])
    start = F.coalesce(F.lower(F.hex("tampered")), F.col("leaf"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings_of(F.col("path")), 256).alias("proof_sha256"), folded(start, F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of the SQL below: groups of 16 ** 6 leaves at most, and as many groups.
_DEPTH = 6


def _leaf_sql(text: str) -> str:
    told = lambda x: f"case when {x} is null then '-' else strlen({x}::varchar) || ':' || {x}::varchar end"
    return "sha256(" + " || ".join(told(text if c == "text" else c) for c in FIELDS) + ")"


def _tree_sql(name: str) -> str:
    """name0 (g, i, h, n) becomes name1 and so on: the nodes of each level, with the number of nodes in their group."""
    out = []
    for k in range(_DEPTH):
        out.append(f"""{name}{k + 1} as (
  select g, i // 16 i, sha256(string_agg(h, '' order by i)) h, (n + 15) // 16 n from {name}{k} where n > 1 group by g, i // 16, n
  union all select g, i, h, n from {name}{k} where n = 1
), {name}_run{k} as (
  select g, i // 16 run, list(h order by i) hs from {name}{k} where n > 1 group by g, i // 16
)""")
    return ", ".join(out)


def _fold_sql(name: str, source: str, first: str) -> str:
    """first (r, g, i, node, proof) goes up the levels of name."""
    out, last = [], first
    for k in range(_DEPTH):
        at = f"(i // {16**k}) % 16"
        out.append(f"""{source}{k} as (
  select f.r, f.g, f.i, case when hs is null then node else sha256(array_to_string(hs[1:({at})::int] || [node] || hs[({at} + 2)::int:], '')) end node,
         proof || coalesce(array_to_string(hs[1:({at})::int] || hs[({at} + 2)::int:], ''), '') proof
  from {last} f left join {name}_run{k} on f.g = {name}_run{k}.g and f.i // {16 ** (k + 1)} = run
)""")
        last = f"{source}{k}"
    return ", ".join(out)


SQL = {
    "op11_merkle_manifest": f"""
with d as (
  select row_number() over () r, doc_id, coalesce('=' || source, '') g, {_leaf_sql("text")} h,
         case when {crc32_sql("doc_id::varchar")} % 5 = 0 then {_leaf_sql(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} end tampered from documents
), p as (
  select *, row_number() over (partition by g order by doc_id nulls first, h, r) - 1 i, count(*) over (partition by g) n from d
), g0 as (
  select g, i, h, n from p
), {_tree_sql("g")}, s as (
  select g as source, h, row_number() over (order by g) - 1 i, count(*) over () n from g{_DEPTH}
), t0 as (
  select '' g, i, h, n from s
), {_tree_sql("t")}, u as (
  select r, g, i, coalesce(tampered, h) node, '' proof from p
), {_fold_sql("g", "fg", "u")}, v as (
  select f.r, '' g, s.i, f.node, f.proof from fg{_DEPTH - 1} f join s on f.g = s.source
), {_fold_sql("t", "ft", "v")}
select doc_id, p.h leaf, s.h subroot, (select h from t{_DEPTH}) root, sha256(f.proof) proof_sha256, f.node folded_root, f.node = (select h from t{_DEPTH}) verified
from p join s on p.g = s.source join ft{_DEPTH - 1} f on p.r = f.r
""",
}

QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
