"""A training corpus from documents: quality, near duplicates, secrets, mix, packing.

STAGES are run in order, each on all that the one before kept, written as Parquet in between. All but the
last return the columns of documents. The second stage decides by row: rows that share an id but not a text are
different documents, rows with a null id are judged like all others. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.jaccard import similar_classes
from weftline.llm.mixing import fair_mix
from weftline.llm.packing import pack
from weftline.llm.quality_classifier import score, train
from weftline.llm.queries_quality import CUT, held_out
from weftline.llm.secrets import fitted, scan
from weftline.session import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labels outside the held-out fifth."""
    docs = docs.select(*COLUMNS)
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out(5, 0)))
    return score(docs, model, COLUMNS, "text", "quality_score").filter(F.col("quality_score") >= CUT).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the row with the least id; rows that share their id and text are one, and null ids come last."""
    docs = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    classes = similar_classes(docs, id_col="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    named = docs.select("row_key", "doc_id").join(classes, "row_key")
    least = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("least"))
    kept = docs.join(least.select("least.row_key"), "row_key", "left_semi")
    one = kept.groupBy("row_key").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64(*COLUMNS)).alias("row_"))
    return one.select("row_.*")


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark."""
    docs = docs.select(*COLUMNS)
    found = scan(docs, fitted(docs), COLUMNS, "text")
    n_chars = F.when(F.size("secret_spans") > 0, F.length("clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.col("clean_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in its order; a copy that the mix's end cuts has its first words only."""
    docs = docs.select(*COLUMNS)
    row_hash = F.xxhash64(*COLUMNS)
    _, mix = fair_mix(docs.withColumn("mix_key_", F.struct("doc_id", row_hash.alias("row_hash"))), id_col="mix_key_")
    rows = docs.withColumn("row_hash", row_hash).withColumn("id_", F.coalesce("doc_id", F.lit(0))).dropDuplicates(["id_", "row_hash"])
    served = mix.select(F.coalesce("mix_id.doc_id", F.lit(0)).alias("id_"), F.col("mix_id.row_hash").alias("row_hash"), "mix_served", "mix_size", "mix_offset")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col("mix_served").cast("int")), "")
    whole = F.col("mix_served") >= F.col("mix_size")
    out = rows.join(served, ["id_", "row_hash"]).withColumn("text", F.when(whole, F.col("text")).otherwise(part))
    out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.orderBy("mix_offset").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row for each piece; `pack` has the token ids too, where asked."""
    return pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("jaccard_join", jaccard_join),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: The classifier, the network and the tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
