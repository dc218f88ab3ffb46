"""op3_quality_rules and op5_quality_classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.quality_classifier import score, train
from weftline.llm.quality_rules import judged
from weftline.session import table

#: From this score on a document counts as good.
CUT = 0.3


def held_out(divisor: int, rest: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % divisor == rest


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def quality_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(~held_out(5, 0))
    model = train(table(spark, sf_dir, "documents"), labels)
    return score(docs, model, keep, "text", "quality_score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_scores(spark, docs, sf_dir, ["doc_id", held_out(5, 0).alias("held_out")])
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= CUT).cast("int").alias("predicted"))


QUERIES = {"op3_quality_rules": op3_quality_rules, "op5_quality_classifier": op5_quality_classifier}
SQL: dict[str, str] = {}
