"""op2_language_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.langid import predict, train
from weftline.session import table


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1)
    model = train(docs.filter(~F.col("held_out")), "text", "lang")
    return predict(docs, model, ["doc_id", "held_out"], "text")


QUERIES = {"op2_language_id": op2_language_id}
SQL: dict[str, str] = {}
