"""op6_token_counts and op9_pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.packing import pack
from weftline.llm.token_counts import encoded_lengths, length_table
from weftline.session import table


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_table(encoded_lengths(table(spark, sf_dir, "documents")))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_counts": op6_token_counts, "op9_pack": op9_pack}
SQL: dict[str, str] = {}
