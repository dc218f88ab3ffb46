"""op4_hnsw_search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.hnsw import nearest
from weftline.session import table


def op4_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


QUERIES = {"op4_hnsw_search": op4_hnsw_search}
SQL: dict[str, str] = {}
