"""op8_jaccard_join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.jaccard import similar_classes
from weftline.session import table


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
SQL: dict[str, str] = {}
