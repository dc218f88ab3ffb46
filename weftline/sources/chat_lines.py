"""Chat conversations as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.chat import MESSAGES


def read_chat_lines(spark: SparkSession, path: str) -> DataFrame:
    """messages of every line; blank lines are skipped, malformed ones raise."""
    lines = spark.read.schema("messages array<struct<role: string, content: string>>").option("mode", "FAILFAST").json(path)
    none = F.lit(None).cast("array<struct<type: string, text: string>>")
    return lines.select(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), none.alias("parts"))).cast(MESSAGES).alias("messages"))


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and the columns that put the lines of files in order: file, block (where the part of the file begins that a task reads at once)
    and line_id, which rises from line to line of a part."""
    lines = spark.read.text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_id"))


def read_first_lines(spark: SparkSession, path: str, n: int = 5000) -> DataFrame:
    """The first n physical lines, in order, whatever parts the files are read in; a blank line is an error."""
    lines = physical_lines(spark, path).orderBy("file", "block", "line_id").limit(n)
    return lines.select(F.from_json(F.when(F.trim("value") == "", F.raise_error(F.lit("a blank line"))).otherwise(F.col("value")), "messages array<struct<role: string, content: string>>", {"mode": "FAILFAST"})["messages"].alias("messages"))


def write_chat_lines(convs: DataFrame, path: str, limit: int | None = None, order: str = "conv_id") -> None:
    """One {"messages": [{"role", "content"}]} object a line, of the first `limit` conversations."""
    some = convs.orderBy(order).limit(limit) if limit is not None else convs
    plain = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    some.select(F.to_json(F.struct(plain.alias("messages"))).alias("value")).write.text(path)


def read_completion_lines(spark: SparkSession, path: str) -> DataFrame:
    """Completion items: ind, ctx, endings, label and their provenance."""
    return spark.read.schema("ind long, activity_label string, ctx string, endings array<string>, label int, split string, split_type string, source_id string").json(path)
