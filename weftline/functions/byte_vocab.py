"""The byte-level vocabulary: ids 0-255 are UTF-8 bytes, then the specials. All expressions are built in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The special tokens, in the order of their ids.
SPECIALS = ["<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>"]
BOS, USER_START, USER_END, ASSISTANT_START, ASSISTANT_END, PYTHON_START, PYTHON_END, OUTPUT_START, OUTPUT_END = range(256, 265)


def byte_ids(text: Column) -> Column:
    """array<int> of a text's UTF-8 bytes; null and empty give an empty array."""
    return ids_of_bytes(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def ids_of_bytes(data: Column) -> Column:
    """array<int> of bytes, read as Latin-1, whose characters have the bytes' values as code points."""
    chars = F.split(F.decode(data, "ISO-8859-1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c))


def byte_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def bytes_text(ids: Column) -> Column:
    """Text of byte ids; other ids are left out, and malformed UTF-8 becomes U+FFFD."""
    own = F.filter(ids, lambda i: i < 256)
    raw = F.unhex(F.array_join(F.transform(own, lambda i: F.lpad(F.hex(i), 2, "0")), ""))
    return F.coalesce(F.make_valid_utf8(raw.cast("string")), F.lit(""))


def vocabulary(spark: SparkSession) -> DataFrame:
    """token_id, bytes, is_special, special, n_bytes (of the decoded token, 0 for specials), raw_bytes."""
    v = spark.range(256 + len(SPECIALS)).select(F.col("id").cast("int").alias("token_id"))
    names = F.array(*map(F.lit, SPECIALS))
    special = F.when(F.col("token_id") >= 256, F.element_at(names, F.col("token_id") - 255))
    raw = F.when(F.col("token_id") < 256, F.unhex(F.lpad(F.hex("token_id"), 2, "0")))
    # a byte that is not a whole character decodes to U+FFFD, of three bytes
    decoded = F.when(F.col("token_id") < 128, 1).when(F.col("token_id") < 256, 3).otherwise(0)
    return v.select("token_id", raw.alias("bytes"), (F.col("token_id") >= 256).alias("is_special"), special.alias("special"), decoded.alias("n_bytes"), F.coalesce(F.octet_length(raw), F.lit(0)).alias("raw_bytes"))
