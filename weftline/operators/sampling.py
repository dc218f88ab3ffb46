"""Choosing tokens from logits: rows of (row, token_id, logit)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def greedy(logits: DataFrame) -> DataFrame:
    """The token of the greatest logit, the lowest id of equals."""
    return logits.groupBy("row").agg(F.max_by("token_id", F.struct(F.col("logit"), -F.col("token_id"))).alias("token_id"))


def _softmax(kept: DataFrame, temperature: float) -> DataFrame:
    all_ = Window.partitionBy("row")
    e = F.exp((F.col("logit") - F.max("logit").over(all_)) / temperature)
    return kept.withColumn("e_", e).withColumn("prob", F.col("e_") / F.sum("e_").over(all_)).select("row", "token_id", "logit", "prob")


def top_k_exact(logits: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """Exactly k tokens a row, the lowest ids of equals, and their probabilities."""
    w = Window.partitionBy("row").orderBy(F.desc("logit"), "token_id")
    return _softmax(logits.withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= k), temperature)


def top_k_ties(logits: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """All tokens not below the k-th logit."""
    w = Window.partitionBy("row").orderBy(F.desc("logit"))
    return _softmax(logits.withColumn("r_", F.rank().over(w)).filter(F.col("r_") <= k), temperature)


def softmax_then_top_k(logits: DataFrame, k: int, temperature: float = 1.0) -> DataFrame:
    """Probabilities over all tokens, then exactly k a row, the lowest ids of equals: `prob` as it was, and `share` of what is left, by which
    a draw chooses. The set is that of top_k_exact."""
    w = Window.partitionBy("row").orderBy(F.desc("prob"), "token_id")
    kept = _softmax(logits, temperature).withColumn("r_", F.row_number().over(w)).filter(F.col("r_") <= k)
    return kept.select("row", "token_id", "logit", "prob", (F.col("prob") / F.sum("prob").over(Window.partitionBy("row"))).alias("share"))


def draw(probs: DataFrame, seed: int) -> DataFrame:
    """One token a row: the first whose running probability passes a seeded uniform number of the row."""
    # 32 bits of a hash that every engine has
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("row").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    w = Window.partitionBy("row").orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0)
    p = probs.withColumn("upto_", F.sum("prob").over(w)).filter((F.col("upto_") > u) | (F.col("upto_") >= 1 - 1e-12))
    return p.groupBy("row").agg(F.min("token_id").alias("token_id"))


def until_stop(ids: Column, stop: int) -> Column:
    """ids before the first stop token, or all."""
    at = F.array_position(ids, F.lit(stop))
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int") - 1)).otherwise(ids)


def through_stop(ids: Column, stop: int) -> Column:
    """ids up to and with the first stop token, or all."""
    at = F.array_position(ids, F.lit(stop))
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int"))).otherwise(ids)


def text_until_stop(text: Column, stop: str) -> Column:
    """The text before the first stop sign, an ASCII one, or all: its bytes are until_stop's of the text's, but only they become ids."""
    return F.substring_index(F.coalesce(text, F.lit("")), stop, 1)
