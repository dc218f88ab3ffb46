"""Answers, rewards and group statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import BOS
from weftline.operators.prefix import prefix_fold, range_buckets

IGNORE = -100


def extracted_answer(text: Column) -> Column:
    """The first number after ####, without commas; null if there is none."""
    found = F.regexp_extract(text, r"####\s*([\d,.\-]+)", 1)
    return F.when(found != "", F.trim(F.replace(found, F.lit(","), F.lit(""))))


def reward(gold: Column, answer: Column) -> Column:
    """1 if both texts' answers are equal numbers, else 0."""
    number = lambda t: extracted_answer(t).try_cast("double")
    return F.when(F.coalesce(number(gold) == number(answer), F.lit(False)), 1.0).otherwise(0.0)


def advantages(rollouts: DataFrame, group: list[str]) -> DataFrame:
    """reward less its group's mean."""
    return rollouts.withColumn("advantage", F.col("reward") - F.avg("reward").over(Window.partitionBy(*group)))


def padded_targets(rollouts: DataFrame, group: list[str]) -> DataFrame:
    """ids padded with BOS to the group's longest, and y: one token later, -100 on the prompt and padding. rollouts: ids, prefix (prompt tokens)."""
    longest = F.max(F.size("ids")).over(Window.partitionBy(*group))
    pad = F.greatest(longest - F.size("ids"), F.lit(0))
    out = rollouts.withColumn("padded", F.concat("ids", F.array_repeat(F.lit(BOS), pad)))
    out = out.withColumn("mask", F.concat(generated_mask(F.size("ids"), F.col("prefix")), F.array_repeat(F.lit(0), pad)))
    n = F.size("padded") - 1
    y = F.zip_with(F.slice("padded", F.lit(2), n), F.slice("mask", F.lit(2), n), lambda i, k: F.when(k == 0, F.lit(IGNORE)).otherwise(i))
    return out.withColumn("x", F.slice("padded", F.lit(1), n)).withColumn("y", y)


def generated_mask(size: Column, prefix: Column) -> Column:
    """0 for the prompt, 1 for all that was generated, tokens after a stop included."""
    return F.concat(F.array_repeat(F.lit(0), prefix), F.array_repeat(F.lit(1), size - prefix))


def step_statistics(rollouts: DataFrame) -> DataFrame:
    """rollouts: step, example, reward, length. Mean and population deviation of the examples' mean rewards, and the mean length of all."""
    by_example = rollouts.groupBy("step", "example").agg(F.avg("reward").alias("r"), F.sum("length").alias("len"), F.count("*").alias("n"))
    return by_example.groupBy("step").agg(F.avg("r").alias("reward_mean"), F.stddev_pop("r").alias("reward_std"), (F.sum("len") / F.sum("n")).alias("mean_len"))


def pass_at_1(results: DataFrame) -> DataFrame:
    """results: step, correct (0 or 1). Sums before the ratio, whatever the rank."""
    s = results.groupBy("step").agg(F.sum("correct").alias("correct"), F.count("*").alias("total"))
    return s.withColumn("pass1", F.col("correct") / F.greatest("total", F.lit(1)))


def zero_streaks(steps: DataFrame) -> DataFrame:
    """steps: step, reward_mean. The length of the run of zero steps that ends at each step, and whether to warn (5 and more)."""
    # a step's streak: the zero steps so far, less those up to the last step that was not zero
    s = range_buckets(steps, "step", "bucket_").withColumn("zero_", F.coalesce(F.col("reward_mean") == 0, F.lit(False)).cast("long"))
    s = prefix_fold(s, {"zeros_": (F.sum, "zero_")}, "step", "bucket_").withColumn("mark_", F.when(F.col("reward_mean") != 0, F.col("zeros_")))
    s = prefix_fold(s, {"last_": (F.max, "mark_")}, "step", "bucket_")
    s = s.withColumn("streak", F.when(F.col("reward_mean") == 0, F.col("zeros_") - F.coalesce("last_", F.lit(0))).otherwise(0))
    return s.select("step", "reward_mean", "streak", (F.col("streak") >= 5).alias("warn"))


def policy_objective(tokens: DataFrame, passes: int, examples: int) -> DataFrame:
    """tokens: step, logp, adv, target. Sum of logp adv over valid tokens times passes and examples, valid being one at least."""
    s = tokens.groupBy("step").agg(F.sum(F.col("logp") * F.col("adv")).alias("total"), F.count_if(F.col("target") != IGNORE).alias("valid"))
    return s.withColumn("objective", F.col("total") / (F.greatest("valid", F.lit(1)) * passes * examples))


def rollout_seed(step: Column, example: Column, pass_no: Column) -> Column:
    return (step.cast("long") * 10000 + example.cast("long") * 100 + pass_no).bitwiseAND(F.lit(0x7FFFFFFF))
