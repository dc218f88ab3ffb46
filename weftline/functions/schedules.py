"""Schedules, throughput and batch arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Steps of pretraining, of its warm-up, the share of its decay and the last multiple.
MAX_STEPS, WARMUP, DECAY, LAST = 19073, 715, 0.65, 0.1
#: Parts of a device's name, all of which it must have, and its peak FLOP/s; the first rule that holds counts.
PEAK_FLOPS = [
    (("gb200",), 2.50e15), (("b200",), 2.25e15), (("b100",), 1.80e15),
    (("h200", "nvl"), 836e12), (("h200", "pcie"), 836e12), (("h200",), 989e12),
    (("h100", "nvl"), 835e12), (("h100", "pcie"), 756e12), (("h100",), 989e12),
    (("h800", "nvl"), 989e12), (("h800",), 756e12),
    (("a100",), 312e12), (("a800",), 312e12), (("a40",), 149.7e12), (("a30",), 165e12),
    (("l40s",), 362e12), (("l4",), 121e12),
    (("mi355",), 2.50e15), (("mi325",), 1.3074e15), (("mi300x",), 1.3074e15), (("mi300a",), 980.6e12), (("mi250x",), 383e12), (("mi250",), 362.1e12),
    (("5090",), 209.5e12), (("4090",), 165.2e12), (("3090",), 71e12),
]


def pretrain_lr(it: Column, steps: int = MAX_STEPS, warmup: int = WARMUP, decay: float = DECAY, last: float = LAST) -> Column:
    down = round(decay * steps)
    left = (steps - it) / down
    return F.when(it < warmup, (it + 1) / warmup).when(it <= steps - down, F.lit(1.0)).otherwise(left + (1 - left) * last)


def pretrain_momentum(it: Column, steps: int = MAX_STEPS, decay: float = DECAY) -> Column:
    down = round(decay * steps)
    start = steps - down
    early, late = it / 400, (it - start) / down
    return F.when(it < 400, (1 - early) * 0.85 + early * 0.97).when(it >= start, 0.97 * (1 - late) + 0.90 * late).otherwise(F.lit(0.97))


def weight_decay(it: Column, first: float, steps: int = MAX_STEPS) -> Column:
    return F.lit(first * 0.5) * (1 + F.cos(F.lit(math.pi) * it / steps))


def tuning_lr(progress: Column, warmup: float, decay: float) -> Column:
    rise = (progress + 1e-8) / warmup if warmup else F.lit(1.0)
    fall = 1.0 - (progress - (1.0 - decay)) / decay if decay else F.lit(1.0)
    return F.when(progress < warmup, rise).when(progress <= 1.0 - decay, F.lit(1.0)).otherwise(fall)


def tuning_momentum(step: Column) -> Column:
    share = F.least(step / 300, F.lit(1.0))
    return (1 - share) * 0.85 + share * 0.95


def rollout_lr(step: Column, steps: int) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - step / steps)


def rollout_steps(n: int, per_step: int, epochs: int) -> int:
    return n // per_step * epochs


def flops_per_token(embd: int, layers: int, heads: int, block: int, vocab: int) -> int:
    """Forward FLOPs a token: projections, attention scores, output layer."""
    return layers * 12 * 2 * embd * embd + layers * 2 * heads * (embd // heads) * block + 2 * embd * vocab


def utilisation(tokens: Column, seconds: Column, per_token: int, peak: Column, devices: int) -> Column:
    """Percent of peak FLOP/s, training being three forward passes."""
    return 100 * (per_token * rate(tokens, seconds) * 3) / (peak * devices)


def rate(tokens: Column, seconds: Column) -> Column:
    """Tokens a second; of no time infinite, with the sign of its zero, as doubles divide."""
    # a power keeps the zero's sign, which comparisons and atan2 lose
    return F.when(seconds == 0, tokens * F.pow(seconds, F.lit(-1.0))).otherwise(F.try_divide(tokens, seconds))


def accumulation_steps(total: int, batch: int, length: int, devices: int) -> int:
    if total % (batch * length * devices):
        raise ValueError("the total batch must be a multiple of batch x length x devices")
    return total // (batch * length * devices)


def peak_flops(spark: SparkSession, devices: DataFrame) -> DataFrame:
    """device, flops: the first rule all of whose parts the lower-cased name has, else infinity. The rules are a fixed short list."""
    name = F.lower("device")
    rule = F.lit(float("inf"))
    for parts, flops in reversed(PEAK_FLOPS):
        hit = F.lit(True)
        for p in parts:
            hit = hit & name.contains(p)
        rule = F.when(hit, F.lit(float(flops))).otherwise(rule)
    return devices.select("device", rule.alias("flops"))


def parsed_log(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """step, metric, metric_value of every name and number in lines such as `12 train 3.4 norm 0.9`, and the columns in keep; other lines give nothing.

    Numbers may be nan or inf.
    """
    pair = r"([A-Za-z_@][\w@]*) (-?(?:\d+\.?\d*(?:e[+-]?\d+)?|nan|inf))"
    ok = lines.filter(F.col(column).rlike(rf"^\d+( {pair})+$"))
    step = F.regexp_extract(F.col(column), r"^(\d+)", 1).cast("int")
    names = F.regexp_extract_all(F.col(column), F.lit(" " + pair), F.lit(1))
    values = F.regexp_extract_all(F.col(column), F.lit(" " + pair), F.lit(2))
    number = lambda v: F.when(v == "nan", F.lit(float("nan"))).when(v == "inf", F.lit(float("inf"))).when(v == "-inf", F.lit(float("-inf"))).otherwise(v.try_cast("double"))
    found = ok.select(*keep, step.alias("step"), F.explode(F.arrays_zip(names.alias("metric"), values.alias("v"))).alias("p"))
    return found.select(*keep, "step", "p.metric", number(F.col("p.v")).alias("metric_value"))
