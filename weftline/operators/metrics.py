"""Likelihood metrics and training curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.prefix import prefix_fold, range_buckets, sorted_parts
from weftline.session import materialize


def bits_per_byte(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """tokens: target, loss, and n if a row stands for several. Summed nats of targets with bytes over ln 2 times their bytes; negative
    targets don't count; infinite without bytes."""
    n = F.col("n") if "n" in tokens.columns else F.lit(1).cast("long")
    t = tokens.select("target", "loss", n.alias("n")).filter("target >= 0").join(F.broadcast(vocab.select(F.col("token_id").alias("target"), "n_bytes")), "target")
    sums = t.agg(F.coalesce(F.sum(F.when(F.col("n_bytes") > 0, F.col("loss") * F.col("n"))), F.lit(0.0)).alias("nats"), F.coalesce(F.sum(F.col("n_bytes") * F.col("n")), F.lit(0)).alias("bytes"))
    return sums.select("nats", "bytes", F.when(F.col("bytes") == 0, F.lit(float("inf"))).otherwise(F.try_divide("nats", F.log(F.lit(2.0)) * F.col("bytes"))).alias("bpb"))


def validation_loss(batches: DataFrame, n: int) -> DataFrame:
    """batches: rank, batch_no, loss. The mean over ranks of each rank's mean of its first n batches."""
    by_rank = batches.filter(F.col("batch_no") < n).groupBy("rank").agg(F.avg("loss").alias("rank_loss"))
    return by_rank.agg(F.avg("rank_loss").alias("val_loss"))


def running_best(series: DataFrame, value: str, order: str = "step") -> DataFrame:
    """The least value up to each step, in the order of steps; bucket by bucket, so that no task holds the series."""
    s = range_buckets(series.select(order, value), order, "bucket_")
    return prefix_fold(s, {"best": (F.min, value)}, order, "bucket_").select(order, value, "best")


def debiased_ema(series: DataFrame, beta: float = 0.9, value: str = "value", order: str = "step", by: str = "series") -> DataFrame:
    """by, order, value, ema, debiased: e = beta e + (1 - beta) x, over 1 - beta ** (order + 1). Values that are not finite are
    skipped, but their steps advance the exponent.

    A step maps the mean before it to the mean after it, e to a e + b, and such maps compose, so the scan has two levels and no series
    needs one task: rows are range-sorted into parts by series and step; each part composes its own maps, row by row; the parts of a
    series, a row each, are composed in order to find the mean that each begins with; and that is put into the part's maps. Steps without
    a usable value have no row in the result; null series and null steps come first, rows of the same step stand as they fall.
    """
    fields = series.select(F.col(by).alias("s"), F.col(order).cast("long").alias("o"), F.col(value).cast("double").alias("x"))
    usable = F.col("x").isNotNull() & ~F.isnan("x") & (F.abs(F.col("x")) < F.lit(float("inf")))
    parts = sorted_parts(fields.filter(usable), ["s", "o"])
    composed = materialize(_composed(parts, beta), "ema-parts")
    ends = composed.groupBy("s", "part__").agg(F.max_by(F.struct("a", "b"), "row__").alias("end"))
    begins = ends.groupBy("s").applyInArrow(_begins, f"s {dict(fields.dtypes)['s']}, part__ long, e double")
    begins = begins.withColumnsRenamed({"s": "s_", "part__": "part_"})
    met = composed.join(begins, F.col("s").eqNullSafe(F.col("s_")) & (F.col("part__") == F.col("part_")))
    ema = met.withColumn("ema", F.col("a") * F.col("e") + F.col("b"))
    return ema.select(F.col("s").alias(by), F.col("o").alias(order), F.col("x").alias(value), "ema", (F.col("ema") / (1 - F.col("fade"))).alias("debiased"))


#: Values that a step of the running mean takes at once, and terms that are added up newest first.
BLOCK = 400


def _composed(parts: DataFrame, beta: float) -> DataFrame:
    """Adds a and b, the map from the mean before a part's first row of the series to the mean after each row, and fade, beta ** (o + 1). b is the plain sum of the
    weighed values, newest first, as SQL adds them up; what is older than BLOCK values is one more term at the end."""
    powers = np.array([math.pow(beta, k) for k in range(BLOCK + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, last, sums = object(), 0, np.zeros(BLOCK), np.zeros(BLOCK)
        for batch in batches:
            names, part = batch.column(0).to_pylist(), batch.column(3).to_numpy()
            x, at = batch.column(2).to_numpy(), np.empty(len(names), np.int64)
            for i, name in enumerate(zip(names, part.tolist(), strict=True)):
                now, seen = name, seen + 1 if name == now else 0
                at[i] = seen
            b = np.empty(len(x))
            for first in range(0, len(x), BLOCK):
                # last and sums: what BLOCK rows before had, of whatever series
                own, place = (1 - beta) * x[first : first + BLOCK], at[first : first + BLOCK]
                n, held = len(own), np.concatenate([last, own])
                total = np.zeros(n)
                for lag in range(min(BLOCK, int(place.max()) + 1)):
                    total += np.where(place >= lag, held[BLOCK - lag : BLOCK - lag + n] * powers[lag], 0.0)
                total += np.where(place >= BLOCK, sums[:n] * powers[BLOCK], 0.0)
                b[first : first + n] = total
                last, sums = held[n:], np.concatenate([sums, total])[n:]
            a, fade = np.power(beta, at + 1.0), [None if o is None else _power(beta, o + 1) for o in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b), pa.array(fade, pa.float64())], names=["s", "o", "x", "part__", "row__", "a", "b", "fade"])

    rows = parts.select("s", "o", "x", "part__", "row__").repartition("part__").sortWithinPartitions("part__", "row__")
    kind = dict(parts.dtypes)["s"]
    return rows.mapInArrow(run, f"s {kind}, o long, x double, part__ long, row__ long, a double, b double, fade double")


def _power(base: float, exponent: int) -> float:
    """As the C library gives it, from which Spark's differs by a last bit."""
    try:
        return math.pow(base, exponent)
    except OverflowError:
        return math.inf


def _begins(ends: pa.Table) -> pa.Table:
    """The mean that each part of a series begins with: a row a part."""
    order = np.argsort(ends["part__"].to_numpy())
    maps, out, e = ends["end"].to_pylist(), np.empty(len(order)), 0.0
    for i in order:
        out[i] = e
        e = maps[i]["a"] * e + maps[i]["b"]
    return pa.table({"s": ends["s"], "part__": ends["part__"], "e": pa.array(out)})
