"""Prefix sums over an order without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.session import materialize


def whole_div(value: Column, by: int | Column) -> Column:
    """The whole quotient of whole numbers, rounded down, exact as far as doubles hold it."""
    by = F.lit(by) if isinstance(by, int) else by
    return ((value - F.pmod(value, by)) / by).cast("long")


#: Range buckets of an order, and parts of the rows that share a frequent key.
BUCKETS, PARTS = 1024, 64


def range_buckets(df: DataFrame, key: str, out: str, tie: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds out, a bucket number that never falls in the order of (key, nulls last; tie), whatever keys are sparse, frequent or null.

    Bounds are approximate quantiles of the key. A key at two quantiles is frequent: its rows, and those without a key,
    are dealt into PARTS buckets by the tie, a hash in 64 bits.
    """
    found = df.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("q")).first()["q"] or []  # `buckets` numbers
    often = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    bounds = sorted(set(found))
    place = F.lit(0)
    if bounds:
        halves = [1 << i for i in reversed(range(len(bounds).bit_length()))]
        # a search by halves; past the end the last bound stands again, which moves no order
        padded = bounds + [bounds[-1]] * (2 * halves[0] - 1 - len(bounds))
        all_ = F.split(F.lit(",".join(map(str, padded))), ",").cast(f"array<{dict(df.dtypes)[key]}>")
        steps = F.split(F.lit(",".join(map(str, halves))), ",").cast("array<int>")
        place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col(key) >= F.get(all_, at + step - 1), at + step).otherwise(at))
    part = F.shiftright(F.lit(0).cast("long") if tie is None else tie, 58) + 32
    within = F.lit(0).cast("long")
    if often and tie is not None:
        hot = F.col(key).isin(often)
        within = F.when(hot, part)
        # other keys of a frequent key's bucket come after it: the key itself is the bucket's least
        within = within.otherwise(F.lit(PARTS - 1).cast("long"))
    last = 2 * len(bounds) + 2
    number = F.when(F.col(key).isNull(), F.lit(last * PARTS) + part).otherwise(place * PARTS + within)
    return df.withColumn(out, number.cast("long"))


def prefix_sum(df: DataFrame, value: str, order: list[Column | str], bucket: str, out: str, group: list[str] = (), fan: int | None = None, below: int | None = None) -> DataFrame:
    """Adds out, the sum of value over all earlier rows of the group.

    bucket is a non-null column that never falls as the order rises. Buckets are summed first (partial
    aggregation), the totals get a window of their own, and each bucket is then summed by itself, so that
    neither a large group nor the whole table meets in one task. Where the number of buckets follows the table,
    fan says how many (whole) bucket numbers make a coarser bucket, over which the totals are summed in the same way.
    With below, only rows with out < below are given, and buckets that begin at or above it are left out before any
    of their rows is shuffled: the buckets below it are broadcast, so their number must be bounded.
    """
    keys = [*group, bucket]
    total, base, within = f"{out}__total", f"{out}__base", f"{out}__within"
    totals = df.groupBy(*keys).agg(F.sum(value).alias(total))
    if fan:
        coarse = f"{out}__coarse"
        bases = prefix_sum(totals.withColumn(coarse, whole_div(F.col(bucket), fan)), total, [bucket], coarse, base, group).select(*keys, base)
    else:
        before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select(*keys, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(base))
    if below is not None:
        bases = F.broadcast(bases.filter(F.col(base) < below))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.join(bases, keys).withColumn(within, F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn(out, F.col(base) + F.col(within)).drop(base, within)
    return summed if below is None else summed.filter(F.col(out) < below)


def prefix_fold(df: DataFrame, folds: dict[str, tuple[Callable, str]], order: str, bucket: str) -> DataFrame:
    """Adds running aggregates over all rows up to and with each, in the order of a key that holds no value twice within a bucket.

    folds: name to (F.sum, F.min or F.max, column). Buckets are folded first, then their folds by a window, then each bucket by itself.
    """
    totals = df.groupBy(bucket).agg(*(f(F.col(c)).alias(f"{name}__t") for name, (f, c) in folds.items()))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(bucket, *(f(F.col(f"{name}__t")).over(before).alias(f"{name}__b") for name, (f, _) in folds.items()))
    inside = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(bases, bucket)
    both = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.min: F.least, F.max: F.greatest}
    for name, (f, c) in folds.items():
        out = out.withColumn(name, both[f](F.col(f"{name}__b"), f(F.col(c)).over(inside)))
    return out.drop(*(f"{name}__b" for name in folds))


def sorted_parts(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows range-sorted by some columns, nulls first, with part__, the number of the task that a row was dealt to, and row__, which rises
    by one from row to row of a part, and from part to part.

    As many rows go to a task as Spark deals, however the keys lie: equal ones are parted by a number written before and stand as they
    fall. The rows are written twice, so they should be thin.
    """
    own = materialize(rows.withColumn("tie__", F.monotonically_increasing_id()), "tied")
    by = [*map(F.col, order), F.col("tie__")]
    # in a sorted partition the id rises by one from row to row, and its upper bits are the partition's number
    dealt = own.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row__", F.monotonically_increasing_id()).drop("tie__")
    return materialize(dealt, "ordered").withColumn("part__", F.shiftright("row__", 33))


def running_sum(rows: DataFrame, value: str, order: list[Column], out: str, below: int | None = None) -> DataFrame:
    """Adds out, the sum of value (whole numbers, not null) over all rows before each, in a given order; rows equal in it stand as they fall.

    Rows may be thick: a range sort shuffles them once, as many to a task as Spark deals, however the keys lie (equal ones are parted by a
    number that a scan gives again if it is repeated), and each task adds its rows up while it writes them. Then only the tasks' sums,
    a row each, pass through a window. With below, only rows with out < below are given, and parts that begin beyond it are not read.
    """
    tied = rows.withColumn("tie__", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(*order, F.col("tie__")).sortWithinPartitions(*order, "tie__").drop("tie__").withColumn("part__", F.spark_partition_id())
    place = dealt.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            sums = np.cumsum(b.column(place).to_numpy()) + total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([[total], sums[:-1]]), pa.int64())], names=[*b.schema.names, "within__"])
            total = int(sums[-1]) if sums.size else total

    schema = T.StructType([*dealt.schema, T.StructField("within__", T.LongType())])
    made = materialize(dealt.mapInArrow(run, schema), "running-sum")
    sums = made.groupBy("part__").agg(F.sum(value).alias("total__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = sums.select("part__", F.coalesce(F.sum("total__").over(before), F.lit(0)).alias("base__"))
    if below is not None:
        bases = bases.filter(F.col("base__") < below)
    # as many as tasks; Spark takes them for large, and would shuffle the rows again
    summed = made.join(F.broadcast(bases), "part__").withColumn(out, F.col("base__") + F.col("within__")).drop("part__", "base__", "within__")
    return summed if below is None else summed.filter(F.col(out) < below)


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds out: the rows' places, from 0, in the order of some columns, nulls first. Each part's rows are counted, and the counts of the
    parts before are added."""
    dealt = sorted_parts(rows, order)
    parts = dealt.groupBy("part__").agg(F.min("row__").alias("first__"), F.count("*").alias("n__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    shifts = parts.select("part__", (F.coalesce(F.sum("n__").over(before), F.lit(0)) - F.col("first__")).alias("shift__"))
    return dealt.join(shifts, "part__").withColumn(out, F.col("row__") + F.col("shift__")).drop("row__", "part__", "shift__")
