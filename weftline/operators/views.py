"""Views over indexed tasks: slice, sequence, mixture, shuffle, export.

Defined results: a task's rows are numbered 0 to n - 1 by idx, once each; rows without a number, or with one beyond, have no place in a
shuffle. Groups and keys may be null, repeated and sparse: null groups and keys come first, rows with the same key stand as they fall.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.permute import where_from, where_to
from weftline.operators.prefix import numbered, whole_div
from weftline.session import materialize

#: Rows of a mixture in Python's order, which the driver lists.
LISTED = 5_000_000


def slice_view(task: DataFrame, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows start, start + step, ... before stop, numbered anew from 0. task: idx and more."""
    if start < 0 or step < 1 or (stop is not None and stop < start):
        raise ValueError("a slice needs 0 <= start <= stop and step >= 1")
    hit = (F.col("idx") >= start) & ((F.col("idx") - start) % step == 0)
    if stop is not None:
        hit &= F.col("idx") < stop
    return task.filter(hit).withColumn("physical", F.col("idx")).withColumn("idx", whole_div(F.col("idx") - start, step))


def slice_length(start: int, stop: int, step: int) -> int:
    return -(-(stop - start) // step)


def sequence_view(tasks: list[tuple[DataFrame, int]]) -> DataFrame:
    """Tasks (with their lengths) one after another: task, local, idx and the tasks' columns."""
    out, offset = None, 0
    for k, (task, n) in enumerate(tasks):
        part = task.withColumn("task", F.lit(k)).withColumn("local", F.col("idx")).withColumn("idx", F.col("idx") + F.lit(offset))
        out = part if out is None else out.unionByName(part)
        offset += n
    return out


def mixture_map(lengths: list[int], seed: int = 42) -> list[tuple[int, int]]:
    """(task, local) in the order of Python's seeded shuffle: a list that the driver holds."""
    pairs = [(task, local) for task, n in enumerate(lengths) for local in range(n)]
    random.Random(seed).shuffle(pairs)
    return pairs


def mixture_view(spark: SparkSession, tasks: list[tuple[DataFrame, int]], seed: int = 42, order: str = "keyed") -> DataFrame:
    """All tasks' rows in one shuffled order, told by idx; a task listed twice counts twice.

    order: "keyed", a permutation that is computed for each row by itself, whatever the number of rows, or "python", the order of Python's
    generator, whose list the driver holds (LISTED rows at most, else an error).
    """
    lengths = [n for _, n in tasks]
    rows = sequence_view(tasks)
    if order == "keyed":
        return shuffled(rows, sum(lengths), seed)
    if order != "python":
        raise ValueError("order is keyed or python")
    if sum(lengths) > LISTED:
        raise ValueError(f"the driver lists {LISTED} rows at most; take the keyed order")
    listed = [(i, t, n) for i, (t, n) in enumerate(mixture_map(lengths, seed))]
    return rows.drop("idx").join(spark.createDataFrame(listed, "idx long, task int, local long"), ["task", "local"])


def shuffled(rows: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Rows numbered 0 to n - 1 by idx, with idx anew: their places in a shuffled order. `in_order` is the former idx."""
    return rows.withColumn("in_order", F.col("idx").cast("long")).withColumn("idx", where_to(F.col("in_order"), n, seed) if n else F.lit(None).cast("long"))


def shuffled_page(rows: DataFrame, n: int, first: int, last: int, seed: int = 42) -> DataFrame:
    """The rows that shuffled puts at places first to last - 1, without shuffling the others: the places are mapped back and looked up."""
    if not 0 <= first <= last <= n:
        raise ValueError("a page lies within the rows")
    places = rows.sparkSession.range(first, last).select(F.col("id").alias("place"), (where_from(F.col("id"), n, seed) if n else F.col("id")).alias("in_order"))
    return places.join(rows.withColumnRenamed("idx", "in_order"), "in_order").withColumnRenamed("place", "idx")


def grouped_tasks(rows: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """A task for each value of group, null included and first, in order: the rows with task, local (their places by key in the task, null
    keys first) and idx (their places in all tasks, one after another), and a table of the tasks: task, first_row, n_rows."""
    placed = numbered(rows, [group, key], "place_")
    sizes = placed.groupBy(group).agg(F.min("place_").alias("first_row"), F.count("*").alias("n_rows"))
    tasks = materialize(numbered(sizes, ["first_row"], "task"), "tasks").withColumn("task", F.col("task").cast("int"))
    named = tasks.withColumnRenamed(group, "group_")
    out = placed.join(named.drop("n_rows"), F.col(group).eqNullSafe(F.col("group_"))).drop("group_")
    return out.withColumn("local", F.col("place_") - F.col("first_row")).withColumn("idx", F.col("place_")).drop("first_row", "place_"), tasks.drop(group)


def hash_shuffled(task: DataFrame, seed: int, key: str = "idx") -> DataFrame:
    """A shuffle for keys that are not numbered: order by `shuffle_key`, their hash; equal keys stay together."""
    return task.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(key)))
