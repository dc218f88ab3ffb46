"""Best-fit packing of rendered conversations into training rows, and their targets.

Rank r takes conversations r, r + W, ... Within a rank the packing is sequential by definition: a buffer of up to
`buffer` conversations is refilled before each pick, the longest that fits is taken (the earliest of equals), and a row
that nothing fits is filled with padding. Ranks are independent; a rank's lengths stream through one task in order, sorted by
Spark, and only the buffer is held; tokens never go through it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import BOS
from weftline.operators.prefix import numbered, prefix_sum, range_buckets
from weftline.session import materialize

IGNORE = -100


def ranked(rendered: DataFrame, order: str, ranks: int, capacity: int) -> DataFrame:
    """idx (dense, from the order), rank = idx % ranks, of the conversations that fit a row."""
    r = range_buckets(rendered.withColumn("one_", F.lit(1)), order, "bucket_", F.xxhash64("ids"))
    r = prefix_sum(r, "one_", [F.col(order).asc_nulls_last(), F.xxhash64("ids")], "bucket_", "idx").drop("one_", "bucket_")
    return r.withColumn("rank", (F.col("idx") % ranks).cast("int")).filter(F.size("ids") <= capacity)


def fill_rows(lengths: Iterable[tuple[Any, int]], capacity: int, buffer: int) -> Iterator[list]:
    """Lists of the items of each row, from (item, length) in order."""
    held: list[tuple[Any, int]] = []
    source, more = iter(lengths), True
    while True:
        row, left = [], capacity
        while left:
            while more and len(held) < buffer:
                item = next(source, None)
                if item is None:
                    more = False
                else:
                    held.append(item)
            best = None
            for at, (_, n) in enumerate(held):
                if n <= left and (best is None or n > held[best][1]):
                    best = at
            if best is None:
                break
            item, n = held.pop(best)
            row.append(item)
            left -= n
        if not row:
            return
        yield row


def planned_rows(lengths: DataFrame, ranks: int, capacity: int, buffer: int) -> DataFrame:
    """lengths: rank, idx, row_id, n. rank, row_no, slot, row_id: where each conversation goes. A rank is planned in one task, in order, from
    lengths alone."""

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["rank", "row_no", "slot", "row_id"])
        for rank, convs in itertools.groupby(source(batches), key=lambda c: c[0]):
            for no, row in enumerate(fill_rows(((c[1], c[2]) for c in convs), capacity, buffer)):
                out += [(rank, no, slot, row_id) for slot, row_id in enumerate(row)]
                if len(out) >= 10_000:
                    yield made()
                    out.clear()
        if out:
            yield made()

    thin = lengths.repartition(ranks, "rank").sortWithinPartitions("rank", "idx").select("rank", "row_id", "n")
    return thin.mapInArrow(run, "rank int, row_no int, slot int, row_id long")


def pack_bestfit(rendered: DataFrame, *, order: str = "conv_id", ranks: int = 2, length: int = 4096, buffer: int = 200) -> DataFrame:
    """rank, row_no, ids, mask, convs: rows of length + 1 tokens, padded with BOS of mask 0; one pass over the source.

    Which conversation goes where depends on lengths alone, so each rank's plan is made from those, a few bytes a conversation, and the
    rows are put together from it in as many tasks as there is data for, whatever the number of ranks. Rows of the same key are
    conversations each.
    """
    capacity = length + 1
    rows = materialize(rendered.select(F.col(order).alias("conv"), "ids", "mask", F.monotonically_increasing_id().alias("row_id")), "rendered")
    placed = numbered(rows.select("row_id", "conv", F.size("ids").alias("n")), ["conv", "row_id"], "idx")
    lengths = placed.withColumn("rank", (F.col("idx") % ranks).cast("int")).filter(F.col("n") <= capacity)
    plan = materialize(planned_rows(lengths, ranks, capacity, buffer), "packing-plan")
    part = F.struct("slot", "ids", "mask", F.col("conv").cast("long").alias("conv"))
    met = plan.join(rows, "row_id").groupBy("rank", "row_no").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # a row's tokens at most
    joined = lambda c: F.flatten(F.transform("parts", lambda p: p[c]))
    pad = F.lit(capacity) - F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["ids"]))
    padded = lambda c, value: F.concat(joined(c), F.array_repeat(F.lit(value), pad))
    return met.select("rank", "row_no", padded("ids", BOS).alias("ids"), padded("mask", 0).alias("mask"), F.transform("parts", lambda p: p["conv"]).alias("convs"))


def targets(ids: Column, mask: Column) -> tuple[Column, Column]:
    """x and y of a row: y is x one token later, and -100 where the later token's mask is 0."""
    n = F.size(ids) - 1
    y = F.zip_with(F.slice(ids, F.lit(2), n), F.slice(mask, F.lit(2), n), lambda i, k: F.when(k == 0, F.lit(IGNORE)).otherwise(i))
    return F.slice(ids, F.lit(1), n), y


def with_targets(rows: DataFrame) -> DataFrame:
    x, y = targets(F.col("ids"), F.col("mask"))
    return rows.withColumn("x", x).withColumn("y", y)


def learnable(rows: DataFrame) -> DataFrame:
    """Rows with at least one target."""
    return rows.filter(F.exists("y", lambda v: v != IGNORE))


def packing_stats(rows: DataFrame) -> DataFrame:
    """rows, pads and percent filled. An extension."""
    pads = F.size(F.filter("ids", lambda i: i == BOS)) - F.size("convs")
    return rows.agg(F.count("*").alias("rows"), F.sum(pads).alias("pads"), (100 * (1 - F.sum(pads) / F.sum(F.size("ids")))).alias("fill_pct"))
