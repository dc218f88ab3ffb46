"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document is dealt into its source's queue in the order of a seeded md5 of its id. A queue holds
`repeats` passes over the source. A queue sends its documents in packets of `quantum` words, and a packet's virtual finish time is
the number of its source's words up to and with it, divided by the source's target. The packets of all sources
are sorted globally by that time (range buckets of it, each sorted by itself), and the mix ends where its running size reaches the
total budget. Nothing else cuts a source: a source's words are near its target, by a packet and its share of the packets that the
others still owe at the end, because the queue is fair. A document of which some packets come after the end is sent in part.

Defined results: null and wordless texts have size 0 and are never served; sources may be null (a source of
its own, sorted last); repeated rows are separate documents; an empty table gives an empty mix; other columns
pass through, and the operator's own columns (all named mix_*) replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.prefix import prefix_sum
from weftline.session import delete_path, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Range buckets of the shuffle key within a source, and of virtual time up to 1, at least; and words a bucket beyond that.
BUCKETS, MOST, BUCKET_WORDS = 4096, 1 << 18, 1 << 22
#: Words of a packet.
QUANTUM = 128


def source_targets(sizes: DataFrame, weights: list[int], share: float, cap: float) -> DataFrame:
    """sizes: mix_source, mix_source_size. Adds mix_target: shares of the budget by weight, none above cap times its size.

    The fixed point of resharing is found without iterating: with sources in the order of cap / weight, the first
    k are full for the least k at which no later one is above its share of what the k leave.
    """
    by_name = Window.orderBy(F.col("mix_source").isNull(), "mix_source")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("mix_no"), F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("mix_no", F.row_number().over(by_name) - 1).withColumn("mix_weight", weight)
    s = s.withColumn("mix_cap", F.lit(float(cap)) * F.col("mix_source_size"))
    s = s.withColumn("mix_ratio", F.col("mix_cap") / F.col("mix_weight"))
    order = Window.orderBy("mix_ratio", "mix_no")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("mix_budget", F.lit(float(share)) * F.sum("mix_source_size").over(everything))
    s = s.withColumn("mix_level", (F.col("mix_budget") - F.coalesce(F.sum("mix_cap").over(before), F.lit(0.0))) / F.sum("mix_weight").over(on))
    s = s.withColumn("mix_rank", F.row_number().over(order))
    open_ = F.when(F.col("mix_cap") >= F.col("mix_level") * F.col("mix_weight"), F.struct("mix_rank", "mix_level"))
    level = F.min(open_).over(everything)["mix_level"]
    full = F.col("mix_cap")
    s = s.withColumn("mix_target", F.least(full, F.coalesce(level * F.col("mix_weight"), full)))
    return s.select("mix_source", "mix_no", "mix_source_size", "mix_target", F.floor(F.col("mix_budget") + 1e-6).alias("mix_budget"))


def fair_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", quantum: int = QUANTUM) -> tuple[DataFrame, DataFrame]:
    """(queue, mix).

    queue: one row for each row of docs, thin: its id, mix_row, mix_size, mix_source_size, mix_target.
    mix: one row for each copy served: mix_row, mix_copy (from 0), mix_served words, and the mix_finish (virtual finish
    time) and mix_offset (words of the mix before it) of its last packet served. Sort by mix_offset for the mixed order.
    """
    repeats = max(1, -int(-cap // 1))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")))
    thin = docs.select(
        F.col(id_col).alias("mix_id"),
        F.col(source_col).alias("mix_source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("mix_size"),
        key.alias("mix_key"),
        F.monotonically_increasing_id().alias("mix_row"),
    )
    thin = materialize(thin, "mix-sizes")  # mix_row is fixed from here on
    sizes = thin.groupBy("mix_source").agg(F.sum("mix_size").alias("mix_source_size"))
    targets = materialize(source_targets(sizes, list(weights), share, cap), "mix-targets")  # a row a source
    budget = targets.agg(F.max("mix_budget")).first()[0] or 0
    buckets = min(MOST, 1 << max(BUCKETS.bit_length() - 1, (budget // BUCKET_WORDS).bit_length()))
    queue = thin.join(targets.withColumnRenamed("mix_source", "mix_source_"), F.col("mix_source").eqNullSafe(F.col("mix_source_")))
    queue = queue.drop("mix_source_", "mix_budget")
    bucket = F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") / F.lit(2**32 // buckets)).cast("int")
    queue = prefix_sum(queue.withColumn("mix_bucket", bucket), "mix_size", ["mix_key", "mix_size", "mix_row"], "mix_bucket", "mix_before", ["mix_no"])
    queue = materialize(queue.drop("mix_bucket", "mix_key"), "mix-queue")
    for done in (thin, targets):
        delete_path(docs.sparkSession, done._weftline_path)

    packets = queue.filter("mix_size > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    packets = packets.withColumn("mix_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mix_size") - 1, F.lit(quantum).cast("long"))))
    packets = packets.withColumn("mix_words", F.least(F.lit(quantum), F.col("mix_size") - F.col("mix_from")))
    packets = packets.withColumn("mix_end", F.col("mix_copy") * F.col("mix_source_size") + F.col("mix_before") + F.col("mix_from") + F.col("mix_words"))
    packets = packets.withColumn("mix_finish", F.col("mix_end") / F.col("mix_target"))
    # past virtual time 2 the mix is long over: until then every source has sent its target twice, or all it holds
    late = F.least(F.floor(F.col("mix_finish") * buckets), F.lit(2 * buckets)).cast("int")
    packets = packets.select("mix_id", "mix_row", "mix_copy", "mix_size", "mix_words", "mix_finish", "mix_no", "mix_end", late.alias("mix_bucket"))
    # mix_end tells a source's packets apart, so the order is total
    sent = prefix_sum(packets, "mix_words", ["mix_finish", "mix_no", "mix_end"], "mix_bucket", "mix_offset", below=budget)
    sent = sent.withColumn("mix_served", F.least("mix_words", F.lit(budget) - F.col("mix_offset")))
    mix = sent.groupBy("mix_row", "mix_copy").agg(F.first("mix_id").alias("mix_id"), F.sum("mix_served").alias("mix_served"), F.first("mix_size").alias("mix_size"), F.max("mix_finish").alias("mix_finish"), F.max("mix_offset").alias("mix_offset"))
    return queue, mix.select("mix_id", "mix_row", "mix_copy", "mix_served", "mix_size", "mix_finish", "mix_offset")


def mixed_amounts(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: mix_id, mix_size, mix_source_size, mix_target and mix_taken, the words the mix takes."""
    queue, mix = fair_mix(docs, **options)
    taken = mix.groupBy("mix_row").agg(F.sum("mix_served").alias("mix_taken"))
    out = queue.join(taken, "mix_row", "left")
    return out.select("mix_id", "mix_size", "mix_source_size", "mix_target", F.coalesce("mix_taken", F.lit(0)).alias("mix_taken"))
