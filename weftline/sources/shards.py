"""Token shards as Parquet, partitioned by split and shard, with an index beside them.

A shard's fragments stand in one file in the order of their start, GROUP of them to a row group. The index has a row for each row group:
its file, its number there, and the first and end token that it holds. A reader that starts at a checkpoint (shard, position) prunes
folders before the shard and, by the end tokens, row groups before the position; lengths of shards come from the index, not from a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.corpus import batch_rows, check_loader, loader_batches, with_ids_in_blocks
from weftline.session import read_folders, small_batches

#: Fragments of a row group.
GROUP = 64


def write_shards(fragments: DataFrame, path: str, files: int | None = None, group: int = GROUP) -> None:
    """fragments: shard_id, split, start and ids, or bytes (corpus.byte_fragments), which become ids after the shuffle. Rows of a shard
    meet in a task, sorted by their start. Tasks put their files in place themselves: nobody reads a path that is not whole."""
    dealt = fragments.repartition(files, "split", "shard_id") if files else fragments.repartition("split", "shard_id")
    rows = with_ids_in_blocks(dealt.drop("tokens")) if "data" in dealt.columns else dealt
    stops = rows.withColumn("stop", F.col("start") + F.size("ids")).sortWithinPartitions("split", "shard_id", "start")
    with small_batches(fragments.sparkSession):
        stops.write.partitionBy("split", "shard_id").option("parquet.block.row.count.limit", str(group)).option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)


def write_index(spark: SparkSession, path: str, group: int = GROUP) -> None:
    """Writes the index of the shards at path, as path-index: split, shard_id, file, row_group, first_token, end_token, fragments."""
    rows = read_folders(spark, path).select("split", "shard_id", "start", "stop", F.col("_metadata.file_name").alias("file"), F.call_function("div", F.col("_metadata.row_index"), F.lit(group)).alias("row_group"))
    made = rows.groupBy("split", "shard_id", "file", "row_group").agg(F.min("start").alias("first_token"), F.max("stop").alias("end_token"), F.count("*").alias("fragments"))
    made.write.parquet(f"{path}-index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}-index")


def shard_lengths(index: DataFrame, split: str | None = None) -> DataFrame:
    """shard_id, length."""
    own = index.filter(F.col("split") == split) if split else index
    return own.groupBy("shard_id").agg(F.max("end_token").cast("long").alias("length"))


def read_after(spark: SparkSession, path: str, shard_id: int, position: int, split: str | None = None) -> DataFrame:
    """Fragments with tokens at or after a position of a shard, and those of later shards, cut nowhere. Of the shard itself only row groups
    that reach beyond the position are read."""
    shards = read_shards(spark, path, split)
    return shards.filter((F.col("shard_id") == shard_id) & (F.col("stop") > position)).unionByName(shards.filter(F.col("shard_id") > shard_id))


def resumed_batches(spark: SparkSession, path: str, shard_id: int, position: int, block: int, ranks: int, length: int, split: str | None = None) -> DataFrame:
    """x and y of the rows of all batches that begin at or after a checkpoint, as corpus.batch_rows gives them for all. A shard too short
    for a rank is an error."""
    lengths = shard_lengths(read_index(spark, path), split).filter(F.col("shard_id") >= shard_id)
    check_loader(lengths, block, ranks)
    batches = loader_batches(lengths, block, ranks).filter((F.col("shard_id") > shard_id) | (F.col("first") >= position))
    fragments = read_after(spark, path, shard_id, position, split).withColumn("tokens", F.size("ids"))
    return batch_rows(fragments, batches, block, length)


def read_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Fragments of the wanted split; the filter prunes folders."""
    shards = read_folders(spark, path)
    return shards.filter(F.col("split") == split) if split else shards


def list_shards(spark: SparkSession, path: str, split: str, *more: Column) -> DataFrame:
    """split, shard_id, length and more aggregates of the shards of a split, to be sorted by shard_id; none is an error. One scan, and a
    look at a row."""
    found = read_shards(spark, path, split)
    if found.select("split").isEmpty():
        raise FileNotFoundError(f"no shard of split {split} in {path}")
    return found.groupBy("split", "shard_id").agg(F.sum(F.col("stop") - F.col("start")).alias("length"), *more)


def shard_name(split, shard_id):
    """A shard's name, its number of six digits."""
    return F.concat(F.lit("tokens_"), split, F.lit("_"), F.lpad(shard_id.cast("string"), 6, "0"))
