"""Documents as a stream, cut into token shards batch by batch, with a ledger that makes resuming exact.

Each micro-batch takes the ledger's next stream offset, lays its documents after it in the order of their key, and
writes its fragments and its ledger entry under its own batch id. A batch that runs again overwrites what it
wrote before with the same rows, so every document counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.corpus import shard_fragments, stream_offsets
from weftline.operators.prefix import range_buckets
from weftline.session import new_path, ship


def _is_directory(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory()


def document_stream(spark: SparkSession, folder: str, name: str = "documents.parquet", files_a_batch: int = 4) -> DataFrame:
    ship(spark)
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    if _is_directory(spark, f"{folder}/{name}"):
        return reader.parquet(f"{folder}/{name}")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_ordered(docs: DataFrame, out: str, size: int, goes: int, key: str = "doc_id") -> None:
    """All documents as a stream that arrives in the order of their key, in some goes: a file source takes files by their time, whatever keys
    they hold, so the documents are dealt into ranges of the key, and each range's files are moved into the watched folder when
    the ranges before it have been processed."""
    spark = docs.sparkSession
    staged, watched = new_path(spark, "staged"), new_path(spark, "watched")
    # rows without a key, which come last, are not parted
    dealt = range_buckets(docs, key, "go", buckets=goes)
    dealt.write.partitionBy("go").parquet(staged)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(watched))
    ranges = sorted((s.getPath().getName() for s in files.listStatus(path(staged)) if s.isDirectory()), key=lambda n: int(n.split("=")[1]))
    if not ranges:  # an empty table is one empty go
        docs.limit(0).write.parquet(f"{staged}/go=0")
    for name in ranges or ["go=0"]:
        files.rename(path(f"{staged}/{name}"), path(f"{watched}/{name}"))
        run_token_stream(spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(watched), out, size, key)


def run_token_stream(stream: DataFrame, out: str, size: int, key: str = "doc_id") -> None:
    """Processes all that the stream has now, then stops; called again, it goes on where it stopped."""
    spark = stream.sparkSession

    def batch(docs: DataFrame, batch_id: int) -> None:
        entry = spark.read.schema("batch_id long, next_offset long").json(f"{out}/ledger/*") if batch_id else None
        base = entry.filter(F.col("batch_id") < batch_id).agg(F.max("next_offset")).first()[0] or 0 if entry is not None else 0
        offsets = stream_offsets(docs, key).withColumn("off", F.col("off") + F.lit(base))
        shard_fragments(offsets, size, key).write.mode("overwrite").parquet(f"{out}/fragments/batch={batch_id}")
        end = spark.read.parquet(f"{out}/fragments/batch={batch_id}").agg(F.coalesce(F.max(F.col("shard_id") * size + F.col("start") + F.col("tokens")), F.lit(base)).alias("next_offset"))
        end.select(F.lit(batch_id).cast("long").alias("batch_id"), "next_offset").coalesce(1).write.mode("overwrite").json(f"{out}/ledger/batch={batch_id}")

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def streamed_fragments(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/fragments").parquet(f"{out}/fragments").drop("batch")
