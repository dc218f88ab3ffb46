"""Documents to token streams, shards and training batches.

The stream's order is that of an explicit key, null keys last; rows that share a key are ordered by a hash of their text, and count
each for itself. A range sort puts rows in that order and adds them up in the same tasks; no text stands under a window. A document is
laid over the shards or rows it covers by exploding their numbers, never by a range join. Texts travel as bytes and become ids, four
times as long, only after the shuffle.

Defined results: a null text is empty (its first token alone); repeated rows are separate documents; an empty table gives an empty
stream; rows are never joined by their key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.byte_vocab import BOS, byte_length, ids_of_bytes
from weftline.operators.prefix import running_sum, whole_div

#: Fragments that a task turns into ids at once.
IDS_ROWS = 128
#: A column that puts documents in order beside their key.
_TIE = "stream_tie"


def _in_stream(docs: DataFrame, key: str, value: str, out: str, below: int | None = None, tie: Column | None = None) -> DataFrame:
    """docs and out, the sum of value over all documents before each."""
    order = [F.col(key).asc_nulls_last(), F.col(_TIE)]
    return running_sum(docs.withColumn(_TIE, F.xxhash64("text") if tie is None else tie), value, order, out, below).drop(_TIE)


def capped_budget(docs: DataFrame, cap: int, max_chars: int, key: str = "doc_id") -> DataFrame:
    """Documents, cut to cap characters, until their total reaches max_chars; the one that crosses it is the last."""
    d = docs.select(key, F.substring("text", 1, cap).alias("text")).withColumn("n", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    return _in_stream(d, key, "n", "before", max_chars).select(key, "text", "n", "before")


def capped_texts(docs: DataFrame, cap: int, max_chars: int, key: str = "doc_id") -> DataFrame:
    """key and text of the rows of capped_budget, in no order. Only keys, hashes and lengths are shuffled and summed, to find the last
    row in the budget; texts are then read once, and those up to it in the order are kept."""
    d = docs.select(key, F.substring("text", 1, cap).alias("text")).withColumn("hash_", F.xxhash64("text"))
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("hash_").alias("hash"))
    thin = d.select(key, "hash_", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n"))
    below = _in_stream(thin, key, "n", "before", max_chars, F.col("hash_")).select(place.alias("place"))
    last = below.agg(F.max("place").alias("last")).first()["last"]
    if last is None:
        return d.select(key, "text").limit(0)
    end = F.struct(F.lit(last["none"]).alias("none"), F.lit(last["key"]).cast(dict(d.dtypes)[key]).alias("key"), F.lit(last["hash"]).alias("hash"))
    # rows equal to the last are alike: one stands for those within the budget
    alike = below.filter(F.col("place") == end).count()
    same = d.filter(place == end).limit(1).withColumn("copy_", F.explode(F.sequence(F.lit(1), F.lit(alike))))
    return d.filter(place < end).select(key, "text").union(same.select(key, "text"))


def token_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens of each document under the byte vocabulary, its BOS included, and bytes a token."""
    n = 1 + byte_length(F.col("text"))
    return docs.select(key, n.alias("n_tokens"), byte_length(F.col("text")).alias("n_bytes"), (byte_length(F.col("text")) / n).alias("ratio"))


def stream_offsets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n, off: where each document's tokens stand in the stream of all."""
    thin = docs.select(key, F.xxhash64("text").alias("hash_"), (1 + byte_length(F.col("text"))).alias("n"))
    return _in_stream(thin, key, "n", "off", tie=F.col("hash_")).select(key, "n", "off")


def shard_fragments(offsets: DataFrame, size: int, key: str = "doc_id", more: tuple[str, ...] = ()) -> DataFrame:
    """A row for each part of a document in a shard: shard k holds stream positions [k size, (k + 1) size)."""
    div = lambda a: whole_div(a, size)
    f = offsets.withColumn("shard_id", F.explode(F.sequence(div(F.col("off")), div(F.col("off") + F.col("n") - 1))))
    first = F.col("shard_id") * size
    start = F.greatest("off", first)
    return f.select("shard_id", split_of(F.col("shard_id")).alias("split"), key, (start - first).alias("start"), (F.least(F.col("off") + F.col("n"), first + size) - start).alias("tokens"), (start - F.col("off")).alias("from_token"), *more)


def split_of(shard_id: Column) -> Column:
    return F.when(shard_id == 0, "val").otherwise("train")


def shard_summary(fragments: DataFrame, key: str = "doc_id") -> DataFrame:
    return fragments.groupBy("shard_id", "split").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("fragments"), F.min(key).alias("first_doc"), F.max(key).alias("last_doc"))


def _cut(first: Column, data: Column, at: Column, n: Column) -> tuple[Column, Column]:
    """(first, data) of n tokens from token at on; first: whether a BOS token precedes the data's bytes."""
    lead = F.when(first, 1).otherwise(0)
    begins = first & (at == 0)
    return begins, F.substring(data, (F.greatest(at - lead, F.lit(0)) + 1).cast("int"), (n - begins.cast("int")).cast("int"))


def with_ids(fragments: DataFrame) -> DataFrame:
    """Fragments of bytes with their ids instead."""
    return fragments.withColumn("ids", ids_of(F.col("first"), F.col("data"))).drop("first", "data")


def ids_of(first: Column, data: Column) -> Column:
    return F.concat(F.when(first, F.array(F.lit(BOS))).otherwise(F.array().cast("array<int>")), ids_of_bytes(data))


def with_ids_in_blocks(fragments: DataFrame) -> DataFrame:
    """with_ids for many long fragments, a block's bytes at once. Their order within a task is kept, though Spark doesn't know it."""
    names = [c for c in fragments.columns if c not in ("first", "data")]
    thick = fragments.select(*names, "first", F.col("data").cast("binary").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, IDS_ROWS):
                b = whole.slice(at, IDS_ROWS)
                data = b.column(b.num_columns - 1).cast(pa.large_binary())
                _, offsets, body = data.buffers()
                offs = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
                begins = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False).astype(bool)
                stops = np.concatenate([[0], np.cumsum(np.diff(offs) + begins)])
                ids = np.full(stops[-1], BOS, np.int32)
                is_byte = np.ones(ids.size, bool)
                is_byte[stops[:-1][begins]] = False
                if body is not None:
                    ids[is_byte] = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]]
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(ids))], names=[*names, "ids"])

    return thick.mapInArrow(run, T.StructType([*thick.schema[:-2], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def byte_fragments(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """shard_id, split, key, start, tokens, first, data: the shards' contents, a row a fragment; data holds a byte for each token but a document's first (BOS)."""
    d = docs.select(key, "text", (1 + byte_length(F.col("text"))).alias("n"))
    rows = _in_stream(d, key, "n", "off").withColumn("data", F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    parts = shard_fragments(rows, size, key, ("data",))
    first, data = _cut(F.lit(True), F.col("data"), F.col("from_token"), F.col("tokens"))
    return parts.select("shard_id", "split", key, "start", "tokens", first.alias("first"), data.alias("data"))


def token_fragments(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """shard_id, split, key, start, ids: the shards' contents, a row a fragment."""
    return with_ids(byte_fragments(docs, size, key)).drop("tokens")


def loader_batches(shards: DataFrame, block: int, ranks: int) -> DataFrame:
    """shards: shard_id, length. The batches each rank reads from each shard: batch_no, and stream positions [first, last].

    block is batch times sequence length. Rank r reads n = max(1, (M - r) div ranks) batches, M being the whole blocks
    of a shard less its last token.
    """
    m = whole_div(F.col("length") - 1, block)
    s = shards.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1)).cast("array<int>")))
    s = s.filter(F.col("length") >= block * (F.col("rank") + 1) + 1)
    s = s.withColumn("n", F.greatest(F.lit(1), whole_div(m - F.col("rank"), ranks)))
    s = s.withColumn("batch_no", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    first = block * (F.col("rank") + F.col("batch_no") * ranks)
    return s.select("shard_id", "rank", "batch_no", first.alias("first"), (first + block).alias("last"))


def check_loader(shards: DataFrame, block: int, ranks: int) -> None:
    """Raises where a shard is too short for some rank."""
    short = shards.filter(F.col("length") < block * ranks + 1).limit(1).count()
    if short:
        raise ValueError(f"a shard has fewer than {block * ranks + 1} tokens, which {ranks} ranks need")


def batch_rows(fragments: DataFrame, batches: DataFrame, block: int, length: int) -> DataFrame:
    """x and y of every row of every batch; y is x one token later.

    fragments: byte_fragments, or such with ids for their first and data. Each row needs length + 1 tokens; fragments are cut over the rows they cover.
    """
    rows = batches.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(block // length - 1))))
    rows = rows.withColumn("slot", whole_div(F.col("first"), length) + F.col("row_no")).drop("first", "last")
    end = F.col("start") + F.col("tokens")
    cover = F.sequence(F.greatest(F.lit(0).cast("long"), whole_div(F.col("start") - 1, length)), whole_div(end - 1, length))
    cut = fragments.withColumn("slot", F.explode(cover))
    lo = F.greatest(F.col("start"), F.col("slot") * length)
    hi = F.least(end, (F.col("slot") + 1) * length + 1)
    if "ids" in fragments.columns:
        part = F.struct(lo.alias("at"), F.slice("ids", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int")).alias("ids"))
    else:
        first, data = _cut(F.col("first"), F.col("data"), lo - F.col("start"), hi - lo)
        part = F.struct(lo.alias("at"), first.alias("first"), data.alias("data"))
    cut = cut.filter(hi > lo).select("shard_id", "slot", part.alias("part"))
    slots = cut.groupBy("shard_id", "slot").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # a row's tokens at most
    out = rows.join(slots, ["shard_id", "slot"]).withColumn("ids", F.flatten(F.transform("parts", lambda p: p["ids"] if "ids" in fragments.columns else ids_of(p["first"], p["data"]))))
    return out.select("shard_id", "rank", "batch_no", "row_no", F.slice("ids", 1, length).alias("x"), F.slice("ids", 2, length).alias("y"))


def next_token_pairs(docs: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """token_id, next_id, n over the whole stream within shards of the given size.

    Pairs inside a fragment come from its bytes and are counted before any shuffle; the pair between two fragments of a shard from their ends.
    """
    f = byte_fragments(docs, size, key)
    ids = f.select(ids_of(F.col("first"), F.col("data")).alias("ids"))
    inside = ids.select(F.explode(F.arrays_zip(F.slice("ids", F.lit(1), F.greatest(F.size("ids") - 1, F.lit(0))).alias("token_id"), F.slice("ids", F.lit(2), F.greatest(F.size("ids") - 1, F.lit(0))).alias("next_id"))).alias("p")).select("p.token_id", "p.next_id")
    byte = lambda at: F.ascii(F.decode(F.substring("data", at, 1), "ISO-8859-1"))
    head, tail = F.when(F.col("first"), F.lit(BOS)).otherwise(byte(1)), F.when(F.length("data") == 0, F.lit(BOS)).otherwise(byte(-1))
    ends = f.select("shard_id", "start", (F.col("start") + F.col("tokens")).alias("stop"), head.alias("next_id"), tail.alias("token_id"))
    # fragments of a shard meet end to start
    between = ends.select("shard_id", "stop", "token_id").join(ends.select("shard_id", F.col("start").alias("stop"), "next_id"), ["shard_id", "stop"]).select("token_id", "next_id")
    return inside.union(between).groupBy("token_id", "next_id").agg(F.count("*").alias("n"))


def resume_after(docs: DataFrame, done: int, key: str = "doc_id") -> DataFrame:
    """Documents at position done and later in the order of the stream."""
    return _in_stream(docs.withColumn("one_", F.lit(1).cast("long")), key, "one_", "seq").filter(F.col("seq") >= done).drop("one_")


def first_rows_joined(docs: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The texts of the first n rows, joined by line feeds."""
    some = docs.orderBy(F.col(key).asc_nulls_last()).limit(n)
    return some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "text"))), lambda x: x["text"]), "\n").alias("text"))
