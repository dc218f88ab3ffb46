"""Packing token sequences with little padding: minimum bin slack over the multiset of remaining lengths.

Every document is encoded, ended with an end-of-document id and cut into full windows, which need no padding,
and a rest shorter than the window. Only lengths matter to the packing of rests, and there are fewer distinct
ones than the window is long, so the multiset of rests is a histogram of bounded size on the driver. Each window
takes the longest length left and then, by a bitset subset-sum dynamic programme over the histogram, the counts
of other lengths that fill it closest to capacity, found by walking back through the stored bitsets. The same
filling is repeated as often as its lengths last. Rests then find their place by their rank within their length,
counted in two levels, so that no length is gathered in one task.

A sequence is padded to the window unless its filling is a power of two.

Defined results: a null text is an empty text, which is the end id alone; repeated rows are packed as separate
documents; very long texts become many pieces; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.encode import default_tokenizer, encoder, text_blocks, text_slices
from weftline.operators.prefix import prefix_sum
from weftline.session import materialize


def encoded_pieces(docs: DataFrame, id_col: str, text_col: str, window: int, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, piece, a number of its own (and ids, little-endian in 32 bits)."""
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, piece long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last in text_blocks(texts):
                out: list[tuple] = []
                for doc_id, ids in zip(doc_ids[first:last], enc.batch(texts[first:last]), strict=True):
                    ids = np.concatenate([ids, end])
                    for at in range(0, ids.size, window):
                        piece = ids[at : at + window]
                        row = (doc_id, at, piece.size, zlib.crc32(piece.tobytes()), ids.size, number)
                        out.append((*row, piece.tobytes()) if with_ids else row)
                        number += 1
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The counts of lengths, within counts, whose sum is the largest not above capacity.

    Bit s of a row is set if some choice among the lengths so far sums to s. Longer lengths come first; the
    table ends early once capacity itself is reached.
    """
    rows, mask, bits = [], (1 << (capacity + 1)) - 1, 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        for _ in range(min(counts[length], capacity // length)):
            wider = (bits | bits << length) & mask
            if wider == bits:
                break
            rows.append((length, bits))
            bits = wider
        if bits >> capacity:
            break
    left, chosen = bits.bit_length() - 1, {}
    for length, before in reversed(rows):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + 1
            left -= length
    return chosen


def plan_windows(histogram: dict[int, int], window: int) -> list[tuple[int, dict[int, int]]]:
    """(times, lengths' counts) of each filling, until the histogram is used up."""
    left, plan = {k: int(n) for k, n in histogram.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        filling = fill_window({k: n for k, n in left.items() if n}, window - longest)
        left[longest] += 1
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[k] // n for k, n in filling.items())
        for k, n in filling.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((times, filling))
    return plan


def placements(plan: list[tuple[int, dict[int, int]]]) -> tuple[pd.DataFrame, int]:
    """For each length and filling, sorted: length, rank_from, per (pieces a sequence), sequence, offset; and the number of sequences."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, filling in plan:
        offset = 0
        for length in sorted(filling, reverse=True):
            rows.append((length, used.get(length, 0), filling[length], sequence, offset))
            used[length] = used.get(length, 0) + filling[length] * times
            offset += length * filling[length]
        sequence += times
    return pd.DataFrame(rows, columns=["length", "rank_from", "per", "sequence", "offset"]).sort_values(["length", "rank_from"], ignore_index=True), sequence


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, tokenizer: str | None = None, with_ids: bool = False, buckets: int = 1024) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, where asked: little-endian
    unsigned numbers of 32 bits, as the checksum takes them)."""
    spark = docs.sparkSession
    pieces = materialize(encoded_pieces(docs, id_col, text_col, window, tokenizer or default_tokenizer(), end_id, with_ids), "packed-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length, of which there are `window`
    full = histogram.pop(window, 0)
    table, sequences = placements(plan_windows(histogram, window))
    if full:
        table = pd.concat([table, pd.DataFrame([(window, 0, 1, sequences, 0)], columns=table.columns)], ignore_index=True)

    keys = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    thin = pieces.drop("ids").withColumn("pack_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).withColumn("pack_one", F.lit(1))
    ranked = prefix_sum(thin, "pack_one", keys, "pack_bucket", "pack_rank", ["length"])
    found = {c: table[c].to_numpy(np.int64) for c in table.columns}
    lengths, steps = np.unique(found["length"]), int(found["rank_from"].max(initial=0)) + 1
    if lengths.size * steps >= 1 << 63:
        raise ValueError("too many pieces for the ranks of one plan")
    shared = spark.sparkContext.broadcast((found, lengths, steps))
    given = [*keys[:2], "length", *keys[2:], "piece"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, piece long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, lengths, steps = shared.value
        # one sorted key finds a length's filling: the length's number, then the rank, whose fillings all begin below `steps`
        starts = np.searchsorted(lengths, t["length"]) * steps + t["rank_from"]
        for b in batches:
            length = b.column("length").to_numpy().astype(np.int64)
            rank = b.column("pack_rank").to_numpy().astype(np.int64)
            i = np.searchsorted(starts, np.searchsorted(lengths, length) * steps + np.minimum(rank, steps - 1), "right") - 1
            over = rank - t["rank_from"][i]
            cols = {c: b.column(c).cast(pa.int64()) for c in given}
            cols |= {"sequence_id": pa.array(t["sequence"][i] + over // t["per"][i]), "offset": pa.array(t["offset"][i] + over % t["per"][i] * length)}
            yield pa.RecordBatch.from_pydict(cols)

    placed = ranked.select(*given, "pack_rank").mapInArrow(place, schema)
    # only now, and outside Python, the ids
    return (placed.join(pieces.select("piece", "ids"), "piece") if with_ids else placed).drop("piece")
