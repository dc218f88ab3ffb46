"""Byte-pair tokenizers: splitting, training, encoding, decoding, compression.

Training is greedy and exact: one merge after another, of the most frequent pair, ties going to the least (left, right). Chunks stay in
executors. A round counts the pairs of all distinct chunks, takes the F that come first, and cuts the chunks at all other pairs. Every
merge up to the F-th pair's place happens inside what is left between the cuts: a pair that a merge makes at a cut comes later than the
pair it was cut at, which comes after all F (its count is no greater, and its new token's number is). So the distinct pieces, with their
counts, are all that is needed to make many merges, and F is chosen so that they hold SEGMENTS tokens at most. The driver merges those
and sends each piece's tokens back, by which the executors rewrite their chunks. Memory in the driver depends on SEGMENTS and the
vocabulary, not on the corpus; rounds are a dozen or two for tens of thousands of merges.

Encoding splits texts with Spark, looks up the distinct chunks of a batch in a table, and merges those that it lacks, by rank.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import SPECIALS
from weftline.session import materialize, scratch

#: Fixed value: the pattern that cuts texts into chunks.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
#: Tokens of the pieces that the driver merges in a round, at most, and pairs of the first round.
SEGMENTS, FIRST_PAIRS = 200_000, 32
#: Tokens that a task handles at once, and chunks or tokens of texts that an encoder or a decoder does.
AT_ONCE, TEXTS_AT_ONCE = 1 << 20, 1 << 17
#: Chunks of the table that encoders share, and its longest chunk in bytes.
SHARED, SHARED_BYTES = 100_000, 64
#: Chunks whose ids a task remembers, each of SHARED_BYTES characters at most.
REMEMBERED = 1 << 17


def chunks(text: Column) -> Column:
    """array<string> of a text's chunks, which join to the text. (?U) gives Java's classes their Unicode meaning."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(chunks(F.col(text))).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


Pair = tuple[int, int]


def greedy_merges(words: list[tuple[list[int], int]], first: int, most: int, last: tuple[int, Pair] | None = None) -> list[Pair]:
    """The pairs merged, at most so many, in order; the words' token lists are rewritten. New tokens count from `first`. With last,
    (-count, pair), the merges end before a pair that comes after it."""
    pairs: Counter = Counter()
    where: dict[Pair, set[int]] = defaultdict(set)
    for i, (ids, n) in enumerate(words):
        for p in pairwise(ids):
            pairs[p] += n
            where[p].add(i)
    heap = [(-n, p) for p, n in pairs.items()]
    heapq.heapify(heap)
    made: list[Pair] = []
    while len(made) < most and heap:
        n, pair = heapq.heappop(heap)
        if pairs.get(pair) != -n or not n:
            continue
        if last is not None and (n, pair) > last:
            break
        new = first + len(made)
        made.append(pair)
        touched = set()
        for i in where.pop(pair):
            ids, k = words[i]
            for p in pairwise(ids):
                pairs[p] -= k
                touched.add(p)
            ids[:] = merged(ids, pair, new)
            for p in pairwise(ids):
                pairs[p] += k
                where[p].add(i)
                touched.add(p)
        for p in touched:
            if pairs[p] > 0:
                heapq.heappush(heap, (-pairs[p], p))
            else:
                pairs.pop(p, None)
    return made


def merged(ids: list[int], pair: Pair, new: int) -> list[int]:
    """The ids with each occurrence of the pair, from the left, as one."""
    out, at = [], 0
    while at < len(ids):
        if at + 1 < len(ids) and (ids[at], ids[at + 1]) == pair:
            out.append(new)
            at += 2
        else:
            out.append(ids[at])
            at += 1
    return out


def _wanted(vocab_size: int) -> int:
    """Tokens that are not special."""
    if vocab_size - len(SPECIALS) < 256:
        raise ValueError(f"a vocabulary needs {256 + len(SPECIALS)} tokens at least")
    return vocab_size - len(SPECIALS)


def _ranks(merges: list[Pair]) -> dict[bytes, int]:
    tokens = [bytes([b]) for b in range(256)]
    for a, b in merges:
        tokens.append(tokens[a] + tokens[b])
    return {t: i for i, t in enumerate(tokens)}


def merge_pairs(counts: dict[str, int], vocab_size: int) -> dict[bytes, int]:
    """Ranks of vocab_size - len(SPECIALS) tokens, the 256 bytes first, from counted chunks that one process holds."""
    wanted = _wanted(vocab_size)
    return _ranks(greedy_merges([(list(w.encode()), n) for w, n in sorted(counts.items())], 256, wanted - 256))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids of many words one after another, the words' ends, and their counts; AT_ONCE ids or so at a time."""

    def joined(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words = pa.chunked_array([b.column(0) for b in held]).cast(pa.large_binary()).combine_chunks()
        _, offsets, data = words.buffers()
        offs = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        ids = np.frombuffer(data, np.int32, (offs[-1] - offs[0]) // 4, offs[0]) if len(words) and data else np.zeros(0, np.int32)
        return ids, (offs[1:] - offs[0]) // 4, np.concatenate([b.column(1).to_numpy() for b in held])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(0).nbytes // 4
        if size >= AT_ONCE:
            yield joined(held)
            held, size = [], 0
    if held:
        yield joined(held)


def _pair_keys(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each id and the next, -1 at the end of a word."""
    keys = np.full(ids.size, -1, np.int64)
    keys[:-1] = (ids[:-1].astype(np.int64) << 32) | ids[1:]
    keys[ends[ends > 0] - 1] = -1
    return keys


def _words(counted: DataFrame) -> DataFrame:
    """ids (32-bit, one for each byte) and n of counted chunks that have a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [np.frombuffer(c, np.uint8).astype(np.int32).tobytes() for c in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), b.column(1)], names=["ids", "n"])

    return counted.select(F.encode("chunk", "UTF-8").alias("ids"), "n").filter("length(ids) > 1").mapInArrow(run, "ids binary, n long")


def _first_pairs(words: DataFrame, most: int) -> list[tuple[int, int]]:
    """(key, count) of the pairs that come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, n in _blocks(batches):
            keys = _pair_keys(ids, ends)
            weight = np.repeat(n, np.diff(ends, prepend=0))
            inside = keys >= 0
            found, which = np.unique(keys[inside], return_inverse=True)
            counts = np.zeros(found.size, np.int64)
            np.add.at(counts, which, weight[inside])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], names=["key", "n"])

    counted = words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return [(r["key"], r["n"]) for r in counted.orderBy(F.desc("n"), "key").limit(most).collect()]  # at most the vocabulary's size


def _links(ids: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of two ids or more between pairs that are not in first, which is sorted."""
    keys = _pair_keys(ids, ends)
    at = np.searchsorted(first, keys)
    at[at == first.size] = 0
    link = first[at] == keys
    before = np.zeros(link.size, bool)
    before[1:] = link[:-1]
    return np.flatnonzero(link & ~before), np.flatnonzero(~link & before) + 1


def _segments(words: DataFrame, first: np.ndarray) -> DataFrame:
    """ids and n of the distinct pieces."""
    shared = words.sparkSession.sparkContext.broadcast(np.sort(first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, ends, n in _blocks(batches):
            starts, stops = _links(ids, ends, shared.value)
            weight = n[np.searchsorted(ends, starts, "right")]
            found: dict[bytes, int] = defaultdict(int)
            for a, b, k in zip(starts.tolist(), stops.tolist(), weight.tolist(), strict=True):
                found[ids[a:b].tobytes()] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["ids", "n"])

    return words.mapInArrow(run, "ids binary, n long").groupBy("ids").agg(F.sum("n").alias("n"))


def _rewritten(words: DataFrame, first: np.ndarray, pieces: dict[bytes, bytes]) -> DataFrame:
    """Words with their pieces' new ids, without those that have become one token."""
    shared = words.sparkSession.sparkContext.broadcast((np.sort(first), pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = shared.value
        for ids, ends, n in _blocks(batches):
            out, gone = ids.copy(), np.zeros(ids.size + 1, np.int64)
            starts, stops = _links(ids, ends, known)
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                new = np.frombuffer(told[ids[a:b].tobytes()], np.int32)
                out[a : a + new.size] = new
                gone[a + new.size] += 1
                gone[b] -= 1
            kept = np.cumsum(gone[:-1]) == 0
            offs = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]
            words_ = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.astype(np.int64) * 4), pa.py_buffer(out[kept])]).cast(pa.binary())
            going = pa.array(np.diff(offs) > 1)
            yield pa.RecordBatch.from_arrays([words_.filter(going), pa.array(n).filter(going)], names=["ids", "n"])

    return words.mapInArrow(run, "ids binary, n long")


def train_bpe(docs: DataFrame, vocab_size: int, segments: int | None = None) -> dict[bytes, int]:
    """Ranks as merge_pairs gives them, fewer if there are no more pairs, merged round by round over the chunks in executors."""
    wanted, segments = _wanted(vocab_size) - 256, segments or SEGMENTS
    spark = docs.sparkSession
    made: list[Pair] = []
    with scratch(spark):
        words = materialize(_words(chunk_counts(docs)), "bpe-words")
        most = FIRST_PAIRS
        while len(made) < wanted:
            top = _first_pairs(words, min(most, wanted))
            if not top:
                break
            while True:
                keys = np.array([k for k, _ in top], np.int64)
                found = materialize(_segments(words, keys), "bpe-pieces")
                size = found.agg(F.sum(F.length("ids"))).first()[0] // 4
                if size <= segments or len(top) == 1:
                    break
                top = top[: len(top) * 2 // 3]
            rows = found.collect()  # `segments` ids at most
            pieces = [(np.frombuffer(r["ids"], np.int32).tolist(), r["n"]) for r in rows]
            key, n = top[-1]
            made += greedy_merges(pieces, 256 + len(made), wanted - len(made), (-n, (key >> 32, key & 0xFFFFFFFF)))
            told = {bytes(r["ids"]): np.array(ids, np.int32).tobytes() for r, (ids, _) in zip(rows, pieces, strict=True)}
            if len(made) < wanted:
                words = materialize(_rewritten(words, keys, told), "bpe-words")
            most = int(len(top) * min(3.0, max(1.2, 0.8 * segments / max(size, 1)))) + 1 if size < 0.6 * segments else len(top)
    return _ranks(made)


def vocabulary(spark: SparkSession, ranks: dict[bytes, int], specials_first: bool = False) -> DataFrame:
    """token_id, bytes, is_special, special, n_bytes (of the decoded token, malformed parts being U+FFFD; 0 for specials), raw_bytes.
    The special tokens' ids follow the others', or come before them."""
    shift, start = (len(SPECIALS), 0) if specials_first else (0, len(ranks))
    rows = [(i + shift, bytearray(t), False, None, len(t.decode(errors="replace").encode()), len(t)) for t, i in ranks.items()]
    rows += [(start + i, None, True, s, 0, 0) for i, s in enumerate(SPECIALS)]
    return spark.createDataFrame(rows, "token_id int, bytes binary, is_special boolean, special string, n_bytes int, raw_bytes int")


def save_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.coalesce(1).write.parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A saved vocabulary; its ids must be 0 to n - 1, once each."""
    vocab = spark.read.parquet(path)
    n, kinds, least, most = vocab.agg(F.count("*"), F.countDistinct("token_id"), F.min("token_id"), F.max("token_id")).first()
    if not n or (kinds, least, most) != (n, 0, n - 1):
        raise ValueError(f"{path} holds no vocabulary")
    return vocab


def ranks_of(vocab: DataFrame) -> dict[bytes, int]:
    """Ranks from a vocabulary table, such as one read back from Parquet: a row a token. Specials may come first."""
    rows = vocab.filter("not is_special").select("bytes", "token_id").collect()
    least = min((r["token_id"] for r in rows), default=0)
    return {bytes(r["bytes"]): r["token_id"] - least for r in rows}


def special_id(vocab: DataFrame, name: str) -> int:
    """The id of a special token, by its exact name."""
    found = vocab.filter(F.col("is_special") & (F.col("special") == name)).select("token_id").first()
    if found is None:
        raise KeyError(f"{name} is no special token of the vocabulary")
    return found[0]


def begin_id(vocab: DataFrame) -> int:
    """The id that begins a text: that of the first special token, or where a vocabulary lacks it, of <|endoftext|>."""
    for name in (SPECIALS[0], "<|endoftext|>"):
        found = vocab.filter(F.col("is_special") & (F.col("special") == name)).select("token_id").first()
        if found is not None:
            return found[0]
    raise KeyError("the vocabulary has no token that begins a text")


def encode_chunk(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a chunk: the neighbours whose join has the least rank are merged first, from the left. Parts are a linked list of start
    positions, and possible merges stand in a heap, so a chunk of n bytes takes n log n steps."""
    if (whole := ranks.get(data)) is not None:
        return [whole]
    n = len(data)
    after = list(range(1, n + 1))  # where the part that begins here ends
    before = list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        # the two parts from i are still those that were to end there
        if not alive[i] or after[i] >= end or after[after[i]] != end:
            continue
        alive[after[i]] = 0
        after[i] = end
        if end < n:
            before[end] = i
            if (r := ranks.get(data[i : after[end]])) is not None:
                heapq.heappush(heap, (r, i, after[end]))
        if (left := before[i]) >= 0 and (r := ranks.get(data[left:end])) is not None:
            heapq.heappush(heap, (r, left, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : after[i]]])
        i = after[i]
    return out


class Joins(NamedTuple):
    """Which two tokens join to a third, as arrays: the tokens of single bytes, the ranks of pairs of bytes, and of other pairs by a sorted key."""

    single: np.ndarray
    of_bytes: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray


#: The rank of a pair that does not join.
NEVER = (1 << 31) - 1


def joins(ranks: dict[bytes, int]) -> Joins:
    """Every way to cut a token of two bytes or more into two tokens."""
    cuts = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
    of_bytes = np.full(1 << 16, NEVER, np.int64)
    for t, r in ranks.items():
        if len(t) == 2:
            of_bytes[t[0] << 8 | t[1]] = r
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
    return Joins(single, of_bytes, np.array([k for k, _ in cuts], np.int64), np.array([r for _, r in cuts], np.int64))


def encode_chunks(chunks: list[bytes], ranks: dict[bytes, int], table: Joins) -> list[list[int]]:
    """encode_chunk of many chunks. Short ones are merged side by side: a round makes one merge in each that has any left."""
    out: list[list[int]] = [[] for _ in chunks]
    short = []
    for i, c in enumerate(chunks):
        if (whole := ranks.get(c)) is not None:
            out[i] = [whole]
        elif 0 < len(c) <= SHARED_BYTES:
            short.append(i)
        else:
            out[i] = encode_chunk(c, ranks)
    if not short:
        return out
    data = np.frombuffer(b"".join(chunks[i] for i in short), np.uint8)
    word, size = np.array(short), np.array([len(chunks[i]) for i in short], np.int64)
    ids = table.single[data]
    if ids.min() < 0:
        raise KeyError("the vocabulary lacks a byte")
    # a place's rank is that of its token joined to the next one
    rank = np.full(ids.size, NEVER, np.int64)
    rank[:-1] = table.of_bytes[data[:-1].astype(np.int64) << 8 | data[1:]]
    stops = np.cumsum(size)
    rank[stops - 1] = NEVER
    while word.size:
        starts = stops - size
        least = np.minimum.reduceat(rank << 32 | np.arange(ids.size), starts)
        going = least >> 32 < NEVER
        if not going.all():
            for i, a, b in zip(word[~going].tolist(), starts[~going].tolist(), stops[~going].tolist(), strict=True):
                out[i] = ids[a:b].tolist()
        kept = np.repeat(going, size)
        at = least[going] & 0xFFFFFFFF
        ids[at] = rank[at]
        kept[at + 1] = False
        # where the kept ones come to stand
        at = np.cumsum(kept)[at] - 1
        ids, rank = ids[kept], rank[kept]
        word, size = word[going], size[going] - 1
        stops = np.cumsum(size)
        starts = stops - size
        for place in (at[at > starts] - 1, at[at < stops - 1]):
            key = ids[place] << 32 | ids[place + 1]
            found = np.minimum(np.searchsorted(table.keys, key), table.keys.size - 1)
            rank[place] = np.where(table.keys[found] == key, table.ranks[found], NEVER)
        rank[stops - 1] = NEVER
    return out


def chunk_dictionary(docs: DataFrame, ranks: dict[bytes, int], text: str = "text") -> DataFrame:
    """chunk, n, ids: every distinct chunk, encoded once."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, joins(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = encode_chunks([c.encode() for c in b.column(0).to_pylist()], *shared.value)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=["chunk", "n", "ids"])

    return chunk_counts(docs, text).mapInArrow(run, "chunk string, n long, ids array<int>")


def frequent(dictionary: DataFrame) -> dict[str, list[int]]:
    """The most frequent chunks of a dictionary and their ids: SHARED entries of SHARED_BYTES bytes at most, which encoders can share."""
    rows = dictionary.filter(F.octet_length("chunk") <= SHARED_BYTES).orderBy(F.desc("n"), "chunk").limit(SHARED).collect()
    return {r["chunk"]: r["ids"] for r in rows}


def _carried(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{c}` {t}, " for c, t in df.select(*names).dtypes)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches whose last column, of lists, has TEXTS_AT_ONCE elements at most, or which are one row."""
    for b in batches:
        ends = np.cumsum(b.column(b.num_columns - 1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXTS_AT_ONCE, "right")))
            yield b.slice(at, stop - at)
            at = stop


def encode(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", text: str = "text", prepend: int | None = None, append: int | None = None, keep: tuple[str, ...] = (), known: dict[str, list[int]] | None = None) -> DataFrame:
    """key, the columns in keep, ids. Special tokens' names in a text are ordinary text; a null text is empty. Rows stay rows, whatever their keys.
    known (of `frequent`): chunks that are not encoded anew. No text is shuffled; of the rest, a task
    remembers REMEMBERED at most, so that it encodes few twice."""
    if dict(docs.dtypes)[text] != "string":
        raise ValueError("only strings are encoded")
    shared = docs.sparkSession.sparkContext.broadcast((ranks, joins(ranks), known or {}))
    before, after = [prepend] if prepend is not None else [], [append] if append is not None else []
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, pairs, told = shared.value
        held: dict[str, list[int]] = {}
        for b in _few(batches):
            lists = b.column(b.num_columns - 1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            coded = lists.flatten().dictionary_encode()
            found = coded.dictionary.to_pylist()
            new = [told.get(c) or held.get(c) for c in found]
            lacking = [i for i, x in enumerate(new) if x is None]
            if len(held) + len(lacking) > REMEMBERED:
                held.clear()
            for i, x in zip(lacking, encode_chunks([found[i].encode() for i in lacking], table, pairs), strict=True):
                new[i] = x
                if len(found[i]) <= SHARED_BYTES:
                    held[found[i]] = x
            sizes = np.array([len(i) for i in new], np.int64)
            flat, begin = np.array([x for i in new for x in i], np.int32), np.cumsum(sizes) - sizes
            which = coded.indices.to_numpy()
            n = sizes[which]
            stop = np.concatenate([[0], np.cumsum(n)])
            ids = flat[np.repeat(begin[which] - stop[:-1], n) + np.arange(stop[-1])] if stop[-1] else flat[:0]
            offs = stop[ends]
            for value, side in ((before, slice(0, -1)), (after, slice(1, None))):
                if value:
                    ids = np.insert(ids, offs[side], value[0])
                    offs = offs + np.arange(offs.size)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))], names=[*names, "ids"])

    return docs.select(*names, chunks(F.coalesce(text, F.lit(""))).alias("chunks__")).mapInArrow(run, _carried(docs, names) + "ids array<int>")


def encode_joined(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids as encode gives them, from a dictionary that has every chunk: places of chunks are joined to it and gathered again by row.
    Nothing is encoded, but every chunk's place is shuffled; for dictionaries that come from elsewhere."""
    rows = materialize(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row_no"), chunks(F.coalesce(text, F.lit(""))).alias("chunks")), "chunks")
    placed = rows.select("row_no", F.posexplode("chunks").alias("place", "chunk"))
    found = placed.join(dictionary.select("chunk", "ids"), "chunk", "left").withColumn("ids", F.coalesce("ids", F.raise_error(F.lit("a chunk is not in the dictionary")).cast("array<int>")))
    texts = found.groupBy("row_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda x: x["ids"])).alias("ids"))  # a text's chunks
    return rows.select("key", "row_no").join(texts, "row_no", "left").select(F.col("key").alias(key), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(rows: DataFrame, vocab: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), out: str = "text") -> DataFrame:
    """key, the columns in keep, and the text: the tokens' bytes joined, malformed UTF-8 as U+FFFD; specials decode to their names, null ids to
    nothing. One pass over the rows with the vocabulary's bytes, which the driver and every worker hold."""
    told = {r["token_id"]: bytes(r["bytes"]) if r["bytes"] is not None else r["special"].encode() for r in vocab.select("token_id", "bytes", "special").collect()}  # a row a token
    shared = rows.sparkSession.sparkContext.broadcast(told)
    names = [key, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value.__getitem__
        for b in _few(batches):
            texts = [b"".join(map(look, ids or ())).decode(errors="replace") for ids in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], names=[*names, out])

    return rows.select(*names, F.col("ids").alias("ids__")).mapInArrow(run, _carried(rows, names) + f"`{out}` string")


def compression(docs: DataFrame, ranks: dict[bytes, int], key: str = "doc_id", known: dict[str, list[int]] | None = None) -> DataFrame:
    """key, bytes, tokens, ratio of each row of docs."""
    sized = docs.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return encode(sized, ranks, key, keep=("bytes",), known=known).select(key, "bytes", F.size("ids").cast("long").alias("tokens")).withColumn("ratio", F.try_divide("bytes", "tokens"))


def comparison(rows: DataFrame, key: str, ours: str = "our_tokens", base: str = "base_tokens", size: str = "bytes") -> DataFrame:
    """rows: a row a text with its size and its tokens in two tokenizers. key, both token counts and ratios, relative_diff in percent of the
    base's tokens (positive: ours has fewer), better."""
    j = rows.select(key, F.col(ours).alias("our_tokens"), F.try_divide(size, ours).alias("our_ratio"), F.col(base).alias("base_tokens"), F.try_divide(size, base).alias("base_ratio"))
    better = F.when(F.col("base_ratio") > F.col("our_ratio"), "Base").when(F.col("our_ratio") > F.col("base_ratio"), "Ours").otherwise("Tie")
    return j.withColumn("relative_diff", F.try_divide(F.col("base_tokens") - F.col("our_tokens"), F.col("base_tokens")) * 100).withColumn("better", better)


def token_byte_stats(vocab: DataFrame) -> DataFrame:
    """Count, least, most, mean and sample deviation of the positive n_bytes."""
    v = vocab.filter("n_bytes > 0")
    return v.agg(F.count("*").alias("n"), F.min("n_bytes").alias("min_bytes"), F.max("n_bytes").alias("max_bytes"), F.avg("n_bytes").alias("mean_bytes"), F.stddev_samp("n_bytes").alias("std_bytes"))
