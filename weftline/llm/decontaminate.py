"""Benchmark decontamination: suffix arrays over the training texts, searched for every suffix of every test item.

Training texts are taken in shards of a few megabytes, as the scan gives them. A shard's words, as 64-bit hashes, get a suffix array:
positions sorted by the words that follow them in their text, by prefix doubling, as deep as the longest test item is (no search looks
further; deeper ties stay as they fall). Every suffix of every test item is then found by binary search, all of them at once, one word
deeper each time: the interval of the array narrows until no training suffix goes on alike, which gives the longest verbatim match and
all its places. The interval at the depth of a window (10 words, or a shorter item whole) holds the window's occurrences; the training
words inside them are hit, and a text with a hit is affected.

A training text lies in one shard whole, so its result is made in one task and nothing of it is shuffled. Test items travel to the tasks
in passes of at most PASS_BYTES, each a broadcast of that size checked before (one longer item makes a pass of its own); the next pass
reads the texts again. Items are known by their ids as text: rows that share an id are one item whose texts all count.

Defined results: null and empty texts have no words and no hit; an item without words has no window; a null id counts as an item with
the empty id; repeated training rows are rows each; a very long text is a shard of its own; empty tables give no rows, or rows without
hits; other columns pass through if kept. Words are the same if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import map_text
from weftline.llm.encode import release
from weftline.llm.words import Words, blocks
from weftline.session import materialize

WINDOW = 10
SHARD_BYTES, PASS_BYTES = 4 << 20, 16 << 20
#: Pairs of a window's text and an item that are made at once.
AT_ONCE = 1 << 22

#: Bytes that no word holds: all of ASCII but letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Items:
    """Test items: their words one after another, where each word's item ends, and each word's item."""

    words: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    ids: list[str]
    window: int

    @classmethod
    def of(cls, rows: list[tuple[str, str]], window: int) -> Items:
        ids = sorted({i for i, _ in rows})
        number = {i: k for k, i in enumerate(ids)}
        words, ends, item, base = [], [], [], 0
        for first, last, raw, offs in blocks(pa.array([t for _, t in rows], pa.string())):
            w = Words(raw, offs, BETWEEN)
            counts = np.diff(w.first)
            words.append(w.hashes(lower=True))
            ends.append(np.repeat(w.first[1:], counts) + base)
            item.append(np.repeat([number[i] for i, _ in rows[first:last]], counts))
            base += w.start.size
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return cls(join(words, np.uint64), join(ends, np.int64), join(item, np.int64), ids, window)

    def depth(self) -> int:
        starts = np.flatnonzero(np.diff(self.ends, prepend=-1))
        return int((self.ends[starts] - starts).max(initial=0))

    def windows(self) -> np.ndarray:
        """The length of the window that begins at each word, 0 if none does."""
        starts = np.flatnonzero(np.diff(self.ends, prepend=-1))
        whole = np.repeat(self.ends[starts] - starts, self.ends[starts] - starts)
        left = self.ends - np.arange(self.ends.size)
        return np.where(whole < self.window, np.where(left == whole, whole, 0), np.where(left >= self.window, self.window, 0))


def suffix_array(words: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the words from each on, up to the end of its text, as far as `depth` words tell them apart."""
    n = words.size
    order = np.argsort(words)
    if n < 2 or depth < 2:
        return order
    new = np.empty(n, bool)
    new[0] = True
    sorted_words = words[order]
    np.not_equal(sorted_words[1:], sorted_words[:-1], out=new[1:])
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=n)
    rank = np.empty(n, np.int64)  # of a position: the first place of its group, from 1
    rank[order] = np.repeat(starts + 1, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of groups not told apart yet
    done = 1
    while done < depth and slots.size:
        at = order[slots]
        after = at + done
        inside = after < ends[at]
        key = (rank[at] << 32) | np.where(inside, rank[np.minimum(after, n - 1)], 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.empty(at.size, bool)
        new[0] = True
        np.not_equal(key[1:], key[:-1], out=new[1:])
        starts = np.flatnonzero(new)
        sizes = np.diff(starts, append=at.size)
        rank[at] = np.repeat(slots[starts] + 1, sizes)
        # texts that end together stay equal
        going = np.repeat((sizes > 1) & ((key[starts] & 0xFFFFFFFF) > 0), sizes)
        slots = slots[going]
        done *= 2
    return order


@dataclass
class Found:
    """Of each test word as the start of a suffix: the longest match, and the intervals of the suffix array with that match and with the window."""

    longest: np.ndarray
    low: np.ndarray
    high: np.ndarray
    window_low: np.ndarray
    window_high: np.ndarray


def _bound(words: np.ndarray, ends: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, target: np.ndarray, right: bool) -> np.ndarray:
    """In each interval the first place whose suffix has, at `depth`, a word not below the target (right: above it); an ended text is below all."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while open_.size:
        mid = (low[open_] + high[open_]) >> 1
        at = order[mid]
        p = at + depth
        ended = p >= ends[at]
        word = words[np.minimum(p, words.size - 1)]
        below = ended | ((word <= target[open_]) if right else (word < target[open_]))
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]
        open_ = open_[low[open_] < high[open_]]
    return low


def search(words: np.ndarray, ends: np.ndarray, order: np.ndarray, items: Items) -> Found:
    """Every suffix of every item in the suffix array, by binary search one word deeper at a time."""
    first = words[order]
    low, high = np.searchsorted(first, items.words), np.searchsorted(first, items.words, "right")
    longest = (low < high).astype(np.int64)
    windows = items.windows()
    window_low, window_high = np.zeros_like(low), np.zeros_like(low)
    live, depth = np.flatnonzero(longest), 1
    while live.size:
        at = live[windows[live] == depth]
        window_low[at], window_high[at] = low[at], high[at]
        live = live[live + depth < items.ends[live]]
        target = items.words[live + depth]
        a = _bound(words, ends, order, low[live], high[live], depth, target, False)
        b = _bound(words, ends, order, a, high[live], depth, target, True)
        going = a < b
        live, depth = live[going], depth + 1
        low[live], high[live], longest[live] = a[going], b[going], depth
    return Found(longest, low, high, window_low, window_high)


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of intervals, and the interval of each."""
    sizes = high - low
    which = np.repeat(np.arange(low.size), sizes)
    return np.arange(which.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def shard_hits(w: Words, words: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which words of the shard are hit, and distinct (text, item) pairs, sorted; then the suffix array and what was found."""
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(counts.size), counts)
    ends = np.repeat(w.first[1:], counts)
    order = suffix_array(words, ends, items.depth())
    found = search(words, ends, order, items)
    tests = np.flatnonzero(found.window_low < found.window_high)
    if not tests.size:
        return np.zeros(words.size, bool), np.zeros((0, 2), np.int64), order, found
    # the same window in several items has the same interval
    length = items.windows()[tests]
    keys, which = np.unique(found.window_low[tests] * (items.window + 1) + length, return_inverse=True)
    example = np.zeros(keys.size, np.int64)
    example[which] = tests
    places, window = _spread(found.window_low[example], found.window_high[example])
    at = order[places]
    step = np.bincount(at, minlength=words.size + 1) - np.bincount(at + (keys % (items.window + 1))[window], minlength=words.size + 1)
    hit = np.cumsum(step[:-1]) > 0

    texts = np.unique(window * counts.size + owner[at])  # distinct (window, text)
    held = np.unique(which * len(items.ids) + items.item[tests])  # distinct (window, item)
    held_window, held_item = held // len(items.ids), held % len(items.ids)
    begin = np.searchsorted(held_window, np.arange(keys.size + 1))
    much = np.cumsum((begin[1:] - begin[:-1])[texts // counts.size])
    pairs, done = [], 0
    while done < texts.size:
        to = max(done + 1, int(np.searchsorted(much, (much[done - 1] if done else 0) + AT_ONCE, "right")))
        part = texts[done:to] // counts.size
        at, of = _spread(begin[part], begin[part + 1])
        pairs.append(np.unique((texts[done:to] % counts.size)[of] * len(items.ids) + held_item[at]))
        done = to
    both = np.unique(np.concatenate(pairs))
    return hit, np.stack([both // len(items.ids), both % len(items.ids)], 1), order, found


def _spans(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the stretches of hit words, none crossing texts."""
    edge = np.zeros(hit.size + 1, bool)
    edge[first] = True
    before, after = np.zeros(hit.size, bool), np.zeros(hit.size, bool)
    before[1:], after[:-1] = hit[:-1], hit[1:]
    start = np.flatnonzero(hit & (~before | edge[:-1]))
    end = np.flatnonzero(hit & (~after | edge[1:])) + 1
    text = np.searchsorted(first, start, "right") - 1
    return text, start - first[text], end - first[text]


def _passes(items: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Items]:
    """The items in passes of about PASS_BYTES; each is collected alone. At least one, which may be empty."""
    own = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).distinct()
    total = own.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    if total <= PASS_BYTES:
        yield Items.of([tuple(r) for r in own.collect()], window)  # PASS_BYTES at most
        return
    parts = -(-2 * total // PASS_BYTES)
    dealt = materialize(own.withColumn("pass", F.pmod(F.xxhash64("id", "text"), F.lit(parts))), "items")
    for k in range(parts):
        yield Items.of([tuple(r) for r in dealt.filter(F.col("pass") == k).select("id", "text").collect()], window)  # about PASS_BYTES / 2


def _union_size(spans: Column) -> Column:
    """Words that spans cover, overlaps once."""
    more = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["reached"], x["first"]))).alias("n"), F.greatest(s["reached"], x["end"]).alias("reached"))
    zero = F.lit(0).cast("long")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("n"), zero.alias("reached")), more, lambda s: s["n"])


def contamination(docs: DataFrame, keep: list[Column | str], text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The kept columns, n_words, n_hit, hit_spans (array of first and end word; stretches of one pass are apart) and items (ids as text,
    sorted) of each training text."""
    spark = docs.sparkSession
    span = "array<struct<first:long,end:long>>"
    out = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("t"), F.array().cast(span).alias("hit_spans"), F.array().cast("array<string>").alias("items"))
    for block in _passes(items, item_id, item_text, window):
        shared = spark.sparkContext.broadcast(block)

        def compute(texts: pa.Array, shared=shared) -> Iterator[tuple[int, int, list[pa.Array]]]:
            known = shared.value
            names = pa.array(known.ids, pa.string())
            for first, last, raw, offs in blocks(texts, SHARD_BYTES):
                w = Words(raw, offs, BETWEEN)
                hit, pairs, _, _ = shard_hits(w, w.hashes(lower=True), known)
                owner, start, end = _spans(hit, w.first)
                rows = np.arange(last - first + 1)
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["first", "end"])
                lists = [pa.ListArray.from_arrays(pa.array(np.searchsorted(o, rows).astype(np.int32)), v) for o, v in ((owner, spans), (pairs[:, 0], names.take(pa.array(pairs[:, 1]))))]
                yield first, last, [pa.array(np.diff(w.first).astype(np.int64)), *lists]

        out = map_text(out.select("kept", "t", "hit_spans", "items"), ["kept", "t", "hit_spans", "items"], "t", f"n_words long, new_spans {span}, new_items array<string>", compute)
        out = out.select("kept", "t", "n_words", F.concat("hit_spans", "new_spans").alias("hit_spans"), F.array_union("items", "new_items").alias("items"))
    own = {"n_words", "n_hit", "hit_spans", "items"}
    kept = [F.col(f"kept.`{c}`") for c in docs.select(*keep).columns if c not in own]
    return out.select(*kept, "n_words", _union_size(F.col("hit_spans")).alias("n_hit"), F.array_sort("hit_spans").alias("hit_spans"), F.array_sort("items").alias("items"))


def decontaminated(docs: DataFrame, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The training rows without a hit, in their own columns."""
    names = docs.columns
    judged = contamination(docs, [F.struct(*names).alias("row_")], text, items, item_id, item_text, window)
    return judged.filter("n_hit = 0").select(*(F.col(f"row_.`{c}`") for c in names))


def longest_matches(docs: DataFrame, key: str, text: str, items: DataFrame, item_id: str = "item_id", item_text: str = "text", least: int = WINDOW) -> DataFrame:
    """item_id (as text), length, item_from, key, doc_from: each item's longest verbatim match over all shards, of `least` words or more, and
    where it stands; of equally long ones that with the least item word, key (nulls first) and word."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    schema = f"item_id string, length long, item_from long, `key` {kind}, doc_from long"
    found = None
    for block in _passes(items, item_id, item_text, least):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            release()
            known = shared.value
            starts = np.flatnonzero(np.diff(known.ends, prepend=-1))
            begin = np.repeat(starts, np.diff(starts, append=known.words.size))
            for b in batches:
                for first, last, raw, offs in blocks(b.column(1), SHARD_BYTES):
                    w = Words(raw, offs, BETWEEN)
                    _, _, order, got = shard_hits(w, w.hashes(lower=True), known)
                    tests = np.flatnonzero(got.longest >= least)
                    top = np.zeros(len(known.ids), np.int64)
                    np.maximum.at(top, known.item[tests], got.longest[tests])
                    tests = tests[got.longest[tests] == top[known.item[tests]]]
                    places, which = _spread(got.low[tests], got.high[tests])
                    at = order[places]
                    text_of = np.searchsorted(w.first, at, "right") - 1
                    one = np.unique(np.stack([tests[which], text_of, at - w.first[text_of]], 1), axis=0)
                    _, keep_first = np.unique(one[:, 0] * (last - first) + one[:, 1], return_index=True)  # a text's first place
                    t, d, p = one[keep_first].T
                    keys = b.column(0).slice(first, last - first).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([pa.array(known.ids, pa.string()).take(pa.array(known.item[t])), pa.array(got.longest[t]), pa.array(t - begin[t]), keys, pa.array(p)], names=["item_id", "length", "item_from", "key", "doc_from"])

        part = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    best = F.min(F.struct((-F.col("length")).alias("length"), "item_from", "key", "doc_from"))
    out = found.groupBy("item_id").agg(best.alias("best"))
    return out.select("item_id", (-F.col("best.length")).alias("length"), "best.item_from", F.col("best.key").alias(key), "best.doc_from")
