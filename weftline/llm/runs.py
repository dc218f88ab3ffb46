"""Periodic runs of words: the stretches of a text in which a short passage repeats four times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and of max(6, 4 q) words or more, which no
neighbouring word extends with period q. It covers at least four points of every grid of step q, so for each period p in turn the words
at jp and (j + 1)p are compared, all j at once; where three neighbouring tests hold, the stretch of equal words p apart is followed to
both sides in growing chunks of arrays. Grid points inside a run that is already found and whose period divides p are skipped: by
periodicity they lie in that very run. A stretch found again at a multiple of its period has the same ends, by which it is known.
The tests of a block of n words are n + n/2 + n/3 + ... altogether. Texts of a block stand side by side, a value that no word has in
between, so that one grid serves all and no stretch crosses.

Words are compared by their 64-bit hashes. Defined results: a null or empty text has no word and no run, and collapses to the empty text;
repeated rows and null ids are rows like others; a text of any length is searched whole, by its own in a block; an empty table gives no
rows; columns of the input with other names than the outputs pass through if kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from weftline.llm.columns import map_text
from weftline.llm.words import U, Words, blocks, mix64

#: Repeats and words that make a run.
REPEATS, LEAST = 4, 6
#: Words compared at once when a stretch is followed; doubled up to the last.
CHUNK, CHUNK_MOST = 64, 1 << 16

OUTPUTS = "runs array<struct<start:long,length:long,period:long>>, collapsed_text string"


def _follow(words: np.ndarray, at: int, p: int, end: int) -> int:
    """The first i >= at, below end, whose word differs from that p later; end if none does."""
    size = CHUNK
    while at < end:
        to = min(at + size, end)
        differs = words[at:to] != words[at + p : to + p]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, size = to, min(2 * size, CHUNK_MOST)
    return end


def _follow_back(words: np.ndarray, at: int, p: int) -> int:
    """The least i such that all of i .. at - 1 equal the words p later."""
    size = CHUNK
    while at > 0:
        to = max(at - size, 0)
        differs = words[to:at] != words[to + p : at + p]
        k = int(differs[::-1].argmax())
        if differs[at - to - 1 - k]:
            return at - k
        at, size = to, min(2 * size, CHUNK_MOST)
    return 0


def find_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array, no run being longer than `longest`; by period, then start."""
    n = words.size
    inside = np.zeros(n, np.int32)  # the number of the last run found at a word
    periods = np.ones(16, np.int64)
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    for p in range(1, longest // REPEATS + 1):
        grid = words[::p]
        equal = grid[1:] == grid[:-1]
        at = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:]) * p
        if not at.size:
            continue
        if found:
            run = inside[at]
            at = at[(run == 0) | (inside[at + p] != run) | (inside[at + 2 * p] != run) | (p % periods[run] != 0)]
        reached = 0
        for i in at.tolist():
            if i < reached:  # in the stretch just followed
                continue
            low, reached = _follow_back(words, i, p), _follow(words, i, p, n - p)
            length = reached + p - low
            if length >= max(LEAST, REPEATS * p) and (low, length) not in known:
                known.add((low, length))
                found.append((low, length, p))
                if len(found) >= periods.size:
                    periods = np.concatenate([periods, np.ones(periods.size, np.int64)])
                periods[len(found)] = p
                inside[low : low + length] = len(found)
    return found


def _collapsed(w: Words, dropped: np.ndarray) -> pa.Array:
    """Each text's words that are not dropped, joined by one space."""
    raw, kept = w.raw.copy(), w.inside.copy()
    owner = np.repeat(np.arange(w.offs.size - 1), np.diff(w.first))
    if dropped.any():
        step = np.zeros(raw.size + 1, np.int8)
        step[w.start[dropped]] += 1
        step[w.end[dropped]] -= 1  # words never touch, but for those at the border of two texts
        touching = dropped[1:] & dropped[:-1] & (w.end[:-1] == w.start[1:])
        step[w.start[1:][touching]] = 0
        kept &= np.cumsum(step[:-1], dtype=np.int8) == 0
    rest = np.flatnonzero(~dropped)
    gaps = w.end[rest[:-1][owner[rest[:-1]] == owner[rest[1:]]]]
    kept[gaps] = True
    raw[gaps] = 32
    ends = np.zeros(raw.size + 1, np.int64)
    np.cumsum(kept, out=ends[1:])
    return pa.LargeStringArray.from_buffers(w.offs.size - 1, pa.py_buffer(ends[w.offs]), pa.py_buffer(raw[kept])).cast(pa.string())


def block_runs(w: Words) -> tuple[list[tuple[int, int, int, int]], pa.Array]:
    """(text, start, length, period) of a block's runs, by text, start and period, and the collapsed texts."""
    n_texts = w.offs.size - 1
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(n_texts), counts)
    side_by_side = np.empty(w.start.size + n_texts, np.uint64)
    side_by_side[np.arange(w.start.size) + owner] = w.hashes()
    begins = w.first[:-1] + np.arange(n_texts)  # of texts; each ends before its parting value
    side_by_side[begins + counts] = mix64(np.arange(n_texts, dtype=np.uint64) + U(0xB0C4_71D2_93E6_0001))
    out = []
    dropped = np.zeros(w.start.size, bool)
    for low, length, p in find_runs(side_by_side, int(counts.max(initial=0))):
        text = int(np.searchsorted(begins, low, "right")) - 1
        out.append((text, low - int(begins[text]), length, p))
        dropped[low - text + p : low - text + length] = True
    out.sort(key=lambda r: (r[0], r[1], r[3]))
    return out, _collapsed(w, dropped)


def periodic_runs(docs: DataFrame, keep: list[Column | str], text: str) -> DataFrame:
    """The kept columns, `runs` by start and then period, and `collapsed_text`: the text's words joined by one space, without those
    that a run contains after its first period."""
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def compute(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, last, raw, offs in blocks(texts):
            found, collapsed = block_runs(Words(raw, offs))
            table = np.array(found, np.int64).reshape(-1, 4)
            ends = np.searchsorted(table[:, 0], np.arange(last - first + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, k])) for k in (1, 2, 3)], fields=list(struct))
            yield first, last, [pa.ListArray.from_arrays(pa.array(ends), values), collapsed]

    return map_text(docs, keep, text, OUTPUTS, compute)
