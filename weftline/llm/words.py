"""Words of many texts at once, on the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D. White space is ASCII, so bytes serve for UTF-8. A word's
hash is a polynomial over its bytes modulo 2**64, taken from a running sum and moved to position 0 by the
inverse power, then mixed; it depends on the word alone, not on its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; a longer text makes a block of its own, and its words are hashed in runs of this size.
BLOCK = 1 << 20
U = np.uint64
_ONE = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x = x ^ (x >> U(27))
    x = x * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[0] = U(1)
    return np.multiply.accumulate(out)


_BASE = 0x9E6C63D0876A9A35
_tables: dict[str, np.ndarray] = {}


def _table(name: str) -> np.ndarray:
    if not _tables:
        byte = np.arange(256, dtype=np.uint64)
        _tables["exact"] = mix64(byte + U(0x51A7))
        lower = byte.copy()
        lower[65:91] += U(32)
        _tables["lower"] = mix64(lower + U(0x51A7))
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        _tables["space"] = space
        _tables["power"] = _powers(_BASE, BLOCK + 1)
        _tables["inverse"] = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)
    return _tables[name]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, limit: int | None = None, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of limit bytes at most, or of one longer text. At most `rows` texts are copied at once."""
    limit = limit or BLOCK
    for at in range(0, len(column), rows):
        raw, offs = text_bytes(column.slice(at, rows))
        first, n = 0, len(offs) - 1
        while first < n:
            last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
            yield at + first, at + last, raw[offs[first] : offs[last]], offs[first : last + 1] - offs[first]
            first = last


class Words:
    """Words of a block: start and end bytes, and first[i]:first[i + 1] as the words of text i. between: for each byte, whether it parts words; white space if not given."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, between: np.ndarray | None = None):
        self.raw, self.offs = raw, offs
        n = raw.size
        space = (_table("space") if between is None else between)[raw]
        edge = np.empty(n + 1, bool)  # before which a word can start, or end
        edge[1:n] = space[:-1]
        edge[0] = edge[n] = True
        edge[offs] = True
        inside = ~space
        self.start = np.flatnonzero(inside & edge[:n])
        after = edge[1:].copy()
        after[: n - 1] |= space[1:]
        self.end = np.flatnonzero(inside & after) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, offs)

    def hashes(self, lower: bool = False) -> np.ndarray:
        start, end = self.start, self.end
        out = np.empty(start.size, np.uint64)
        values, power, inverse = _table("lower" if lower else "exact"), _table("power"), _table("inverse")
        at = 0
        while at < start.size:
            base = start[at]
            to = int(np.searchsorted(end, base + BLOCK, "right"))
            if to <= at:  # one word above the block size: its mixed runs, chained
                h = U(0)
                for p in range(base, end[at], BLOCK):
                    run = values[self.raw[p : min(end[at], p + BLOCK)]]
                    with np.errstate(over="ignore"):
                        h = mix64(np.array([h + (run * power[: run.size]).sum()]))[0]
                out[at] = h
                at += 1
                continue
            raw = self.raw[base : end[to - 1]]
            run = np.empty(raw.size + 1, np.uint64)
            run[0] = U(0)
            np.cumsum(values[raw] * power[: raw.size], out=run[1:])
            s = start[at:to] - base
            out[at:to] = mix64((run[end[at:to] - base] - run[s]) * inverse[s])
            at = to
        return out


def chained(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of width words (as many as there are words, less width - 1); runs may cross texts."""
    n = hashes.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = mix64(out * U(0x2545F4914F6CDD1D) + hashes[k : k + n])
    return out
