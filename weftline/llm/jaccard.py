"""Exact Jaccard join of word-shingle sets as a join in the metric space of the Jaccard distance.

1. Sets. Lower-cased (A-Z) words make shingles, hashed to 64 bits; equal sets become one node. A sketch of a fixed
   size counts shingles over all texts; it only orders them, rare ones first.
2. Pivots and regions. Two sets that link must share one of the first n - ceil(t n) + 1 shingles in any common
   order. Among the nodes that share such a shingle the least is the pivot, and each node falls into the regions
   of the few pivots it meets in this way, so every pair that links meets in the region of some pivot.
   Cheap bounds come first: a node's signature counts its shingles by hash range, as many ranges as half its
   shingles at least; the L1 distance of two signatures is at most the size of the sets' symmetric difference,
   so it bounds their distance from below. Nodes beyond 2 (1 - t) of the pivot stay out of its windows, and those that
   no other node of the region can link with leave it, all without their sets.
3. Windows. Each other node's distance d to its pivot is computed. Nodes within the radius r = 1 - t are linked to the
   pivot, hence to one another, and need no more comparison among themselves; a node outside it can only link
   to another one outside, or, by the triangle inequality, to a node inside at a distance of d - r or more. Those
   boundary nodes are replicated with the outer ones.
4. Recursion. What is left of a region of up to REGION nodes and WEIGHT shingles is joined inside one task, pivot by pivot. A larger
   one is split in distributed rounds. One whose nodes are all connected by links that are already found is done; of any other,
   nodes outside its largest component are compared with all others first. Then by Voronoi cells: these nodes are pivots, each node goes to the cell of
   the nearest and is replicated to those within 2 r of that distance, so that two nodes that link meet in the cell of
   either's nearest pivot; windows then apply within the cell. Where nodes lie too far from all pivots for cells to be smaller than
   their region, it is split like the whole input: by the rarest shingles in the order of counts inside the region, which sets apart
   what its nodes have in common, with the node of the most common shingles as the pivot. Parts no larger than three quarters of
   their region are split again, to any depth. A larger part, of which neither way makes less (very many texts that are all a little
   further apart than r), is joined in blocks of half a task's size, each pair of blocks in a task: the one step whose work is quadratic.
5. Components of the found links, which connect just what all links would.

Aggregates are written before they are joined back, so that a hot key is an oversized partition of a plain join, which
adaptive execution splits.

Defined results: null, empty and wordless texts have empty sets and link with nothing; a text
with fewer words than a shingle has its whole sequence as one; equal texts, repeated rows included, are linked; an empty table gives
no rows; a null id passes through and is never a component's id unless alone; very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.encode import release
from weftline.llm.graph import connected_components
from weftline.llm.words import U, Words, blocks, chained, mix64
from weftline.session import materialize, scratch

#: Bits of the sketch that orders shingles, in this many slices.
SKETCH, SLICES = 23, 32
#: Prefix entries of a bucket, about. Shingles that the sketch counts HOT times or more, and four times the mean of a cell, take the native path.
BUCKET, HOT = 400_000, 100_000
#: Nodes and shingles of a region that one task joins (LEAST nodes however large they are), and pivots of a region's Voronoi cells.
REGION, WEIGHT, LEAST = 4096, 2_000_000, 16
PIVOTS = 8
#: Tables of sketch counts that one task adds.
SUMMED = 16


def shingle_sets(raw: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, first): the set of text i is shingles[first[i]:first[i + 1]], sorted."""
    w = Words(raw, offs)
    h = w.hashes(lower=True)
    n = np.diff(w.first)
    owner = np.repeat(np.arange(len(n)), n)
    runs = chained(h, width)
    ok = owner[: runs.size] == owner[width - 1 :] if runs.size else np.zeros(0, bool)
    tokens, count = runs[ok], np.maximum(n - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    keep = np.ones(tokens.size, bool)
    for i in np.flatnonzero(count):
        part = tokens[first[i] : first[i + 1]]
        part.sort()
        keep[first[i] + 1 : first[i + 1]] = part[1:] != part[:-1]
    short = np.flatnonzero((n > 0) & (n < width))
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[first])
    tokens = tokens[keep]
    if short.size:
        whole = [mix64(chained(h[w.first[i] : w.first[i + 1]], int(n[i])) + U(int(n[i])))[0] for i in short]
        tokens = np.insert(tokens, np.cumsum(sizes)[short], np.array(whole, np.uint64))
        sizes[short] = 1
    return tokens, np.concatenate([[0], np.cumsum(sizes)])


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(tokens.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True)


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, node, set) of each text."""
    for at, _, raw, offs in blocks(column):
        tokens, first = shingle_sets(raw, offs, width)
        for i in range(len(offs) - 1):
            own = tokens[first[i] : first[i + 1]]
            yield at + i, node_of(own) if own.size else 0, own


def _cell(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> U(64 - SKETCH)).astype(np.int64)


def signature(tokens: np.ndarray) -> bytes:
    """Counts of shingles by range of their hash, deflated; between half as many ranges and as many as shingles, 32 at least."""
    bits = min(16, max(5, int(tokens.size).bit_length() - 1))
    return zlib.compress(np.minimum(np.bincount((tokens >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes(), 1)


def _unsigned(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).astype(np.int16)


def _folded(sign: np.ndarray, length: int) -> np.ndarray:
    return sign if sign.size == length else sign.reshape(length, -1).sum(1, dtype=np.int16)


def least_distance(a: np.ndarray, b: np.ndarray, n_a, n_b):
    """A lower bound of the Jaccard distance from signatures (b may be many rows) of sets of the given sizes."""
    apart = np.abs(a - b).sum(-1, dtype=np.int64)
    common = np.minimum((n_a + n_b - apart) // 2, np.minimum(n_a, n_b))
    return 1 - common / np.maximum(n_a + n_b - common, 1)


#: Cells of a slice.
SPAN = (1 << SKETCH) // SLICES


def deflated(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    n = counts.astype("<u4")
    return zlib.compress(b"s" + at.astype("<u4").tobytes() + n[at].tobytes() if at.size * 2 < n.size else b"d" + n.tobytes(), 1)


def _nodes_and_sketch(docs: DataFrame, width: int) -> DataFrame:
    """A row for each text (slice null): doc_id, node, n, signature; and each task's counts of shingles by sketch slice, deflated.

    A slice is dense (four bytes for each cell) or, where that is shorter, a list of cells and a list of counts.
    """

    def packed(sketch: np.ndarray) -> list[tuple[int, bytes]]:
        parts = ((i, sketch[i * SPAN : (i + 1) * SPAN]) for i in range(SLICES))
        return [(i, deflated(part)) for i, part in parts if part.any()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sketch, seen, cells, held = np.zeros(1 << SKETCH, np.uint32), set(), [], 0
        for b in batches:
            nodes, sizes, signs = [], [], []
            for _, node, own in _sets(b.column(1), width):
                nodes.append(node)
                sizes.append(own.size)
                signs.append(signature(own))
                if node not in seen and own.size:
                    seen.add(node)
                    cells.append(_cell(own))
                    held += own.size
                if held >= 200_000:
                    np.add.at(sketch, np.concatenate(cells), 1)
                    cells, held = [], 0
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(len(nodes), pa.int32()), pa.array(signs, pa.binary())], names=names)
        if cells:
            np.add.at(sketch, np.concatenate(cells), 1)
        if rows := packed(sketch) if seen else []:
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=names)

    names = ["doc_id", "node", "n", "slice", "counts"]
    return docs.mapInArrow(run, "doc_id long, node long, n long, slice int, counts binary")


def _level(count):
    """Counts on a scale of ten steps to the octave, in a byte."""
    return np.minimum(255, np.log2(1.0 + count) * 10).astype(np.uint8)


def _added(column) -> np.ndarray:
    total = np.zeros(SPAN, np.int64)
    for data in map(zlib.decompress, column):
        if data[:1] == b"d":
            total += np.frombuffer(data, "<u4", offset=1)
        else:
            n = (len(data) - 1) // 8
            total[np.frombuffer(data, "<u4", n, 1)] += np.frombuffer(data, "<u4", n, 1 + 4 * n)
    return np.minimum(total, 2**32 - 1)


def _sketch(parts: DataFrame, summed: int = SUMMED) -> np.ndarray:
    """The level of each cell. Tasks' counts are added by slice in a tree, so that no task reads more than about `summed` tables."""
    rows = parts.filter("slice is not null").select("slice", "counts")
    most = rows.groupBy("slice").count().agg(F.max("count")).first()[0] or 0
    while most > summed:
        groups = -(-most // summed)
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(groups)))
        rows = materialize(dealt.groupBy("slice", "part").applyInPandas(lambda r: pd.DataFrame({"slice": [r["slice"].iloc[0]], "counts": [deflated(_added(r["counts"]))]}), "slice int, counts binary"), "jaccard-sketch")
        most = groups
    levels = rows.groupBy("slice").applyInPandas(lambda r: pd.DataFrame({"slice": [r["slice"].iloc[0]], "levels": [_level(_added(r["counts"])).tobytes()]}), "slice int, levels binary").collect()  # 2**SKETCH bytes
    out = np.zeros(1 << SKETCH, np.uint8)
    for r in levels:
        out[r["slice"] * SPAN : (r["slice"] + 1) * SPAN] = np.frombuffer(r["levels"], np.uint8)
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefix_runs(docs: DataFrame, sketch: np.ndarray, width: int, percent: int, hot: int, want_hot: bool, pack, schema: str) -> DataFrame:
    """pack(shingles, nodes) of about a million prefix entries at a time, those of hot shingles or of all others."""
    shared, limit = docs.sparkSession.sparkContext.broadcast(sketch), _level(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen, tokens, nodes, held = shared.value, set(), [], [], 0
        for b in batches:
            for _, node, own in _sets(b.column(1), width):
                if not own.size or node in seen:
                    continue
                seen.add(node)
                level = levels[_cell(own)]
                rare = np.argsort(level, kind="stable")[: prefix_size(own.size, percent)]
                rare = rare[(level[rare] >= limit) == want_hot]
                tokens.append(own[rare])
                nodes.append(np.full(rare.size, node, np.int64))
                held += rare.size
                if held >= 1_000_000:
                    yield pack(np.concatenate(tokens), np.concatenate(nodes))
                    tokens, nodes, held = [], [], 0
        if held:
            yield pack(np.concatenate(tokens), np.concatenate(nodes))

    return docs.mapInArrow(run, schema)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """(node, pivot, many) of a bucket of prefix entries."""
    t = np.frombuffer(b"".join(rows["shingles"]), "<u4")
    v = np.concatenate([np.frombuffer(n, np.int64)[np.frombuffer(i, "<u4")] for n, i in zip(rows["nodes"], rows["places"], strict=True)])
    order = np.argsort(t, kind="stable")
    t, v = t[order], v[order]
    same = np.zeros(t.size, bool)
    same[1:] = t[1:] == t[:-1]
    shared = same.copy()
    shared[:-1] |= same[1:]
    t, v = t[shared], v[shared]
    order = np.lexsort((v, t))
    t, v = t[order], v[order]
    fresh = np.ones(t.size, bool)
    fresh[1:] = (t[1:] != t[:-1]) | (v[1:] != v[:-1])
    t, v = t[fresh], v[fresh]
    start = np.ones(t.size, bool)
    start[1:] = t[1:] != t[:-1]
    group = np.cumsum(start) - 1
    size = np.bincount(group, minlength=1)
    out = pd.DataFrame({"node": v, "pivot": v[np.flatnonzero(start)][group] if t.size else v, "many": size[group] > 2 if t.size else np.zeros(0, bool)})
    out = out[out["node"] != out["pivot"]]
    return out.groupby(["node", "pivot"], as_index=False, sort=False)["many"].max()


def _pivots(docs: DataFrame, sketch: np.ndarray, width: int, percent: int, buckets: int, hot: int) -> DataFrame:
    """(node, pivot, many): the pivot is the least node of those that share a prefix shingle; many: three or more share it.

    Entries are shuffled packed: within a bucket 32 bits of a mixed shingle tell shingles apart (what falls together
    by chance meets a pivot in vain), and nodes are numbered in each pack. Shingles that the sketch counts `hot` times or
    more, whose entries could overfill a task, take native aggregation and join instead.
    """

    def pack(t: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        mixed = mix64(t)
        bucket = (mixed % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, short = bucket[order], (mixed[order] >> U(32)).astype("<u4")
        own, place = np.unique(v, return_inverse=True)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here, at = np.unique(place[order[a:b]], return_inverse=True)
            rows.append((short[a:b].tobytes(), own[here].tobytes(), at.astype("<u4").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), *(pa.array(c, pa.binary()) for c in zip(*rows, strict=True))], names=["bucket", "shingles", "nodes", "places"])

    packed = _prefix_runs(docs, sketch, width, percent, hot, False, pack, "bucket long, shingles binary, nodes binary, places binary")
    pairs = packed.groupBy("bucket").applyInPandas(_meet, "node long, pivot long, many boolean")
    if sketch.max() >= _level(hot):
        plain = lambda t, v: pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(v)], names=["shingle", "node"])
        entries = materialize(_prefix_runs(docs, sketch, width, percent, hot, True, plain, "shingle long, node long").distinct(), "jaccard-hot")
        least = entries.groupBy("shingle").agg(F.min("node").alias("pivot"), F.count("*").alias("k"))
        pairs = pairs.union(entries.join(least, "shingle").filter("node <> pivot").select("node", "pivot", (F.col("k") > 2).alias("many")))
    return pairs.groupBy("node", "pivot").agg(F.max("many").alias("many"))


def _bounded(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """Adds least, a lower bound of the distance between node and pivot, and the node's size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None, None  # rows come by pivot
        for b in batches:
            out = []
            for n_a, s_a, n_b, s_b in zip(*(b.column(k).to_pylist() for k in ("n", "signature", "pivot_n", "pivot_signature")), strict=True):
                if s_b != known[0]:
                    known = s_b, _unsigned(s_b)
                x, y = _unsigned(s_a), known[1]
                m = min(x.size, y.size)
                out.append(float(least_distance(_folded(x, m), _folded(y, m), n_a, n_b)))
            keep = ["node", "pivot", "many", "n", "signature"]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(out, pa.float64())], names=[*keep, "least"])

    its = signs.select(F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("signature").alias("pivot_signature"))
    both = pairs.join(signs.select("node", "n", "signature"), "node").join(its, "pivot")
    return both.select("node", "pivot", "many", "n", "signature", "pivot_n", "pivot_signature").mapInArrow(run, "node long, pivot long, many boolean, n long, signature binary, least double")


def _possible(signs: list[np.ndarray], sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of a region's nodes could link with another one."""
    radius, steps = 1 - percent / 100, (100 // percent).bit_length()
    out = np.zeros(len(signs), bool)
    lengths = np.array([x.size for x in signs])
    for length in np.unique(lengths):
        own = np.flatnonzero(lengths == length)
        # sizes that can link differ by 100 / percent times at most, lengths by one step more than its logarithm
        other = np.flatnonzero((lengths >= length) & (lengths <= length << steps))
        table = np.stack([_folded(signs[i], length) for i in other])
        for i in own:
            ok = least_distance(signs[i], table, sizes[i], sizes[other]) <= radius + 1e-9
            ok &= other != i
            if ok.any():
                out[i] = True
                out[other[ok]] = True
    return out


def _is_large(region: int) -> Column:
    return (F.col("size") > region) | ((F.col("weight") > WEIGHT) & (F.col("size") > LEAST))


def _alive(rows: DataFrame, percent: int, region: int) -> DataFrame:
    """rows: pivot, node, n, signature, near. (region, node, near) of the nodes that could link within their region; all of those in a larger region."""
    size = materialize(rows.groupBy("pivot").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "jaccard-sizes")
    rows = rows.join(size.filter("size > 1"), "pivot")
    large = rows.filter(_is_large(region)).select(F.col("pivot").alias("region"), "node", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close() -> list[tuple]:
            if len(held) < 2:
                return []
            ok = _possible([_unsigned(h[2]) for h in held], np.array([h[1] for h in held]), percent)
            return [(key, h[0], h[3]) for h, keep in zip(held, ok, strict=True) if keep]

        for b in batches:
            out = []
            for pivot, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if pivot != key:
                    out += close()
                    key, held = pivot, []
                held.append(rest)
            if out:
                yield batch(out)
        if out := close():
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        r, v, near = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(v, pa.int64()), pa.array(near, pa.bool_())], names=["region", "node", "near"])

    small = rows.filter(~_is_large(region)).select("pivot", "node", "n", "signature", "near")
    small = small.repartition("pivot").sortWithinPartitions("pivot")
    return small.mapInArrow(run, "region long, node long, near boolean").union(large)


def _shingles_of(docs: DataFrame, width: int) -> DataFrame:
    """node, set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets, held = [], [], 0
            for _, node, own in _sets(b.column(0), width):
                nodes.append(node)
                sets.append(own.view(np.int64))
                held += own.size
                if held >= 500_000:
                    yield batch(nodes, sets)
                    nodes, sets, held = [], [], 0
            if nodes:
                yield batch(nodes, sets)

    def batch(nodes: list, sets: list) -> pa.RecordBatch:
        offs = np.concatenate([[0], np.cumsum([x.size for x in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _distances(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """regions: region, node, pivot, many. Adds linked and the distance d to the pivot."""
    mine, its = sets.select("node", F.col("shingles").alias("a")), sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("b"))
    both = regions.join(mine, "node").join(its, "pivot")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b"))).withColumn("either", F.size("a") + F.size("b") - F.col("common"))
    return both.select("region", "node", "pivot", "many", (100 * F.col("common") >= percent * F.col("either")).alias("linked"), (1 - F.col("common") / F.col("either")).alias("d"))


def _remainder(measured: DataFrame, radius: float) -> DataFrame:
    """(region, node) still to be joined: nodes outside the radius, and those inside within a window of an outer one."""
    able = measured.filter("many")
    outer = materialize(able.filter("not linked").groupBy("region").agg(F.min("d").alias("nearest")), "jaccard-outer")
    inside = F.col("d") + (radius + 1e-9) >= F.col("nearest")
    return able.join(outer, "region").filter(~F.col("linked") | inside).select("region", "node")


def _links_in(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links among the sets would; pivot by pivot, with windows."""
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([x.size for x in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(number.max() + 1, np.int8)
    left, links, radius = np.arange(len(sets)), [], 1 - percent / 100
    group = np.arange(len(sets))
    while left.size > 1:
        p, rest = left[0], left[1:]
        own = number[starts[p] : ends[p]]
        mark[own] = 1
        if rest.size == len(sets) - 1:
            common = np.add.reduceat(mark[number], starts, dtype=np.int64)[rest]
        else:
            at = np.concatenate([np.arange(starts[i], ends[i]) for i in rest])
            cut = np.cumsum(sizes[rest]) - sizes[rest]
            common = np.add.reduceat(mark[number[at]], cut, dtype=np.int64)
        mark[own] = 0
        either = sizes[rest] + sizes[p] - common
        linked, d = 100 * common >= percent * either, 1 - common / either
        for i in rest[linked]:
            if group[i] != group[p]:
                links.append((p, i))
                group[group == group[i]] = group[p]
        outer = ~linked
        if not outer.any():
            break
        near = linked & (d + radius + 1e-9 >= d[outer].min())
        left = rest[outer | near]
        if (group[left] == group[left[0]]).all():
            break
    return links


def _sized(members: DataFrame, weights: DataFrame) -> DataFrame:
    """region, its size in nodes and its weight in shingles."""
    return materialize(members.join(weights, "node").groupBy("region").agg(F.count("*").alias("size"), F.sum("n").alias("weight")), "jaccard-sizes")


def _labelled(rows: DataFrame, links: list[DataFrame]) -> DataFrame:
    """rows (region, node) of the regions that the links don't connect, and whether the node lies outside its region's largest component."""
    found = links[0]
    for more in links[1:]:
        found = found.union(more)
    roots = connected_components(found)
    own = materialize(rows.join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("label")), "jaccard-labels")
    tally = own.groupBy("region", "label").agg(F.count("*").alias("n"))
    main = tally.groupBy("region").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    main = materialize(main.select("region", "main"), "jaccard-main-labels")
    return own.join(main, "region").select("region", "node", (F.col("label") != F.col("main")).alias("apart"))


def _cells(rows: DataFrame, sets: DataFrame, percent: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: region, node, apart. (links, cells, pivots): cells has the parent region, the cell as region, and node; pivots (region, pivot) are done with all of theirs."""
    order = F.xxhash64("node", "region", F.lit(turn))
    pivots = rows.filter("apart").groupBy("region", F.pmod(order, F.lit(PIVOTS)).alias("j")).agg(F.min_by("node", order).alias("pivot")).select("region", "pivot")
    pivots = materialize(pivots, "jaccard-cell-pivots")
    rows = rows.drop("apart")
    met = rows.join(pivots, "region").filter("node <> pivot").withColumn("many", F.lit(True))
    measured = materialize(_distances(met, sets, percent), "jaccard-distances")
    link = measured.filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    nearest = F.min("d").over(Window.partitionBy("region", "node"))  # a row for each pivot
    window = 2 * (1 - percent / 100) + 1e-9
    own = measured.join(pivots.select("region", F.col("pivot").alias("node")), ["region", "node"], "left_anti").withColumn("nearest", nearest).filter(F.col("d") <= F.col("nearest") + window)
    own = materialize(own.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), "node", "many", "linked", "d"), "jaccard-cells")
    parent = own.groupBy("region").agg(F.first("parent").alias("parent"))
    return link, _remainder(own, 1 - percent / 100).join(parent, "region"), pivots


def _by_common_shingles(rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, parts) of rows (region, node) split by the prefix shingles that nodes share in the order of counts within their region."""
    entries = rows.join(sets, "node").select("region", "node", F.explode("shingles").alias("shingle"))
    counts = materialize(entries.groupBy("region", "shingle").agg(F.count("*").alias("k")), "jaccard-local-counts")
    ranked = entries.join(counts, ["region", "shingle"]).groupBy("region", "node").agg(F.array_sort(F.collect_list(F.struct("k", "shingle"))).alias("own"), F.avg("k").alias("common"))  # a node's set
    n = F.size("own")
    prefix = F.slice("own", F.lit(1), n - F.ceil(F.lit(percent) * n / 100).cast("int") + 1)
    shared = ranked.select("region", "node", "common", F.explode(F.filter(prefix, lambda x: x["k"] > 1)).alias("x")).select("region", "x.shingle", "node", "common")
    shared = materialize(shared, "jaccard-local-prefixes")
    central = shared.groupBy("region", "shingle").agg(F.min(F.struct(-F.col("common"), "node"))["node"].alias("pivot"), F.count("*").alias("k")).filter("k > 1")
    met = shared.join(materialize(central, "jaccard-local-pivots"), ["region", "shingle"]).filter("node <> pivot")
    met = met.groupBy("region", "node", "pivot").agg(F.max(F.col("k") > 2).alias("many")).withColumnRenamed("region", "parent").withColumn("region", F.xxhash64("parent", "pivot"))
    met = materialize(met, "jaccard-local-regions")
    measured = materialize(_distances(met, sets, percent), "jaccard-distances")
    parents = met.select("parent", "region").distinct()
    return measured.filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v")), _remainder(measured, 1 - percent / 100).join(parents, "region")


def _shrunk(parts: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parts: parent, region, node. The parts of three quarters of their parent's nodes at most, and the rest."""
    sizes = parts.groupBy("parent", "region").agg(F.count("*").alias("most"))
    wide = sizes.join(large.select(F.col("region").alias("parent"), "size"), "parent").filter("4 * most > 3 * size").select("region")
    wide = materialize(wide, "jaccard-wide")
    return parts.join(wide, "region", "left_anti"), parts.join(wide, "region", "left_semi")


def _recursed(left: DataFrame, link: DataFrame, sets: DataFrame, weights: DataFrame, percent: int, region: int) -> tuple[DataFrame, DataFrame]:
    """(links with those found here, regions left), large regions being split as long as that makes them smaller."""
    links, done, turn = [link], [], 0
    while True:
        size = _sized(left, weights)
        large = size.filter(_is_large(region))
        if large.isEmpty():
            break
        done.append(left.join(large.select("region"), "region", "left_anti").select("region", "node"))
        rows = left.join(large.select("region"), "region", "left_semi")
        rows = materialize(_labelled(rows, links), "jaccard-large")
        link, cells, pivots = _cells(rows, sets, percent, turn)
        cells = materialize(cells, "jaccard-cells-left")
        most = cells.groupBy("parent", "region").count().groupBy("parent").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
        # a region of which no cell is left is done
        useless = most.join(large, F.col("parent") == F.col("region")).filter("4 * most > 3 * size or all > 2 * size").select("parent")
        useless = materialize(useless, "jaccard-useless-cells")
        kept = cells.join(useless, "parent", "left_anti").select("region", "node")
        others = rows.select("region", "node").join(useless.withColumnRenamed("parent", "region"), "region", "left_semi").join(pivots.withColumnRenamed("pivot", "node"), ["region", "node"], "left_anti")
        local, parts = _by_common_shingles(others, sets, percent)
        shrunk, wide = _shrunk(materialize(parts, "jaccard-local-parts"), large)
        links += [link, local]
        done.append(materialize(wide.select("region", "node"), "jaccard-dense"))
        left = materialize(kept.union(shrunk.select("region", "node")), "jaccard-remainder")
        turn += 1
    for more in links[1:]:
        links[0] = links[0].union(more)
    for more in done:
        left = left.union(more)
    return links[0], left


def _joined_regions(members: DataFrame, sets: DataFrame, weights: DataFrame, percent: int, region: int) -> DataFrame:
    """(u, v) links among the members (region, node) of each region."""
    size = _sized(members, weights).filter("size > 1")
    chunks = F.when(~_is_large(region), F.lit(1)).otherwise(F.greatest(F.ceil(F.col("size") / (region // 2)), F.least(F.ceil(F.col("weight") / (WEIGHT // 2)), F.ceil(F.col("size") / (LEAST // 2))))).cast("int")
    m = members.join(size.select("region", chunks.alias("chunks")), "region").withColumn("chunk", F.pmod(F.xxhash64("node", "region"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    m = m.withColumn("other", other).select("region", "node", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    m = m.join(sets, "node").select("region", "i", "j", "node", "shingles")
    m = m.repartition("region", "i", "j").sortWithinPartitions("region", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held = None, [], []

        def close() -> list[tuple[int, int]]:
            return [(nodes[a], nodes[b]) for a, b in _links_in(held, percent)] if len(nodes) > 1 else []

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
            ids, lists = b.column(3).to_pylist(), b.column(4)
            offs, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            links = []
            for r, k in enumerate(keys):
                if k != key:
                    links += close()
                    key, nodes, held = k, [], []
                nodes.append(ids[r])
                held.append(flat[offs[r] : offs[r + 1]])
            if links:
                yield pa.RecordBatch.from_pylist([{"u": int(u), "v": int(v)} for u, v in links])
        links = close()
        if links:
            yield pa.RecordBatch.from_pylist([{"u": int(u), "v": int(v)} for u, v in links])

    return m.mapInArrow(run, "u long, v long")


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, hot: int | None = None, region: int = REGION) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least id that links lead to, its own included)."""
    with scratch(docs.sparkSession) as own:
        out, least = _classes(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), width, percent, hot, region)
        own.keep(out, least)
    out = out.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(docs: DataFrame, width: int, percent: int, hot: int | None, region: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, root of each row; root and the least id of its class)."""
    parts = materialize(_nodes_and_sketch(docs, width), "jaccard-nodes")
    nodes = parts.filter("slice is null").select("doc_id", "node", "n", F.col("counts").alias("signature"))
    sketch = _sketch(parts)
    total = nodes.agg(F.sum("n")).first()[0] or 0
    hot = hot or max(HOT, 4 * total >> SKETCH)
    buckets = max(32, total * (100 - percent) // 100 // BUCKET)

    radius = 1 - percent / 100
    pairs = materialize(_pivots(docs, sketch, width, percent, buckets, hot), "jaccard-pivots")
    active = pairs.select("node").union(pairs.select("pivot")).distinct()
    # equal sets first meet in their own tasks, so that a frequent one does not travel row by row
    one = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    signs = materialize(one.join(active, "node"), "jaccard-signatures")
    bounded = materialize(_bounded(pairs, signs).withColumn("near", F.col("least") <= 2 * radius + 1e-9), "jaccard-bounds")
    alive = materialize(_alive(bounded.filter("many").drop("many", "least"), percent, region), "jaccard-alive")

    near = bounded.filter("near").select(F.col("pivot").alias("region"), "node", "pivot")
    wanted = near.select("node").union(near.select("pivot")).union(alive.select("node")).distinct()
    chosen = signs.join(wanted, "node").select(F.col("doc_id").alias("chosen_id"))
    texts = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("chosen_id")), "left_semi").dropDuplicates(["doc_id", "text"]).select("text")
    sets = materialize(_shingles_of(texts, width), "jaccard-sets")

    still = alive.filter("near").select("region", "node", F.lit(True).alias("many"))
    near = near.join(still, ["region", "node"], "left").fillna(False, ["many"])
    measured = materialize(_distances(near, sets, percent), "jaccard-distances")
    link = measured.filter("linked").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
    far = alive.filter("not near").select("region", "node")
    left = materialize(_remainder(measured, radius).union(far), "jaccard-remainder")
    weights = signs.select("node", "n")
    link, left = _recursed(left, link, sets, weights, percent, region)
    link = link.union(_joined_regions(left, sets, weights, percent, region))

    roots = connected_components(link)
    out = materialize(nodes.drop("signature").join(roots, "node", "left").select("doc_id", "n", F.coalesce("root", "node").alias("root")), "jaccard-roots")
    least = materialize(out.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least")), "jaccard-least")
    return out, least
