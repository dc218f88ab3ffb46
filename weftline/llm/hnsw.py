"""Approximate nearest neighbours by inner product: a navigable small-world graph for each shard.

Rows are dealt into shards by a hash of their id, so shards are even whatever vectors are frequent; vectors of different
dimensions have no inner product and go to shards of their own. A shard's distinct vectors are the nodes of a hierarchical graph, each
with the ids that have it; every level is a flat array of neighbours (nodes x degree, -1 where there are fewer). Nodes are
tied to those of the largest inner product, the measure that is searched for: a graph of distances made from inner products by one
more component finds far fewer where norms differ. Insertion and search are beam searches for many vectors at once. Queries meet each
shard in blocks; candidates are scored again in double precision on the original vectors, and shard results are merged by a
limited window.

A shard holds about shard_bytes of vectors, which grow as the root of the table up to MOST, so that queries meet few shards; a block
of queries is as large as two shards. The beam's width grows as the root of the shard's rows, which keeps recall level (tests hold it
against brute force). Recall is approximate: `ef`, the width at EF_ROWS rows, trades it for time.

Defined results: vectors that are null, zero, or hold a null or a non-finite component take no part, nor do rows with a null id;
ties go to the smaller id; rows with a query's own id are not its candidates; a query id that repeats is answered once, for its
shortest and then least vector; an empty table gives no rows; other columns are not read. Of rows that share an id each id is found once,
at its best score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize

DEGREE = 16
#: Bytes (of doubles) of a shard for tables up to that size, and of any shard, about.
SHARD, MOST = 4 << 20, 128 << 20
#: The beam is `ef` wide at this many rows.
EF_ROWS = 8192
#: Vectors searched at once, and candidates expanded in a step.
TOGETHER, WIDE = 256, 4


class _Scratch:
    """Marks of up to TOGETHER searches over n nodes, kept from one batch to the next; only what was touched is cleared."""

    def __init__(self, n: int):
        self.seen, self.mark = np.zeros((TOGETHER, n + 1), bool), np.zeros((TOGETHER, n), np.int32)


def _beam(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, scratch: _Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, nearness) of the ef best found for each query, best first; -1 and -inf where there are fewer."""
    q, n = len(queries), len(vectors)
    rows = np.arange(q)[:, None]
    ids = np.full((q, ef), -1)
    near = np.full((q, ef), -np.inf, np.float32)
    done = np.ones((q, ef), bool)
    entry = entry[:, :ef]
    k = entry.shape[1]
    ids[:, :k], done[:, :k] = entry, False
    near[:, :k] = np.einsum("qkd,qd->qk", vectors[entry], queries)
    seen, mark = scratch.seen, scratch.mark
    touched = [(np.broadcast_to(rows, entry.shape).ravel(), entry.ravel()), (np.arange(q), np.full(q, n))]
    for r, c in touched:
        seen[r, c] = True
    active = np.arange(q)
    wide = min(WIDE, ef)
    while active.size:
        masked = np.where(done[active], -np.inf, near[active])
        pick = np.argpartition(-masked, wide - 1, axis=1)[:, :wide] if wide < ef else np.broadcast_to(np.arange(ef), masked.shape)
        open_ = np.take_along_axis(masked, pick, 1) > -np.inf
        going = open_.any(1)
        active, pick, open_ = active[going], pick[going], open_[going]
        if not active.size:
            break
        at = active[:, None]
        chosen = np.where(open_, ids[at, pick], -1)
        done[at, pick] = True
        new = graph[chosen]
        new[chosen < 0] = -1
        new = new.reshape(len(active), -1)
        new = np.where(new < 0, n, new)
        fresh = ~seen[at, new]
        place = np.broadcast_to(np.arange(new.shape[1], dtype=np.int32), new.shape)
        inner = np.minimum(new, n - 1)
        mark[np.broadcast_to(at, new.shape)[fresh], inner[fresh]] = place[fresh]
        fresh &= mark[at, inner] == place
        r, c = np.nonzero(fresh)
        touched.append((active[r], inner[r, c]))
        seen[touched[-1]] = True
        s = np.full(new.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("nd,nd->n", vectors[inner[r, c]], queries[active[r]])
        all_ids = np.concatenate([ids[active], inner], 1)
        all_near = np.concatenate([near[active], s], 1)
        all_done = np.concatenate([done[active], np.zeros(new.shape, bool)], 1)
        best = np.argpartition(-all_near, ef - 1, axis=1)[:, :ef]
        near[active] = np.take_along_axis(all_near, best, 1)
        ids[active] = np.where(near[active] > -np.inf, np.take_along_axis(all_ids, best, 1), -1)
        done[active] = np.take_along_axis(all_done, best, 1) | (near[active] == -np.inf)
    for r, c in touched:
        seen[r, c] = False
    order = np.argsort(-near, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)


def _diverse(vectors: np.ndarray, ids: np.ndarray, near: np.ndarray, degree: int) -> np.ndarray:
    """Of candidates, best first, those nearer to the node than to any already kept, then the best of the rest."""
    q, k = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = own @ own.transpose(0, 2, 1)
    kept = np.zeros((q, k), bool)
    count = np.zeros(q, int)
    for j in range(k):
        rival = np.where(kept, between[:, j, :], -np.inf).max(1)
        ok = (ids[:, j] >= 0) & (rival < near[:, j]) & (count < degree)
        kept[:, j] = ok
        count += ok
    rank = np.where(ids < 0, 2 * k + 1, np.where(kept, 0, k)) + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :degree]
    out = np.take_along_axis(ids, order, 1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


def _width(degree: int, level: int) -> int:
    """Neighbours that a node's array holds."""
    return degree * (2 if level == 0 else 1) * 3 // 2


class Graph:
    """levels[0] holds all nodes; a node is on level l if its height is l or more."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, ef: int = 48, seed: int = 11):
        self.vectors, n = vectors, len(vectors)
        rng = np.random.default_rng(seed)
        height = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
        order = np.argsort(-height, kind="stable")  # high nodes first: each level's nodes are a prefix of the order
        self.order = order
        self.vectors = vectors = np.ascontiguousarray(vectors[order])
        height = height[order]
        self.counts = [int((height >= lv).sum()) for lv in range(int(height[0]) + 1)] if n else []
        self.levels = [np.full((c, _width(degree, lv)), -1, np.int32) for lv, c in enumerate(self.counts)]
        self.scratch = _Scratch(n)
        for lv in reversed(range(len(self.counts))):
            self._fill(lv, ef)

    def _fill(self, lv: int, ef: int) -> None:
        """Inserts the level's nodes in batches, each no larger than what is there."""
        graph, n, v = self.levels[lv], self.counts[lv], self.vectors
        degree = graph.shape[1] * 2 // 3
        first = min(n, 2 * degree + 1)
        self._join(graph, np.arange(first), np.arange(first), None, degree)
        at = first
        while at < n:
            to = min(n, at + min(at, TOGETHER))
            new = np.arange(at, to)
            entry = self._descend(v[new], lv)
            entry[entry >= at] = 0  # the level above has nodes that are not yet on this one
            ids, _ = _beam(v[:at], graph[:at], v[new], entry, ef, self.scratch)
            self._join(graph, new, new, ids, degree)
            at = to

    def _join(self, graph: np.ndarray, new: np.ndarray, among: np.ndarray, found: np.ndarray | None, degree: int) -> None:
        """Ties new nodes to the found ones and to one another, both ways. A node's neighbours are pruned to the degree once they
        overflow the array, which has room for half as many more, so that few insertions prune."""
        v, wide = self.vectors, graph.shape[1]
        own = v[new] @ v[among].T
        own[np.arange(len(new)), np.arange(len(new))] = -np.inf
        k = min(degree, len(among))
        top = np.argpartition(-own, k - 1, axis=1)[:, :k]
        ids = np.where(np.take_along_axis(own, top, 1) > -np.inf, among[top], -1)
        if found is not None:
            ids = np.concatenate([ids, found], 1)
        near = np.where(ids >= 0, np.einsum("qkd,qd->qk", v[np.maximum(ids, 0)], v[new]), -np.inf)
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        graph[new, :degree] = _diverse(v, ids, near, degree)
        src = np.repeat(new, degree)
        dst = graph[new, :degree].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        for part in np.array_split(np.unique(dst), max(1, len(dst) // 20_000)):
            lo, hi = np.searchsorted(dst, part, "left"), np.searchsorted(dst, part, "right")
            most = int((hi - lo).max()) if len(part) else 0
            if not most:
                continue
            take = lo[:, None] + np.arange(most)
            back = np.where(take < hi[:, None], src[np.minimum(take, len(src) - 1)], -1)
            ids = np.concatenate([graph[part], back], 1)
            srt = np.sort(ids, 1)
            twice = np.zeros(srt.shape, bool)
            twice[:, 1:] = srt[:, 1:] == srt[:, :-1]
            ids = np.where(twice, -1, srt)
            count = (ids >= 0).sum(1)
            room = count <= wide
            kept = -np.sort(-ids[room], 1)[:, :wide]  # -1 comes last
            graph[part[room], : kept.shape[1]] = kept
            over = ids[~room]
            if len(over):
                at = part[~room]
                near = np.where(over >= 0, np.einsum("qkd,qd->qk", v[np.maximum(over, 0)], v[at]), -np.inf)
                order = np.argsort(-near, axis=1, kind="stable")
                graph[at, degree:] = -1
                graph[at, :degree] = _diverse(v, np.take_along_axis(over, order, 1), np.take_along_axis(near, order, 1), degree)

    def _descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entry points on level `to`."""
        entry = np.zeros((len(queries), 1), int)
        for lv in range(len(self.counts) - 1, to, -1):
            entry, _ = _beam(self.vectors[: self.counts[lv]], self.levels[lv], queries, entry, 8, self.scratch)
            entry = entry[:, :1]
        return entry

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Nodes (numbers in the given vectors) of the ef best for each query; -1 where there are fewer."""
        out = []
        for at in range(0, len(queries), TOGETHER):
            q = queries[at : at + TOGETHER]
            ids, _ = _beam(self.vectors, self.levels[0], q, self._descend(q, 0), ef, self.scratch)
            out.append(np.where(ids >= 0, self.order[np.maximum(ids, 0)], -1))
        return np.concatenate(out)

    def flat(self) -> dict[str, bytes]:
        sizes = np.array([*self.counts], np.int64)
        return {"counts": sizes.tobytes(), "order": self.order.astype(np.int64).tobytes(), "neighbours": b"".join(x.tobytes() for x in self.levels)}

    @staticmethod
    def of(vectors: np.ndarray, flat: dict, degree: int) -> Graph:
        g = Graph.__new__(Graph)
        g.counts = np.frombuffer(flat["counts"], np.int64).tolist()
        g.order = np.frombuffer(flat["order"], np.int64)
        g.vectors, g.scratch = np.ascontiguousarray(vectors[g.order]), _Scratch(len(vectors))
        data, at, g.levels = np.frombuffer(flat["neighbours"], np.int32), 0, []
        for lv, c in enumerate(g.counts):
            width = _width(degree, lv)
            g.levels.append(data[at : at + c * width].reshape(c, width))
            at += c * width
        return g


def scaled(vectors: np.ndarray) -> np.ndarray:
    """In single precision, by a common factor that keeps components at most 1; the order of inner products stays."""
    return (vectors / max(np.abs(vectors).max(initial=0), np.finfo(float).tiny)).astype(np.float32)


INDEX = "dim int, shard int, vectors binary, member_ids binary, member_from binary, counts binary, order binary, neighbours binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, vector (array<double>) of the rows that take part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dim"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null and dim > 0")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.filter(F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))


def shard_plan(rows: DataFrame, is_query: Column, shard_bytes: int | None, most: int) -> DataFrame:
    """dim, shards, blocks: into how many shards the rows of a dimension are dealt, and its queries into how many blocks."""
    sizes = rows.groupBy("dim").agg((F.count("*") * F.col("dim") * 8).alias("all"), (F.count_if(is_query) * F.col("dim") * 8).alias("asked"))
    size = F.lit(shard_bytes) if shard_bytes else F.greatest(F.lit(SHARD), F.least(F.lit(most), F.sqrt(F.col("all") * F.lit(SHARD)).cast("long")))
    return sizes.select("dim", F.ceil(F.col("all") / size).cast("int").alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("asked") / (2 * size))).cast("int").alias("blocks"))


def build_index(rows: DataFrame, plan: DataFrame, degree: int = DEGREE, ef: int = 48) -> DataFrame:
    """One row for each shard, written to the shared folder."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        full = np.stack(part["vector"].to_numpy()).astype(np.float64)
        full += 0.0  # -0.0 is 0.0
        ids = part["vec_id"].to_numpy(np.int64)
        _, first, node = np.unique(full.view(np.dtype((np.void, full.dtype.itemsize * full.shape[1]))).ravel(), return_index=True, return_inverse=True)
        order = np.lexsort((ids, node))
        of, members = node[order], ids[order]
        fresh = np.ones(len(of), bool)
        fresh[1:] = (of[1:] != of[:-1]) | (members[1:] != members[:-1])
        of, members = of[fresh], members[fresh]
        starts = np.searchsorted(of, np.arange(len(first) + 1))
        vectors = full[first]
        flat = Graph(scaled(vectors), degree, ef).flat()
        return pd.DataFrame({"dim": [full.shape[1]], "shard": [part["shard"].iloc[0]], "vectors": [vectors.tobytes()], "member_ids": [members.tobytes()], "member_from": [starts.astype(np.int64).tobytes()], **{k: [x] for k, x in flat.items()}})

    dealt = rows.join(plan, "dim").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    return materialize(dealt.select("dim", "shard", "vec_id", "vector").groupBy("dim", "shard").applyInPandas(build, INDEX), "hnsw-index")


def search_index(index: DataFrame, plan: DataFrame, queries: DataFrame, k: int, degree: int = DEGREE, ef: int = 80) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards."""

    def search(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if q.empty or i.empty:
            return none
        row = i.iloc[0]
        asked = np.stack(q["vector"].to_numpy()).astype(np.float64)
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, asked.shape[1])
        members, starts = np.frombuffer(row["member_ids"], np.int64), np.frombuffer(row["member_from"], np.int64)
        graph = Graph.of(scaled(vectors), row, degree)
        width = int(np.ceil(ef * max(1.0, len(vectors) / EF_ROWS) ** 0.5))
        found = graph.search(np.concatenate([scaled(x[None]) for x in asked]), max(width, k + 1))
        out = []
        for own, vector, nodes in zip(q["vec_id"].to_numpy(np.int64), asked, found, strict=True):
            nodes = nodes[nodes >= 0]
            score = (vectors[nodes] * vector).sum(1)
            size = np.minimum(starts[nodes + 1] - starts[nodes], k + 1)  # more of a node's ids than k + 1 cannot be among the k best
            at = np.repeat(starts[nodes], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            ids, score = members[at], np.repeat(score, size)
            other = ids != own
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))
            # an id's rows are all in this shard; of several vectors of one id the best counts
            _, first = np.unique(ids[best], return_index=True)
            best = best[np.sort(first)[:k]]
            out.append((np.full(len(best), own), ids[best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(["query_id", "vec_id", "score"], cols, strict=True)))

    q = queries.join(plan, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select("dim", "shard", "block", "vec_id", "vector")
    i = index.join(plan.select("dim", "blocks"), "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["dim", "shard", "block"]
    found = q.groupBy(*keys).cogroup(i.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_bytes: int | None = None, most: int = MOST, degree: int = DEGREE, ef: int = 80) -> DataFrame:
    """The k nearest of each query row among all other rows; is_query is a condition on vec_id. With shard_bytes, shards are of that size."""
    rows = materialize(usable(vectors, id_col, vector_col), "hnsw-vectors")
    plan = materialize(shard_plan(rows, is_query, shard_bytes, most), "hnsw-plan")  # a row for each dimension
    index = build_index(rows, plan, degree)
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("v")).select("vec_id", "v.dim", "v.vector")
    return search_index(index, plan, queries, k, degree, ef)
