"""A Merkle manifest of a dataset: a tree of digests for each group of rows, one tree over the groups, and each row's proof.

A group's leaves stand in order, and while it has more than one node, every 16 consecutive nodes become their digest; what remains is
the group's subroot, and the subroots become the root in the same way. The leaves get their places from a range sort with a count of
each partition. Aligned blocks of 16 ** 3 nodes are traversed in one task each: recursively, in postorder, a node's digest is returned
when its children's have been, and while the recursion unwinds, the siblings of each child are appended to the leaves it contains.
The blocks' roots, a row for 4,096, feed the next distributed traversal, until one node is left. A first round of traversals goes up
and only returns digests; a second comes down and appends siblings, each block being handed the siblings above it, so that no sibling
is sent or stored before it belongs to a row of the result. `folded` makes the root from a leaf and its proof alone.

Digests are sha256; an inner node's is that of its children's hexadecimal texts in a row. A proof (`path`) has a step for each level from
the leaf up, over the subroot, to the root: the node's place in its run and its siblings' digests, 32 bytes each, left to right.

Defined results: leaves ascend by their order columns, null first, then by their digests; equal rows are leaves each; the null group is the
first and is not the empty one; a group of one leaf has that leaf as its subroot, and a single group's subroot is the root; an empty
table gives no rows. Group values are compared by their UTF-8 bytes. Texts of any length are hashed where they are read and never travel.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize

#: Nodes that become one, and levels that a block of nodes has.
FANOUT, LEVELS = 16, 3

_PATH = "path array<struct<place:int,siblings:binary>>"
_PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.binary())]))


def row_digest(columns: list[Column]) -> Column:
    """Lower-case hexadecimal sha256 of a row's values, each `-` if null, else its length in UTF-8 bytes, `:` and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def levels_of(nodes: int, most: int = LEVELS) -> int:
    """Levels by which so many nodes become one, or `most` if they don't by then."""
    return next((k for k in range(most) if FANOUT**k >= nodes), most)


def traverse(digests: list[bytes], levels: int, paths: list[list[tuple[int, bytes]]] | None = None) -> bytes:
    """The digest of the tree of so many levels over all digests. In postorder: while it unwinds, each child's place and siblings are
    appended to the paths of the leaves it contains."""

    def visit(first: int, last: int, level: int) -> bytes:
        if not level:
            return digests[first]
        width = FANOUT ** (level - 1)
        children = range(first, last, width)
        nodes = [visit(a, min(a + width, last), level - 1) for a in children]
        if paths is not None:
            for k, a in enumerate(children):
                step = (k, b"".join(nodes[:k] + nodes[k + 1 :]))
                for leaf in range(a, min(a + width, last)):
                    paths[leaf].append(step)
        return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()

    return visit(0, len(digests), levels)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds place, from 0 in each group in the given order, and nodes, the group's number of rows. group is not null; rows that are equal in
    it and the order are ordered as they fall. rows are read twice: a table."""
    by = [F.col(group), *map(F.col, order)]
    # in a sorted partition the id rises by one from row to row, and its upper bits are the partition's number
    dealt = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("row_no", F.monotonically_increasing_id()), "merkle-order").withColumn("part_no", F.shiftright("row_no", 33))
    parts = dealt.groupBy(group, "part_no").agg(F.min("row_no").alias("first_row"), F.count("*").alias("n_rows"))
    before = Window.partitionBy(group).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "part_no", (F.coalesce(F.sum("n_rows").over(before), F.lit(0)) - F.col("first_row")).alias("shift_"), F.sum("n_rows").over(Window.partitionBy(group)).alias("nodes"))
    return dealt.join(parts, [group, "part_no"]).withColumn("place", F.col("row_no") + F.col("shift_")).drop("row_no", "part_no", "shift_")


def _block() -> Column:
    return F.expr(f"place div {FANOUT**LEVELS}")


def _in_order(t: pa.Table) -> pa.Table:
    return t.take(pc.sort_indices(t["place"])).combine_chunks()


def _up(nodes: DataFrame) -> DataFrame:
    """group_, place, nodes, digest of each block's root."""

    def root(t: pa.Table) -> pa.Table:
        t = _in_order(t)
        n = t["nodes"][0].as_py()
        digest = traverse(t["digest"].to_pylist(), levels_of(n))
        size = FANOUT**LEVELS
        return pa.table({"group_": t["group_"][:1], "place": pa.array([t["place"][0].as_py() // size], pa.int64()), "nodes": pa.array([-(-n // size)], pa.int64()), "digest": pa.array([digest], pa.binary())})

    thin = nodes.select("group_", "place", "nodes", "digest", _block().alias("block"))
    return thin.groupBy("group_", "block").applyInArrow(root, "group_ string, place long, nodes long, digest binary")


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The nodes with path, subroot and root. above: group_, place, path, subroot, root of each block's root."""

    def unwind(t: pa.Table, roots: pa.Table) -> pa.Table:
        t = _in_order(t)
        paths: list[list[tuple[int, bytes]]] = [[] for _ in range(t.num_rows)]
        traverse(t["digest"].to_pylist(), levels_of(t["nodes"][0].as_py()), paths)
        upper = [(x["place"], x["siblings"]) for x in roots["path"][0].as_py()]
        steps = [step for path in paths for step in (*path, *upper)]
        ends = [0]
        for path in paths:
            ends.append(ends[-1] + len(path) + len(upper))
        values = pa.StructArray.from_arrays([pa.array([k for k, _ in steps], pa.int32()), pa.array([s for _, s in steps], pa.binary())], fields=list(_PATH_TYPE.value_type))
        out = t.select([c for c in t.column_names if c != "block"]).append_column("path", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
        for c in ("subroot", "root"):
            out = out.append_column(c, pa.array([roots[c][0].as_py()] * t.num_rows, pa.binary()))
        return out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    left = nodes.withColumn("block", _block())
    right = above.select("group_", F.col("place").alias("block"), "path", "subroot", "root")
    return left.groupBy("group_", "block").cogroup(right.groupBy("group_", "block")).applyInArrow(unwind, f"{kinds}, {_PATH}, subroot binary, root binary")


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes, the roots of their blocks, the roots of those, and so on, until each group has one."""
    levels = [nodes]
    left = nodes.agg(F.max("nodes")).first()[0] or 1
    while len(levels) == 1 or left > 1:
        levels.append(materialize(_up(levels[-1]), "merkle-blocks"))
        left = -(-left // FANOUT**LEVELS)
    return levels


def _descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    for nodes in reversed(levels[:-1]):
        tops = _down(nodes, tops)
    return tops


def manifest(rows: DataFrame, group: Column, order: list[Column], leaf: Column, keep: list[Column]) -> DataFrame:
    """The kept columns, leaf, subroot, root (hexadecimal) and path of each row. leaf: row_digest or another sha256 in hexadecimal."""
    own = rows.select(F.struct(*keep).alias("kept"), F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("")).alias("group_"), F.struct(*order).alias("by"), F.unhex(leaf).alias("digest"))
    # the row's number tells equal rows apart, so that a range sort can part them
    leaves = materialize(own.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    nodes = materialize(numbered(leaves, "group_", ["by", "digest", "tie"]).drop("by", "tie"), "merkle-nodes")
    groups = _climb(nodes)
    subroots = materialize(groups[-1].select(F.lit("").alias("group_"), F.col("group_").alias("of"), "digest"), "merkle-subroots")
    trunk = _climb(numbered(subroots, "group_", ["of"]))
    path = F.array().cast(_PATH.split(" ", 1)[1])
    root = trunk[-1].select("group_", "place", path.alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    above = _descend(trunk, root).select(F.col("of").alias("group_"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root")
    out = _descend(groups, above)
    hexed = [F.lower(F.hex(c)).alias(n) for c, n in (("digest", "leaf"), ("subroot", "subroot"), ("root", "root"))]
    names = rows.select(*keep).columns
    return out.select(*(F.col(f"kept.`{c}`") for c in names if c not in ("leaf", "path", "subroot", "root")), *hexed, "path")


def siblings_of(path: Column) -> Column:
    """A proof's digests in hexadecimal, level by level."""
    return F.lower(F.hex(F.aggregate(path, F.lit(b""), lambda a, x: F.concat(a, x["siblings"]))))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to, in hexadecimal."""

    def up(node: Column, step: Column) -> Column:
        told, at = F.lower(F.hex(step["siblings"])), 64 * step["place"]
        return F.sha2(F.concat(F.substr(told, F.lit(1), at), node, F.substr(told, at + 1)), 256)

    return F.aggregate(path, leaf, up)
