"""Connected components of an edge table, distributed, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import delete_path, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Ties every larger neighbour of a node to the node's least neighbour, or to itself. Edges may repeat."""
    both = edges.union(edges.select("v", "u"))
    # written before it is joined back: a node with very many edges is then an oversized partition of a plain join, which adaptive execution splits
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    tied = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.filter("u > v")


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Ties every smaller neighbour of a node, and the node, to the least of them."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "least")
    rest = edges.join(least, F.col("u") == F.col("k")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct()


def _is_settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each node hangs on one other at most, and on none that hangs itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Gives node, root for every node on an edge between two nodes; root is the least of its component.

    Each round is written to the shared folder, so that lineage stays short and lost executors cost one round.
    """
    spark = edges.sparkSession
    e = materialize(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_settled(e):
        last = e
        large = materialize(_large_star(e), "edges")
        e = materialize(_small_star(large), "edges")
        for done in (last, large):
            delete_path(spark, done._weftline_path)
    return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct()), "components")
