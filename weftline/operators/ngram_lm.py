"""An interpolated Kneser-Ney model of three tokens, fitted and applied by joins.

A token's probability after its two predecessors is its discounted share of what followed them, and the discounts' mass times its
probability after one predecessor; that is made in the same way from continuation counts (by how many different tokens a pair is preceded),
and the last from those and a uniform share. Tables of counts are made by aggregation from each other and are never broadcast or held by
the driver but for one row. Losses are made once for each distinct triple and joined to its places, counted by key before.

Defined results: texts begin with two BOS tokens; null and empty texts have no target; on an empty corpus every token has the uniform
probability; triples, pairs or tokens that were never seen fall back to shorter contexts. Keys may be null or repeated: rows of a key add up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import BOS, byte_ids
from weftline.session import materialize

DISCOUNT, TOKENS = 0.75, 256


def _zipped(ids: Column) -> Column:
    padded = F.concat(F.array(F.lit(BOS), F.lit(BOS)), ids)
    part = lambda k: F.slice(padded, F.lit(k), F.size(ids))
    return F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))


def triples(rows: DataFrame, keep: list[str], ids: Column | None = None) -> DataFrame:
    """keep, a, b, c: every token of each row's ids (the bytes of text if not given) with its two predecessors."""
    own = rows.select(*keep, (byte_ids(F.col("text")) if ids is None else ids).alias("ids__"))
    return own.select(*keep, F.explode(_zipped(F.col("ids__"))).alias("t__")).select(*keep, "t__.a", "t__.b", "t__.c")


def placed_triples(rows: DataFrame, keep: list[str], ids: Column) -> DataFrame:
    """keep, pos, a, b, c of every token."""
    own = rows.select(*keep, ids.alias("ids__"))
    return own.select(*keep, F.posexplode(_zipped(F.col("ids__"))).alias("pos", "t__")).select(*keep, "pos", "t__.a", "t__.b", "t__.c")


@dataclass
class Model:
    """Counts (n) and, for contexts, kinds of followers (k): of triples, pairs before a token, continuations, and so on."""

    abc: DataFrame
    ab: DataFrame
    bc: DataFrame
    b: DataFrame
    c: DataFrame
    total: int
    kinds: int


def fit(rows: DataFrame) -> Model:
    """rows: triples."""
    follow = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    abc = materialize(rows.groupBy("a", "b", "c").agg(F.count("*").alias("n")), "lm-triples")
    bc = materialize(abc.groupBy("b", "c").agg(F.count("*").alias("n")), "lm-pairs")
    c = bc.groupBy("c").agg(F.count("*").alias("n"))
    total, kinds = c.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return Model(abc, follow(abc, "a", "b"), bc, follow(bc, "b"), c, total, kinds)


def losses(wanted: DataFrame, model: Model) -> DataFrame:
    """a, b, c, loss (nats) of each distinct triple of wanted."""
    w = wanted.select("a", "b", "c").distinct()
    named = lambda df, name: df.withColumnsRenamed({"n": f"n_{name}", "k": f"k_{name}"})
    for table, name, on in ((model.abc, "abc", ["a", "b", "c"]), (model.ab, "ab", ["a", "b"]), (model.bc, "bc", ["b", "c"]), (model.b, "b", ["b"]), (model.c, "c", ["c"])):
        w = w.join(named(table, name).hint("shuffle_merge"), on, "left")
    left = lambda n: F.greatest(F.coalesce(F.col(n), F.lit(0)) - DISCOUNT, F.lit(0.0))
    uniform = F.lit(1.0 / TOKENS)
    p1 = (left("n_c") + DISCOUNT * model.kinds * uniform) / float(model.total) if model.total else uniform
    p2 = F.when(F.col("n_b") > 0, (left("n_bc") + DISCOUNT * F.col("k_b") * p1) / F.col("n_b")).otherwise(p1)
    p3 = F.when(F.col("n_ab") > 0, (left("n_abc") + DISCOUNT * F.col("k_ab") * p2) / F.col("n_ab")).otherwise(p2)
    return w.select("a", "b", "c", (-F.log(p3)).alias("loss"))


def with_losses(rows: DataFrame, model: Model) -> DataFrame:
    """rows (a, b, c and more) with loss. Neither side is broadcast: rows that come out of short lists look small to Spark, however many they are."""
    return rows.join(losses(rows, model).hint("shuffle_merge"), ["a", "b", "c"])


def document_losses(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """key, target, n, loss: how often each token with its loss stands in a key's texts. rows: triples with key."""
    counted = rows.groupBy(key, "a", "b", "c").agg(F.count("*").alias("n"))
    return counted.join(losses(counted, model), ["a", "b", "c"]).select(key, F.col("c").alias("target"), "n", "loss")
