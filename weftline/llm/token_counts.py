"""Exact token counts for every context limit, from the histogram of encoded lengths.

Documents are aggregated by encoded length. A prefix and a suffix sum over the histogram then answer, for any
context limit L: how many documents and tokens there are, how many fit, the tokens left when every document is
truncated to L (the tokens of documents up to L, plus L for each longer one), and any quantile of length.

Defined results: a null text is an empty text; the length counts the end id if one is asked for; repeated rows
count each time; an empty table gives an empty histogram; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.encode import default_tokenizer, encoder, text_blocks, text_slices
from weftline.session import materialize

#: Lengths a bucket of the two-level sums.
SPAN = 1024


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, extra: int = 1) -> DataFrame:
    """doc_id, n_tokens: the encoded length and `extra` ids (the end of the document)."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in text_slices(batches):
            texts = batch.column(1).to_pylist()
            sizes = [x.size + extra for a, b in text_blocks(texts) for x in enc.batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(sizes, np.int64))], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_tokens long")


def length_table(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """One row for each length L that occurs, each a context limit: docs of that length, docs_fit and tokens_fit (up
    to L), docs_over and tokens_over (longer: the suffix sums), truncated_tokens (all documents cut to L).

    Between two lengths that occur, limit M >= L gives truncated_tokens = tokens_fit + M * docs_over of the row of L.
    """
    h = lengths.groupBy(F.col(column).alias("limit_tokens")).agg(F.count("*").alias("docs"))
    h = materialize(h.withColumn("tokens", F.col("docs") * F.col("limit_tokens")), "length-histogram").withColumn("bucket", F.floor(F.col("limit_tokens") / SPAN))
    sums = h.groupBy("bucket").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    all_, own = Window.orderBy("bucket"), Window.partitionBy("bucket").orderBy("limit_tokens")
    none = lambda c: F.coalesce(c, F.lit(0))
    # prefix and suffix sums of buckets of SPAN lengths, then of the lengths of each bucket
    around = sums.select("bucket", *(none(F.sum(c).over(all_.rowsBetween(*r))).alias(f"{c}_{side}") for c in ("docs", "tokens") for side, r in (("before", (first, -1)), ("after", (1, last)))))
    h = h.join(around, "bucket")  # a row for SPAN lengths
    for c in ("docs", "tokens"):
        h = h.withColumn(f"{c}_fit", F.col(f"{c}_before") + F.sum(c).over(own.rowsBetween(first, 0)))
        h = h.withColumn(f"{c}_over", F.col(f"{c}_after") + none(F.sum(c).over(own.rowsBetween(1, last))))
    truncated = F.col("tokens_fit") + F.col("limit_tokens") * F.col("docs_over")
    return h.select("limit_tokens", "docs", "tokens", "docs_fit", "tokens_fit", "docs_over", "tokens_over", truncated.alias("truncated_tokens"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit_tokens, docs, total_tokens, docs_over, truncated_tokens for any limits, also those at which no document ends."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "asked long")
    totals = histogram.agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("total_tokens"))
    # one row for each limit: the row of the longest length up to it
    at = histogram.join(F.broadcast(asked), F.col("limit_tokens") <= F.col("asked")).groupBy("asked").agg(F.max(F.struct("limit_tokens", "docs_over", "tokens_fit")).alias("r"))
    out = asked.join(at, "asked", "left").join(F.broadcast(totals))
    over = F.coalesce(F.col("r.docs_over"), F.col("docs"))
    return out.select(F.col("asked").alias("limit_tokens"), "docs", "total_tokens", over.alias("docs_over"), (F.coalesce(F.col("r.tokens_fit"), F.lit(0)) + F.col("asked") * over).alias("truncated_tokens"))


def length_quantiles(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """quantile, n_tokens: the length at zero-based rank floor(n * q) of all documents in order."""
    spark = histogram.sparkSession
    asked = spark.createDataFrame([(float(q),) for q in quantiles], "quantile double")
    n = histogram.agg(F.sum("docs").alias("n"))
    rank = asked.join(F.broadcast(n)).withColumn("rank", F.least(F.floor(F.col("n") * F.col("quantile")), F.col("n") - 1))
    hit = (F.col("docs_fit") - F.col("docs") <= F.col("rank")) & (F.col("rank") < F.col("docs_fit"))
    return histogram.join(F.broadcast(rank), hit).select("quantile", F.col("limit_tokens").alias("n_tokens"))
