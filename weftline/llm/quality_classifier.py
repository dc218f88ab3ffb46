"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are n-grams of words (lower-cased), of word shapes (runs of letters, capitals and digits shortened to one
sign, other signs kept) and of a mark for a word that repeats the one before, hashed to 2**BITS weights; a
feature's value is its count over the text's number of n-grams. The weights, of a fixed size, are broadcast,
and a text's score is one sparse dot product.

Training takes a bounded sample of the labelled rows (max_rows, those with the smallest hash of their id; of rows that share an
id, those with the smallest hash of their text) in one task. Defined results: null and empty texts have no n-gram and get the score
of the bias; null labels do not train; rows with the same id, text and label train once; without labels every score is 0.5; very
long texts are scored whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import map_text
from weftline.llm.encode import release
from weftline.llm.words import U, Words, blocks, chained, mix64

BITS = 18
#: A full text's values sum to this.
WEIGHT = 16.0


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58] = ord("0")
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")


def _shapes(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashes of the words' shapes."""
    kind = _SHAPE[raw]
    fresh = np.ones(raw.size, bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[offs[:-1][offs[:-1] < raw.size]] = True
    place = np.concatenate([[0], np.cumsum(fresh)])
    return Words(kind[fresh], place[offs]).hashes()


def block_features(raw: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first): text i has the features buckets[first[i]:first[i + 1]], repeated as often as they occur."""
    w = Words(raw, offs)
    n = np.diff(w.first)
    owner = np.repeat(np.arange(len(n)), n)
    word, shape = w.hashes(lower=True), _shapes(raw, offs)
    again = np.zeros(word.size, np.uint64)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    found, owners = [], []
    for salt, (base, width) in enumerate(((word, 1), (word, 2), (shape, 1), (shape, 2), (shape, 3), (again + U(7), 2))):
        h = chained(base, width)
        ok = owner[: h.size] == owner[width - 1 :] if h.size else np.zeros(0, bool)
        found.append((mix64(h[ok] + U(salt * 0x3C6EF372FE94F82B & (2**64 - 1))) >> U(64 - bits)).astype(np.int64))
        owners.append(owner[: h.size][ok])
    buckets, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return buckets[order], np.searchsorted(owners[order], np.arange(len(n) + 1))


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], size: int, *, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1, epochs: int = 6) -> QualityModel:
    """Per-coordinate follow-the-regularised-leader; examples: (buckets, values, label). The last coordinate is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for buckets, values, label in examples:
            i = np.append(buckets, size)
            x = np.append(values, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(size + 1))
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 10_000, bits: int = BITS, **options) -> QualityModel:
    """Fits on the max_rows labelled rows whose ids have the smallest hashes."""
    labels = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("train_id"), F.col(label_col).cast("int").alias("train_label"))
    chosen = labels.orderBy(F.xxhash64("train_id", F.lit("quality")), "train_id", "train_label").limit(max_rows)  # a bounded sample
    rows = docs.select(F.col(id_col).alias("train_id"), F.col(text_col).alias("train_text")).join(F.broadcast(chosen), "train_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, bound = {}, None  # the max_rows first of this task, however often an id or a text repeats
        for b in batches:
            ids, labels_, texts = b.column(0).to_numpy().astype(np.int64), b.column(2).to_numpy(), b.column(3).to_numpy()
            turns = mix64(ids.astype(np.uint64))
            for first, last, raw, offs in blocks(b.column(1)):
                keys = [tuple(map(int, (turns[i], ids[i], labels_[i], texts[i]))) for i in range(first, last)]
                if all(k in held or (bound is not None and k > bound) for k in keys):
                    continue
                buckets, at = block_features(raw, offs, bits)
                for i, key in enumerate(keys):
                    if key not in held and (bound is None or key < bound):
                        found, count = np.unique(buckets[at[i] : at[i + 1]], return_counts=True)
                        value = (count * (WEIGHT / max(1, at[i + 1] - at[i]))).astype("<f4")
                        held[key] = found.astype("<u4").tobytes() + value.tobytes()
                if len(held) > 2 * max_rows:
                    held = {k: held[k] for k in sorted(held)[:max_rows]}
                    bound = max(held)
        for at in range(0, len(order := sorted(held)[:max_rows]), 1000):
            some = order[at : at + 1000]
            turn, id_, label, text = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([t - (1 << 63) for t in turn], pa.int64()), pa.array(id_, pa.int64()), pa.array(label, pa.int32()), pa.array(text, pa.int64()), pa.array([held[k] for k in some], pa.binary())], names=["turn", "id", "label", "text", "features"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        rows = pd.DataFrame()
        for b in batches:  # no more than max_rows stay, in the order of training
            rows = pd.concat([rows, b], ignore_index=True).sort_values(["turn", "id", "label", "text"]).head(max_rows)
        if rows.empty:
            return
        split = lambda f: (np.frombuffer(f, "<u4", len(f) // 8).astype(np.int64), np.frombuffer(f, "<f4", offset=len(f) // 2).astype(float))
        model = ftrl([(*split(f), y) for f, y in zip(rows["features"], rows["label"], strict=True)], 1 << bits, **options)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias]})

    seen = rows.select(F.col("train_id").cast("long"), "train_text", "train_label", F.xxhash64("train_text").alias("train_hash"))
    seen = seen.mapInArrow(features, "turn long, id long, label int, text long, features binary")
    one = seen.dropDuplicates(["turn", "id", "label", "text"]).repartition(1)
    fitted = one.mapInPandas(learn, "weights binary, bias double").collect()  # one row
    if not fitted:
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0)
    return QualityModel(np.frombuffer(fitted[0]["weights"], np.float32), fitted[0]["bias"])


def score_block(model: QualityModel, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    buckets, at = block_features(raw, offs, int(model.weights.size).bit_length() - 1)
    n = np.diff(at)
    total = np.zeros(len(n))
    some = np.flatnonzero(n)
    if some.size:
        total[some] = np.add.reduceat(model.weights[buckets].astype(np.float64), at[some])
    return 1 / (1 + np.exp(-np.clip(total * WEIGHT / np.maximum(n, 1) + model.bias, -35, 35)))


def score(docs: DataFrame, model: QualityModel, keep: list[Column | str], text: str, column: str = "score") -> DataFrame:
    """The kept columns and the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights

    def compute(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, last, raw, offs in blocks(texts):
            yield first, last, [pa.array(score_block(shared.value, raw, offs))]

    return map_text(docs, keep, text, f"{column} double", compute)
