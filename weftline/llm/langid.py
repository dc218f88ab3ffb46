"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of the labelled texts by language and hash bucket; the smoothed log-probability
matrix (buckets x languages, of a fixed size) is broadcast, and texts are scored in batches: the rows of the matrix
for a text's n-grams are gathered and summed. Log-probabilities are held as whole multiples of 2**-16, so sums
do not depend on batches or order.

Texts are lower-cased; every run of characters other than letters counts as one space, and each text is
padded by one. Defined results: a text that is null, empty or without letters gets `und` and score 0; ties go to the first language
in code point order; rows with a null language do not train; repeated rows count each time; with no training row
all texts get `und`; very long texts are scored whole, in parts; other columns are not read.
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
from weftline.llm.encode import text_blocks, text_slices

ORDERS = (1, 2, 3)
BITS = 15
SCALE = 1 << 16
#: In training a bucket counts log(1 + times) for each text, in whole multiples of 1 / DAMP, so that one long text does not drown the rest.
DAMP = 1024
#: Positions gathered at once.
PART = 1 << 18


@dataclass
class LanguageModel:
    languages: list[str]
    matrix: np.ndarray  # buckets x languages, whole multiples of 1 / SCALE
    prior: np.ndarray


_LETTER = np.zeros(0, np.uint32)


def _letter_table() -> np.ndarray:
    """For each code point below 0x33480, its lower-case letter, or 32 for what is no letter."""
    global _LETTER
    if not _LETTER.size:
        table = np.full(0x33480, 32, np.uint32)
        for c in range(table.size):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER = table
    return _LETTER


def ngram_buckets(texts: list[str | None], orders=ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, offsets, letters): the buckets of text i are buckets[offsets[i]:offsets[i + 1]]; letters[i] counts its letters."""
    joined = "\n" + "\n".join((t or "").replace("\n", " ") for t in texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.flatnonzero(codes == 10)
    table = _letter_table()
    chars = table[np.minimum(codes, table.size - 1)]
    letter = chars != 32
    chars[breaks] = 10
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter stands for the run
    keep[breaks] = True
    at = np.flatnonzero(keep)
    c = chars[at].astype(np.uint64)
    ends = np.flatnonzero(c == 10)
    of = np.searchsorted(ends, np.arange(c.size), "left") - 1  # the text that a position belongs to
    sums = np.concatenate([[0], np.cumsum(letter)])
    letters = sums[breaks[1:]] - sums[breaks[:-1] + 1]
    c[ends] = 32
    found, owner = [], []
    inner = np.ones(c.size, bool)
    inner[ends] = False
    h = np.full(c.size, 14695981039346656037 & (2**64 - 1), np.uint64)
    # the separators stand for a space before the first and after the last character
    for n in range(1, max(orders) + 1):
        h = (h[: c.size - n + 1] ^ c[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if n in orders:
            if n == 1:
                ok = inner
            else:
                # no separator strictly inside, and some text character
                mark = np.cumsum(~inner)
                lo, hi = np.arange(h.size), np.arange(h.size) + n - 1
                within = mark[hi - 1] - mark[lo]
                ok = within == 0
                ok &= inner[lo] | (inner[hi] if n == 2 else True)
            pos = np.flatnonzero(ok)
            found.append(((h[pos] * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - bits)).astype(np.int64))
            owner.append(np.where(inner[pos], of[pos], of[np.minimum(pos + 1, c.size - 1)]))
    buckets, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.searchsorted(owner[order], np.arange(len(texts) + 1)), letters


def train(rows: DataFrame, text: str, lang: str, *, orders=ORDERS, bits: int = BITS, alpha: float = 0.05, sample_a_language: int | None = 20_000) -> LanguageModel:
    """rows: labelled texts. Fits on at most about sample_a_language rows of each language (by hash; None: all)."""
    rows = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if sample_a_language:
        share = F.lit(0.0)
        for name, n in sizes.items():
            share = F.when(F.col("lang") == name, F.lit(min(1.0, sample_a_language / n))).otherwise(share)
        unit = F.pmod(F.xxhash64("text", F.lit("langid")), F.lit(1 << 20)) / F.lit(1 << 20)
        rows = rows.filter(unit < share)
    languages = sorted(sizes)
    number = {name: i for i, name in enumerate(languages)}
    width = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), width), np.int64)
        for b in text_slices(batches):
            langs, texts = np.array([number[x] for x in b.column(0).to_pylist()], np.int64), b.column(1).to_pylist()
            for first, last in text_blocks(texts, PART):
                buckets, offs, _ = ngram_buckets(texts[first:last], orders, bits)
                cells, counts = np.unique(np.repeat(np.arange(last - first), np.diff(offs)) * width + buckets, return_counts=True)
                damped = np.round(np.log1p(counts) * DAMP).astype(np.int64)
                np.add.at(table, (langs[first:last][cells // width], cells % width), damped)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table.ravel()[at])], names=["cell", "n"])

    cells = rows.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets at most
    table = np.zeros((len(languages), width))
    table.ravel()[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64) / DAMP
    total = table.sum(1, keepdims=True)
    logp = np.log((table + alpha) / (total + alpha * width)) if languages else table
    n = np.array([sizes[x] for x in languages], float)
    prior = np.log(n / n.sum()) if languages else n
    return LanguageModel(languages, np.ascontiguousarray(np.round(logp.T * SCALE).astype(np.int32)), np.round(prior * SCALE).astype(np.int64))


def score_texts(model: LanguageModel, texts: list[str | None], orders=ORDERS, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    langs, scores = [], []
    for first, last in text_blocks(texts, PART):
        buckets, offs, letters = ngram_buckets(texts[first:last], orders, bits)
        sums = np.zeros((last - first, len(model.languages)), np.int64)
        filled = np.flatnonzero(np.diff(offs))
        for at in range(0, buckets.size, PART):
            to = min(buckets.size, at + PART)
            lo, hi = np.searchsorted(offs, at, "right") - 1, np.searchsorted(offs, to, "left")
            rows = filled[(filled >= lo) & (filled < hi)]
            if rows.size:
                cuts = np.maximum(offs[rows], at) - at
                sums[rows] += np.add.reduceat(model.matrix[buckets[at:to]], cuts, axis=0, dtype=np.int64)
        if not model.languages:
            langs += ["und"] * (last - first)
            scores.append(np.zeros(last - first))
            continue
        sums += model.prior
        best = sums.argmax(1)
        gap = (sums - sums[np.arange(len(sums)), best][:, None]) / SCALE
        p = 1 / np.exp(np.maximum(gap, -700)).sum(1)
        known = letters > 0
        langs += [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        scores.append(np.where(known, p, 0.0))
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def predict(docs: DataFrame, model: LanguageModel, keep: list[Column | str], text: str, orders=ORDERS, bits: int = BITS) -> DataFrame:
    """The kept columns, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits x languages

    def compute(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        langs, scores = score_texts(shared.value, texts.to_pylist(), orders, bits)
        yield 0, len(texts), [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return map_text(docs, keep, text, "lang_pred string, score double", compute)


def accuracy(frame: pd.DataFrame) -> float:
    known = frame[frame["lang"].notna()]
    return float((known["lang"] == known["lang_pred"]).mean())
