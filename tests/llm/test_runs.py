"""Operator 13."""

import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import queries, queries_runs, runs, words


def plain_runs(w):
    """Every stretch of equal words p apart, for each p; of stretches with the same ends the least p."""
    n, least = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p) and j > i:
                least.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, k, p) for (s, k), p in least.items())


def plain_row(text):
    w = (text or "").encode().split()
    found = plain_runs(w)
    dropped = {i for s, k, p in found for i in range(s + p, s + k)}
    return found, b" ".join(x for i, x in enumerate(w) if i not in dropped).decode()


@st.composite
def periodic(draw):
    letters = draw(st.sampled_from(["a", "ab", "abc"]))
    parts = [draw(st.text(letters, min_size=1, max_size=8)) * draw(st.integers(1, 7)) for _ in range(draw(st.integers(1, 4)))]
    return "".join(parts)


@settings(max_examples=400, deadline=None)
@given(periodic(), st.integers(1, 4))
def test_runs_are_those_of_brute_force(w, chunk):
    before, runs.CHUNK = runs.CHUNK, chunk
    try:
        got = runs.find_runs(np.frombuffer(w.encode(), np.uint8).astype(np.uint64), len(w))
    finally:
        runs.CHUNK = before
    assert sorted(got) == plain_runs(w)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["a", "b", "é🌍"]), max_size=40).map(" \n ".join), st.just("aa " * 9), st.just("\t")), min_size=1, max_size=5))
def test_texts_of_a_block(texts):
    for first, last, raw, offs in words.blocks(pa.array(texts, pa.string())):
        found, collapsed = runs.block_runs(words.Words(raw, offs))
        assert (first, last) == (0, len(texts))
        for i, text in enumerate(texts):
            want, rest = plain_row(text)
            assert [r[1:] for r in found if r[0] == i] == want and collapsed[i].as_py() == rest


def test_long_texts_take_seconds():
    """One word only, two at random, and a word without fourth powers: n log n or so each, not n squared."""
    short, long = "a", "ab"
    while len(long) < 60_000:
        short, long = long, long + short
    for w in (np.zeros(60_000), np.random.default_rng(0).integers(0, 2, 60_000), np.frombuffer(long.encode(), np.uint8)):
        began = time.time()
        found = runs.find_runs(w.astype(np.uint64), w.size)
        assert time.time() - began < 30
    assert found == []  # the last has no fourth power
    assert runs.find_runs(np.zeros(60_000, np.uint64), 60_000) == [(0, 60_000, 1)]


def test_odd_rows(spark, documents, odd_rows):
    rows = [*odd_rows, (20, "x y " * 50_000, "en", "a"), (21, "go go go go go", "en", "a"), (21, "go go go go go go", "en", "a")]
    got = runs.periodic_runs(documents(rows), ["doc_id", "size"], "text").collect()
    shown = sorted((str(r["doc_id"]), [tuple(x) for x in r["runs"]], r["collapsed_text"], r["size"]) for r in got)
    want = [(str(i), *(([(0, 100_000, 2)], "x y") if i == 20 else plain_row(t)), "x") for i, t, _, _ in rows]
    assert shown == sorted(want)
    assert runs.periodic_runs(documents([]), ["doc_id"], "text").count() == 0


def plain_planted(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return text
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return b" ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n)).decode()


def test_planted_texts(spark, tmp_path):
    rows = [(i, t) for i in range(300) for t in [" ".join(f"w{k}" for k in range(i % 90))]] + [(None, "a b"), (8, None), (301, "")]
    got = queries_runs.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, t if i is None else plain_planted(i, t)) for i, t in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()
    for r in (r for r in out if r["doc_id"] in range(9, 300)):
        found, rest = plain_row(dict(want)[r["doc_id"]])
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (best[0] if best[0] is None else 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{k},{p}\n" for s, k, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(rest.encode()).hexdigest()
    assert sum(r["n_runs"] for r in out) > 5


@pytest.mark.parametrize("name", list(queries_runs.QUERIES))
def test_query(name, spark, sf, sql, same):
    same(queries.QUERIES[name](spark, sf).toPandas(), sql(queries.SQL[name]))
