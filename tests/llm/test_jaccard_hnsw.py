"""Operators 4 and 8."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import hnsw, jaccard, queries, words
from weftline.llm.graph import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    ws = (t or "").translate(LOWER).encode().split()
    return frozenset(tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))) if ws else frozenset()


def roots_of(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def plain_classes(rows, percent=75):
    """(id, size of the set, least id of the class) of each row, pair by pair."""
    sets = [shingles(t) for _, t in rows]
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[s].append(i)
    links = [(own[0], i) for s, own in groups.items() if s for i in own[1:]]
    holders = defaultdict(list)
    for s, own in groups.items():
        for g in s:
            holders[g].append(own[0])
    for s, own in groups.items():
        for j, k in Counter(j for g in s for j in holders[g]).items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                links.append((own[0], j))
    root = roots_of(links, range(len(rows)))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root[i]] = min(least.get(root[i], doc_id), doc_id)
    return sorted(((doc_id, len(sets[i]), least.get(root[i]) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)), key=str)


def check(docs, rows, **options):
    got = jaccard.similar_classes(docs, **options).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_classes(rows, options.get("percent", 75))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB é\n", max_size=60)), min_size=1, max_size=5))
def test_shingle_sets(texts):
    seen = {}
    for _, _, raw, offs in words.blocks(pa.array(texts, pa.string())):
        tokens, first = jaccard.shingle_sets(raw, offs, 5)
        for i, t in enumerate(texts):
            own = tokens[first[i] : first[i + 1]]
            assert len(own) == len(shingles(t)) and (np.diff(own.astype(object)) > 0).all()
            assert seen.setdefault(tuple(own.tolist()), shingles(t)) == shingles(t)


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=200), st.sets(st.integers(0, 400), min_size=1, max_size=200))
def test_signatures_bound_the_distance(a, b):
    x, y = (words.mix64(np.array(sorted(s), np.uint64)) for s in (a, b))
    p, q = jaccard._unsigned(jaccard.signature(x)), jaccard._unsigned(jaccard.signature(y))
    m = min(p.size, q.size)
    least = jaccard.least_distance(jaccard._folded(p, m), jaccard._folded(q, m), len(a), len(b))
    assert least <= 1 - len(a & b) / len(a | b) + 1e-12


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=10), min_size=2, max_size=12))
def test_links_in_a_region_connect_all(sets):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    all_links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    found = jaccard._links_in(arrays, 75)
    assert all((max(p), min(p)) in all_links for p in found)
    assert roots_of(found, range(len(sets))) == roots_of(all_links, range(len(sets)))


def near_rows(seed):
    """Chains of edits, copies, a passage that many share, short texts, and nested texts on the very edge of similarity."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, next_id = [], 0
    passage = [word() for _ in range(60)]
    for _ in range(12):
        text = [word() for _ in range(rng.randint(6, 120))]
        if rng.random() < 0.5:
            text += passage
        for _ in range(rng.randint(1, 12)):
            rows.append((next_id, " ".join(text)))
            next_id += rng.randint(1, 3)
            if rng.random() < 0.7:
                text = list(text)
                for _ in range(rng.randint(1, 1 + len(text) // 40)):
                    text[rng.randrange(len(text))] = word()
    whole = [word() for _ in range(44)]
    rows += [(next_id + n, " ".join(whole[:n])) for n in (44, 34, 33, 32, 25, 24)]
    rows += [(next_id + 100 + i, t) for i, t in enumerate(["a b c", "A B C", "a b c d", "b c", " a\tb\nc ", "one", "One"])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"hot": 2, "region": 4}), (3, {"region": 2}), (4, {"hot": 3}), (5, {"percent": 40, "region": 3}), (6, {"percent": 40}), (7, {"percent": 90, "region": 3}), (8, {"percent": 60, "hot": 3, "region": 6})])
def test_classes(spark, seed, options):
    rows = near_rows(seed)
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, node string, root string").repartition(5)
    check(docs, rows, **options)


def test_large_regions_are_split(spark, monkeypatch):
    """Texts that share a passage and texts around a few centres, in regions far above what a task joins."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = [(i, " ".join([word() for _ in range(8)] + passage[: 30 + i % 10] + [word() for _ in range(8)])) for i in range(120)]
    for c in range(3):
        centre = [word() for _ in range(60)]
        for i in range(60):
            text = list(centre)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(60)] = word()
            rows.append((1000 + 100 * c + i, " ".join(text)))
    large = []
    plain = jaccard._joined_regions
    monkeypatch.setattr(jaccard, "_joined_regions", lambda left, *rest: (large.append(max((r["n"] for r in left.groupBy("region").agg(F.count("*").alias("n")).collect()), default=0)), plain(left, *rest))[1])
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, region=24)
    assert large[0] <= 48  # of 120 that share the passage; dense parts are left to blocks


@pytest.mark.parametrize("summed", [2, 5, 64])
def test_sketch_is_the_count(spark, summed):
    rows = list({shingles(t): (i, t) for i, t in near_rows(9)}.values())  # tasks count equal sets once each
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    parts = jaccard.materialize(jaccard._nodes_and_sketch(docs, 5), "test-sketch")
    counts = np.zeros(1 << jaccard.SKETCH, np.int64)
    for _, _, own in jaccard._sets(pa.array([t for _, t in rows]), 5):
        np.add.at(counts, jaccard._cell(own), 1)
    assert np.array_equal(jaccard._sketch(parts, summed), jaccard._level(counts))


def test_possible_at_any_percent():
    rng = np.random.default_rng(12)
    for percent in (30, 45, 60, 75, 90):
        for _ in range(60):
            base = rng.choice(400, int(rng.integers(4, 200)), replace=False)
            sets = [np.unique(base[: max(1, int(len(base) * f))]) for f in (1, 0.95, 0.8, percent / 100 + 0.02, 0.31)]
            arrays = [words.mix64(x.astype(np.uint64)) for x in sets]
            ok = jaccard._possible([jaccard._unsigned(jaccard.signature(x)) for x in arrays], np.array([len(x) for x in sets]), percent)
            for i, a in enumerate(sets):
                if any(100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b)) for j, b in enumerate(sets) if j != i):
                    assert ok[i]


def test_odd_rows(documents, odd_rows):
    check(documents(odd_rows), [r[:2] for r in odd_rows])
    assert jaccard.similar_classes(documents([])).count() == 0
    lonely = [(1, None), (2, ""), (None, "null ids can link too right"), (None, "null ids can link too right")]
    check(documents([(*r, "en", "a") for r in lonely]), lonely)


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, x) for x in range(201, 230)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if e[0] != e[1]]
    assert got == roots_of(real, {x for e in real for x in e})
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_jaccard_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op8_jaccard_join"](spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_classes(rows)


def plain_nearest(vectors, k):
    """query -> [(score, id)] over all usable rows of the query's dimension."""
    good = [(i, np.array(v, float)) for i, v in vectors if i is not None and v is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            out[q] = sorted(((float((x * y).sum()), i) for i, y in good if i != q and y.size == x.size), key=lambda p: (-p[0], p[1]))[:k]
    return out


def vector_sets(n, dim=64):
    rng = np.random.default_rng(8)
    g = rng.standard_normal((n, dim))
    centres = rng.standard_normal((40, dim)) * rng.uniform(0.3, 3, (40, 1))
    return {
        "unit": g / np.linalg.norm(g, axis=1, keepdims=True),
        "gaussian": g,
        "unequal": g * np.exp(0.5 * rng.standard_normal((n, 1))),
        "clustered": centres[rng.integers(40, size=n)] + 0.1 * rng.standard_normal((n, dim)),
    }


@pytest.mark.parametrize("name", ["unit", "gaussian", "unequal", "clustered"])
def test_graph_recall(name):
    v = vector_sets(8192)[name]
    g = hnsw.Graph(hnsw.scaled(v))
    q = v[::40]
    found = g.search(hnsw.scaled(q), 96)
    score = q @ v.T
    true = np.argsort(-score, axis=1)[:, :21]
    got = np.take_along_axis(found, np.argsort(-np.take_along_axis(score, found, 1), axis=1)[:, :21], 1)
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 21 for a, b in zip(got, true, strict=True)]) > 0.93
    again = hnsw.Graph.of(hnsw.scaled(v), g.flat(), hnsw.DEGREE)
    assert np.array_equal(again.search(hnsw.scaled(q), 96), found)


def test_recall_of_full_shards(spark):
    """Shards of the size that tables of this size get, of unequal norms."""
    v = vector_sets(40_000)["unequal"]
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": list(v)}))
    got = hnsw.nearest(frame, F.col("vec_id") % 400 == 0).toPandas()
    hits = 0
    for q, rows in got.groupby("query_id"):
        score = v @ v[q]
        score[q] = -np.inf
        hits += len(set(rows["vec_id"]) & set(np.argsort(-score)[:20].tolist()))
    assert len(got) == 2000 and hits >= 0.9 * len(got)


def test_nearest(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * (1 + i % 3)]) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)]  # one frequent vector, queries among it
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [1.0, None] + [2.0] * 6), (2060, [float("nan")] * 8), (2080, [float("inf")] + [1.0] * 7), (2100, [1.0, 2.0]), (2120, [2.0, 1.0]), (2121, [1e200, -1e200]), (None, [3.0] * 8), (40, rows[40][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, shard string")
    got = hnsw.nearest(frame, F.col("vec_id") % 20 == 0, k=20, shard_bytes=128 * 64).collect()
    true = plain_nearest(rows[:-1], 20)
    by_query = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(by_query[r["query_id"]])
    assert set(by_query) == set(true)
    hits = 0
    for q, found in by_query.items():
        assert len(found) == len(true[q]) == len({i for _, i in found}) and q not in {i for _, i in found}
        assert found == sorted(found, key=lambda p: (-p[0], p[1]))
        vectors = dict(rows[:-1])
        assert all(s == pytest.approx(np.dot(vectors[q], vectors[i])) for s, i in found)
        hits += len({i for _, i in found} & {i for _, i in true[q]})
    assert hits >= 0.9 * 20 * len(true)
    assert [i for _, i in by_query[1000]][:5] == [i for _, i in true[1000]][:5]
    assert [i for _, i in by_query[2100]] == [2120, 2121] and [i for _, i in by_query[2120]] == [2121, 2100]


def test_few_and_no_vectors(spark):
    ddl = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], ddl)
    got = hnsw.nearest(few, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 2, 1.0), (0, 2, 1, 0.5)]
    assert hnsw.nearest(spark.createDataFrame([], ddl), F.col("vec_id") % 20 == 0).count() == 0
    assert hnsw.nearest(few, F.lit(False)).count() == 0
    same = spark.createDataFrame([(0, [1.0, 1.0])] + [(5, [1.0, 0.0])] * 40 + [(5, [2.0, 0.0]), (6, [0.5, 0.0])], ddl)
    got = hnsw.nearest(same, F.col("vec_id") % 20 == 0, k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(5, 2.0), (6, 0.5)]


def test_hnsw_query(spark, sf):
    got = queries.QUERIES["op4_hnsw_search"](spark, sf).toPandas()
    data = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    v, ids = np.stack(data["embedding"]).astype(float), data["vec_id"].to_numpy()
    hits, asked = 0, ids[ids % 20 == 0]
    for q in asked:
        score = v @ v[ids == q][0]
        best = sorted((-s, i) for s, i in zip(score, ids, strict=True) if i != q)[:20]
        hits += len({i for _, i in best} & set(got[got["query_id"] == q]["vec_id"]))
    assert len(got) == 20 * len(asked) and hits >= 0.9 * len(got)
