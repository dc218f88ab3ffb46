"""Operator 11."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import merkle, queries, queries_merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root and each leaf's siblings, level by level."""
    proofs, held, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, inside = [], []
        for a in range(0, len(level), 16):
            run = level[a : a + 16]
            for k in range(len(run)):
                for i in held[a + k]:
                    proofs[i] += run[:k] + run[k + 1 :]
            above.append(H(*run))
            inside.append([i for of in held[a : a + 16] for i in of])
        level, held = above, inside
    return level[0], proofs


def plain(rows):
    """(doc_id, leaf, subroot, root, proof) of rows (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault("" if r[1] is None else "=" + r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r[0]))
    names = sorted(groups, key=str.encode)
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = plain_tree([x[2] for x in groups[g]])
    root, above = plain_tree([trees[g][0] for g in names])
    return [(x[3], x[2], trees[g][0], root, H(*own, *up)) for g, up in zip(names, above, strict=True) for x, own in zip(groups[g], trees[g][1], strict=True)]


DDL = "doc_id long, source string, lang string, n_chars long, text string"


def made(spark, rows, more="leaf string, path string, place long, nodes long, group_ string, tie long"):
    extra = [c.split()[1] for c in more.split(", ")]
    return spark.createDataFrame([(*r, *("x" if k == "string" else 7 for k in extra)) for r in rows], f"{DDL}, {more}")


def built(docs):
    fields = [F.col(c) for c in queries_merkle.FIELDS]
    out = merkle.manifest(docs, F.col("source"), [F.col("doc_id")], merkle.row_digest(fields), [F.col("doc_id"), F.col("tie"), F.col("place")])
    out = out.withColumn("proof", F.sha2(merkle.siblings_of(F.col("path")), 256)).withColumn("up", merkle.folded(F.col("leaf"), F.col("path")))
    return out.collect()


def check(docs, rows):
    got = built(docs)
    assert sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got) == sorted((str(x[0]), *x[1:]) for x in plain(rows))
    assert all(r["up"] == r["root"] and (r["tie"], r["place"]) == (7, 7) for r in got)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4096, 4097, 4100])
def test_levels_and_proofs(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    root, proofs = plain_tree([x.hex() for x in leaves])
    levels = next(k for k in range(9) if 16**k >= n)
    paths = [[] for _ in leaves]
    assert merkle.traverse(leaves, levels, paths).hex() == root == merkle.traverse(leaves, levels).hex()
    assert [[s[i : i + 32].hex() for _, s in p for i in range(0, len(s), 32)] for p in paths] == proofs
    assert merkle.levels_of(n) == min(levels, merkle.LEVELS)


def test_odd_rows(spark, odd_rows):
    rows = [(i, s, g, None if t is None else len(t), t) for i, t, g, s in odd_rows]
    rows += [(i, "é🌍", "en", i, "t") for i in range(40)] + [(None, "\U0001f600", None, None, None), (None, "￮", "en", 1, "z")]
    check(made(spark, rows), rows)
    check(made(spark, rows[:1]), rows[:1])
    assert built(made(spark, [])) == []


def test_several_blocks_in_a_group_and_of_groups(spark):
    """More leaves than a block has in one group, equal ones among them, and more groups than a block has."""
    rng = random.Random(3)
    rows = [(i // 2 * 3, "hot", "en", i % 7, f"text {i % 5000}") for i in range(9000)] + [(5, "hot", None, None, "same")] * 500
    rows += [(i, f"s{i}", "en", 1, "t") for i in range(4200)] + [(i, None, None, 1, "t") for i in range(30)]
    rng.shuffle(rows)
    check(made(spark, rows).repartition(5), rows)


def test_tampering_shows(spark, tmp_path):
    rows = [(i, f"src{i % 3}", "en", 5, None if i % 11 == 0 else ("Text é" if i % 2 else "text é")) for i in range(200)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{tmp_path}/documents.parquet")
    want = {x[0]: x for x in plain(rows)}
    for r in queries.QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect():
        assert tuple(r)[:5] == want[r["doc_id"]]
        broken = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and rows[r["doc_id"]][4] == "Text é"
        assert r["verified"] == (not broken) == (r["folded_root"] == r["root"])


def test_query(spark, sf, sql, same):
    same(queries.QUERIES["op11_merkle_manifest"](spark, sf).toPandas(), sql(queries.SQL["op11_merkle_manifest"]))
