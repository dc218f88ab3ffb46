"""Operator 12."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import decontaminate as dc
from weftline.llm import queries, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    """(n_words, hit positions, ids) of each text."""
    wins = {}
    for i, t in items:
        w = plain_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if w else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for t in docs:
        w = plain_words(t)
        hit, ids = set(), set()
        for win, of in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= of
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=5), st.integers(1, 30))
def test_suffix_array(texts, depth):
    flat = [x for t in texts for x in t]
    ends = np.array([e for t, e in zip(texts, np.cumsum([len(t) for t in texts]), strict=True) for _ in t], np.int64)
    order = dc.suffix_array(np.array(flat, np.uint64), ends, depth)
    shown = [tuple(flat[i : min(ends[i], i + depth)]) for i in order]
    assert sorted(order.tolist()) == list(range(len(flat))) and shown == sorted(shown)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("aB é", max_size=30), min_size=1, max_size=4), st.lists(st.text("aB é", max_size=24), max_size=3))
def test_longest_matches_of_every_suffix(docs, items):
    known = dc.Items.of([(str(i), t) for i, t in enumerate(items)], 3)
    texts = [plain_words(t) for t in docs]
    for _, _, raw, offs in words.blocks(pa.array(docs, pa.string())):
        w = words.Words(raw, offs, dc.BETWEEN)
        _, _, order, found = dc.shard_hits(w, w.hashes(lower=True), known)
        suffixes = [x[k:] for x in map(plain_words, items) for k in range(len(x))]
        assert len(suffixes) == found.longest.size
        for s, n, low, high in zip(suffixes, found.longest, found.low, found.high, strict=True):
            lengths = {k for k in range(1, len(s) + 1) for t in texts for a in range(len(t)) if t[a : a + k] == s[:k] and len(t) >= a + k}
            assert n == max(lengths, default=0)
            places = [(i, a) for i, t in enumerate(texts) for a in range(len(t)) if n and t[a : a + n] == s[:n] and len(t) >= a + n]
            got = sorted((int(np.searchsorted(w.first, p, "right")) - 1, int(p)) for p in order[low:high]) if n else []
            assert got == sorted((i, a + int(w.first[i])) for i, a in places)


def rows_of(found):
    return sorted(((str(r["doc_id"]), r["n_words"], [k for s in r["hit_spans"] for k in range(s["first"], s["end"])], r["n_hit"], list(r["items"])) for r in found), key=str)


PASSAGE = "One two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "zero " + PASSAGE), (10, "alpha beta"), (3, PASSAGE), (None, "iota. iota! iota"), (4, None), (5, " .,"), (6, "ÉPSILON épsilon " * 8), (7, "word")]


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_odd_rows(spark, documents, odd_rows, monkeypatch, pass_bytes):
    """In one pass or in several."""
    monkeypatch.setattr(dc, "PASS_BYTES", pass_bytes)
    extra = [(30, f"before {PASSAGE.upper()}, after", "en", "a"), (31, f"{PASSAGE} zero {PASSAGE} {PASSAGE}", "en", "a"), (31, "two three four five six seven eight nine ten", "en", "a"),
             (32, "alpha beta. alpha, beta; beta alpha", "en", "a"), (33, "iota iota iota iota", "en", "a"), (34, "épsilon " * 40, "en", "b"), (35, "eleven twelve", "en", "b"), (36, "one two three four five six seven eight nine ten", "en", "b")]
    rows = [*odd_rows, *extra]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = dc.contamination(documents(rows), ["doc_id", "size", "kept"], "text", items).collect()
    want = [(str(i), n, hit, len(hit), ids) for (i, *_), (n, hit, ids) in zip(rows, plain([r[1] for r in rows], ITEMS), strict=True)]
    if pass_bytes > 60:
        assert rows_of(got) == sorted(want, key=str)
    else:  # stretches of unlike passes may overlap
        assert sorted((a, b, sorted(set(c)), d, e) for a, b, c, d, e in rows_of(got)) == sorted(want)
    assert {(r["size"], r["kept"]) for r in got} == {("x", "x")}
    left = dc.decontaminated(documents(rows), "text", items).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in left) == sorted(str(r[:2]) for r, w in zip(rows, want, strict=True) if not w[3])
    assert left[0].asDict().keys() == documents(rows).first().asDict().keys()


def test_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert dc.contamination(documents([]), ["doc_id"], "text", items).count() == 0
    r = dc.contamination(documents([(1, "a b", None, None)]), ["doc_id"], "text", items.limit(0)).first()
    assert (r["n_words"], r["n_hit"], r["items"]) == (2, 0, [])
    assert dc.longest_matches(documents([]), "doc_id", "text", items).count() == 0


@pytest.mark.parametrize("pass_bytes", [1 << 20, 60])
def test_longest_match_and_its_place(spark, documents, monkeypatch, pass_bytes):
    monkeypatch.setattr(dc, "PASS_BYTES", pass_bytes)
    docs = documents([(5, f"x {PASSAGE} y", None, None), (4, f"x y zero {PASSAGE}", None, None), (3, " ".join(PASSAGE.split()[1:]), None, None), (4, f"again zero {PASSAGE}", None, None)])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["item_id"]: tuple(r)[1:] for r in dc.longest_matches(docs.repartition(3), "doc_id", "text", items).collect()}
    assert got == {"1": (12, 0, 4, 2), "2": (13, 0, 4, 1), "3": (12, 0, 4, 2)}


def test_copies_by_the_thousand(spark, documents):
    """Thousands of copies of a text with a passage that many items share."""
    text = "front " + PASSAGE + " back"
    docs = documents([(i, text, "en", "a") for i in range(3000)])
    items = spark.createDataFrame([(i, PASSAGE + f" tail{i}") for i in range(300)], "item_id long, text string")
    got = dc.contamination(docs, ["doc_id"], "text", items)
    assert {(r["n_hit"], len(r["items"])) for r in got.collect()} == {(12, 300)}


def test_query(spark, sf, sql, same):
    got = queries.QUERIES["op12_decontaminate"](spark, sf).toPandas()
    same(got, sql(queries.SQL["op12_decontaminate"]))
    assert got["contaminated"].sum() > 0
