"""Operators 6, 7 and 9."""

import glob
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import queries
from weftline.llm.encode import PieceEncoder, default_tokenizer
from weftline.llm.mixing import fair_mix, mixed_amounts
from weftline.llm.packing import fill_window, pack, plan_windows
from weftline.llm.token_counts import encoded_lengths, length_quantiles, length_table, truncated_totals

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def enc():
    return PieceEncoder(default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aZé É'sdtl<|>endoftext ÀßÿĀIİıΣς́ͅ  \x1c\n\t09²½_-.!漢ⅷ×÷ªºﬁ", max_size=30), max_size=5))
def test_pieces_encode_as_whole_texts(texts):
    e = test_pieces_encode_as_whole_texts.__dict__.setdefault("enc", PieceEncoder(default_tokenizer()))
    for t, ids in zip(texts, e.batch(texts), strict=True):
        assert list(ids) == e.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(os.path.basename(p) for p in glob.glob(os.path.dirname(default_tokenizer()) + "/*.json")))
def test_any_tokenizer_encodes_whole_texts(name):
    e = PieceEncoder(os.path.join(os.path.dirname(default_tokenizer()), name))
    texts = ["two  spaces\tand a tab \n\n lines", " lead and tail ", "", "É日本 🌍 1234", "x" * 500, None]
    for t, ids in zip(texts, e.batch(texts), strict=True):
        assert list(ids) == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_piece_table_starts_anew(enc, monkeypatch):
    monkeypatch.setattr("weftline.llm.encode.MAX_PIECES", 3)
    for t in ("a b c d", "d e f g", "a z"):
        assert list(enc(t)) == enc.tokenizer.encode(t, add_special_tokens=False).ids


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        total = sum(w[s] for s in rest)
        left = budget - sum(full.values())
        over = [s for s in rest if left * w[s] / total > cap * sizes[s]] if total else []
        if not over:
            return full | {s: left * w[s] / total for s in rest}
        full |= {s: cap * sizes[s] for s in over}


def plain_queue(rows, quantum=128, share=1.5):
    """{(row, copy): (words, offset of the last packet)} of the mix, by a queue of packets; rows: (doc_id, text, lang, source)."""
    n = [len(WORD.findall(t or "")) for _, t, *_ in rows]
    sizes, queues = defaultdict(int), defaultdict(list)
    for r, (i, _, _, s) in enumerate(rows):
        sizes[s] += n[r]
        queues[s].append((hashlib.md5(f"{'' if i is None else i}|mix".encode()).hexdigest(), n[r], r))
    targets, packets = plain_targets(sizes), []
    for no, s in enumerate(sorted(queues, key=lambda s: (s is None, s))):
        sent = 0
        for copy in range(2):
            for _, size, r in sorted(queues[s]):
                for at in range(0, size, quantum):
                    sent += min(quantum, size - at)
                    packets.append((sent / targets[s], no, sent, min(quantum, size - at), r, copy))
    out, at, budget = {}, 0, int(share * sum(sizes.values()) + 1e-6)
    for _, _, _, words, r, copy in sorted(packets):
        if at < budget:
            out[r, copy] = (out.get((r, copy), (0, 0))[0] + min(words, budget - at), at)
        at += words
    return out


def test_mix(documents, odd_rows):
    rows = [r for r in odd_rows] + [(100 + i, "w " * (1 + i % 7), "en", f"s{i % 5}") for i in range(60)]
    got = mixed_amounts(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = plain_targets(sizes)
    by_id = {r[0]: r[3] for r in rows if r[0] is not None}
    for r in got:
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"]
        if r["mix_id"] is not None:
            assert r["mix_target"] == pytest.approx(targets[by_id[r["mix_id"]]]) and r["mix_source_size"] == sizes[by_id[r["mix_id"]]]
    taken = Counter()
    for (r, _), (words, _) in plain_queue(rows).items():
        taken[rows[r][0]] += words
    mine = Counter()
    for r in got:
        mine[r["mix_id"]] += r["mix_taken"]
    assert +mine == +taken and sum(mine.values()) == int(1.5 * sum(sizes.values()))
    assert sorted(map(tuple, mixed_amounts(documents(rows)).collect()), key=str) == sorted(map(tuple, got), key=str)


@pytest.mark.parametrize("quantum", [1, 3, 128])
def test_mix_is_the_queue(documents, quantum):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 400) if i % 9 else 3000), "en", ["a", "b", "c", "dd", None][int(rng.integers(5)) if i % 3 else 0]) for i in range(150)]
    _, mix = fair_mix(documents(rows), quantum=quantum)
    want = plain_queue(rows, quantum)
    out = mix.orderBy("mix_offset").collect()
    assert {(r["mix_id"], r["mix_copy"]): (r["mix_served"], r["mix_offset"]) for r in out} == {(rows[r][0], c): x for (r, c), x in want.items()}
    finish = [r["mix_finish"] for r in out]
    assert finish == sorted(finish)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t))
    for r in out:
        taken[rows[r["mix_id"]][3]] += r["mix_served"]
    for s, target in plain_targets(sizes).items():
        assert target - quantum <= taken[s] <= target * (1 + 5 * quantum / sum(taken.values())) + quantum


def test_mix_of_nothing(documents):
    assert mixed_amounts(documents([])).count() == 0
    only = mixed_amounts(documents([(1, None, None, None), (2, "", None, "a")])).collect()
    assert [(r["mix_size"], r["mix_taken"], r["mix_target"]) for r in only] == [(0, 0, 0.0)] * 2


def test_mix_sql(spark, sf, sql, same):
    same(queries.QUERIES["op7_source_mix"](spark, sf).toPandas(), sql(queries.SQL["op7_source_mix"]))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=8), st.integers(0, 60))
def test_fill_is_the_closest(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= capacity}
    filling = fill_window(counts, capacity)
    assert sum(k * n for k, n in filling.items()) == max(sums) and all(n <= counts[k] for k, n in filling.items())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 30), max_size=12))
def test_plan_uses_all(histogram):
    plan, used = plan_windows(histogram, 32), Counter()
    for times, filling in plan:
        assert times >= 1 and sum(k * n for k, n in filling.items()) <= 32
        for k, n in filling.items():
            used[k] += n * times
    assert used == Counter(histogram)


def check_packing(rows, got, enc, window):
    have = defaultdict(list)
    for i, t, *_ in rows:
        have[i].append(np.append(enc(t), 2).astype("<u4"))
    pieces = Counter()
    for texts in have.values():
        for ids in texts:
            for at in range(0, ids.size, window):
                part = ids[at : at + window]
                pieces[(at, part.size, zlib.crc32(part.tobytes()), ids.size)] += 1
    assert pieces == Counter((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return by_sequence


@pytest.mark.parametrize("window", [16, 4096, 32_768, 131_072])
def test_packing(documents, odd_rows, enc, window):
    rows = odd_rows + [(200 + i, "a b c " * (i % 9), "en", "a") for i in range(150)]
    check_packing(rows, pack(documents(rows), window=window, buckets=8).collect(), enc, window)


def test_packing_of_nothing(documents):
    assert pack(documents([])).count() == 0


def test_packing_with_ids(documents, enc):
    got = pack(documents([(1, "some words here", "en", "a")]), with_ids=True).collect()
    assert np.frombuffer(got[0]["ids"], "<u4").tolist() == [*enc("some words here"), 2]
    many = pack(documents([(i, "a b c " * (1 + i % 9), "en", "a") for i in range(60)]), with_ids=True, window=16).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in many) and len(many) > 60


def test_pack_query(spark, sf, enc):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op9_pack"](spark, sf).collect()
    sequences = check_packing(rows, got, enc, 4096)
    fills = [sum(n for _, n in parts) for parts in sequences.values()]
    padding = sum(0 if f & (f - 1) == 0 else 4096 - f for f in fills)
    assert padding <= 4096 + 0.01 * sum(fills)


def test_token_counts(documents, odd_rows, enc, spark):
    docs = documents(odd_rows)
    table = length_table(encoded_lengths(docs))
    lengths = np.array(sorted(enc(t).size + 1 for _, t, *_ in odd_rows))
    rows = table.orderBy("limit_tokens").collect()
    assert [r["limit_tokens"] for r in rows] == sorted(set(lengths.tolist()))
    for r in rows:
        x = r["limit_tokens"]
        assert (r["docs"], r["docs_fit"], r["docs_over"]) == ((lengths == x).sum(), (lengths <= x).sum(), (lengths > x).sum())
        assert (r["tokens_fit"], r["tokens_over"], r["truncated_tokens"]) == (lengths[lengths <= x].sum(), lengths[lengths > x].sum(), np.minimum(lengths, x).sum())
    for r in truncated_totals(table, [0, 1, 3, 77, 10**6]).collect():
        assert (r["truncated_tokens"], r["docs_over"], r["total_tokens"]) == (np.minimum(lengths, r["limit_tokens"]).sum(), (lengths > r["limit_tokens"]).sum(), lengths.sum())
    for r in length_quantiles(table, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == lengths[min(int(len(lengths) * r["quantile"]), len(lengths) - 1)]
    assert length_table(encoded_lengths(documents([]))).count() == 0


def test_token_counts_query(spark, sf, enc):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lengths = Counter(enc(t).size + 1 for t in texts)
    assert {r["limit_tokens"]: r["docs"] for r in queries.QUERIES["op6_token_counts"](spark, sf).collect()} == dict(lengths)
