"""Byte-pair training and encoding against plain ones."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import SPECIALS
from weftline.operators import bpe
from weftline.plans import corpus_queries

EDGES = ["  x", "\u0085\u0085y", "a\r\n\r\nb", "it's IT'S I'LL we'ſ", "7 42 123 4567", "🌍é漢字", "<|bos|>", "", None, "   lead", "a--b!!\n\n", "é", "aaaaaaa", "aaaa aaaaa", "------------", "ababababab"]


def texts(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "e", "in", "ing", "a", "an", "é", "aa", "ab", "--", "漢"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    return [*EDGES, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n))]


def corpus(spark, n=150, seed=1, parts=5):
    return spark.createDataFrame(list(enumerate(texts(n, seed))), "doc_id long, text string").repartition(parts)


@pytest.mark.parametrize("segments", [30, 400, 20_000])
def test_distributed_training_equals_the_plain_one(spark, segments):
    """However small the driver's part of a round, and past the point where pairs occur once."""
    docs = corpus(spark, seed=segments)
    counts = {r["chunk"]: r["n"] for r in bpe.chunk_counts(docs).collect()}
    for size in (290,) if segments == 30 else (300, 900, 5000):
        ranks = bpe.train_bpe(docs, size, segments)
        assert ranks == bpe.merge_pairs(counts, size)
    assert segments == 30 or len(ranks) < 4991  # no pair is left


def test_the_driver_holds_no_more_than_its_part(spark, monkeypatch):
    held = []
    plain = bpe.greedy_merges

    def watched(words, *rest):
        held.append(sum(len(w) for w, _ in words))
        return plain(words, *rest)

    monkeypatch.setattr(bpe, "greedy_merges", watched)
    bpe.train_bpe(corpus(spark, 400), 700, 500)
    assert len(held) > 2 and max(held) <= 500


def test_empty_and_short_corpora(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bytes_only = {bytes([b]): b for b in range(256)}
    assert bpe.train_bpe(none, 300) == bytes_only == bpe.train_bpe(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string"), 265)
    assert list(bpe.train_bpe(spark.createDataFrame([(1, "aaa")], "doc_id long, text string"), 300))[256:] == [b"aa", b"aaa"]
    with pytest.raises(ValueError):
        bpe.train_bpe(none, 264)


def plain_encode(data, ranks):
    """Merges the neighbours whose join has the least rank, leftmost first, until none has one."""
    if data in ranks:
        return [ranks[data]]
    parts = [bytes([b]) for b in data]
    while True:
        able = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not able:
            return [ranks[p] for p in parts]
        _, i = min(able)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


TRAINED = bpe.merge_pairs({t: i + 1 for i, t in enumerate(["banana", "bandana", "aaaa", "an", "nan", "abab", "éé", "naa"])}, 300)


@settings(max_examples=500, deadline=None)
@given(st.text("abné", min_size=1, max_size=40))
def test_chunks_by_a_plain_encoder(chunk):
    assert bpe.encode_chunk(chunk.encode(), TRAINED) == plain_encode(chunk.encode(), TRAINED)


def test_a_long_chunk_takes_n_log_n():
    import time

    began = time.time()
    ids = bpe.encode_chunk(b"banana" * 50_000, TRAINED)
    assert time.time() - began < 30
    token = {i: t for t, i in TRAINED.items()}
    assert b"".join(token[i] for i in ids) == b"banana" * 50_000


def test_encoders_agree(spark):
    """In place, with a shared table, joined to a dictionary, and another library on the same ranks."""
    import tiktoken

    docs = corpus(spark).union(spark.createDataFrame([(None, "no id"), (3, "again"), (3, "again")], "doc_id long, text string"))
    ranks = bpe.train_bpe(docs, 600)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={s: len(ranks) + i for i, s in enumerate(SPECIALS)})
    shown = lambda df: sorted((str(r["doc_id"]), list(r["ids"])) for r in df.collect())
    want = sorted((str(r["doc_id"]), other.encode_ordinary(r["text"] or "")) for r in docs.collect())
    dictionary = bpe.chunk_dictionary(docs, ranks)
    assert shown(bpe.encode(docs, ranks)) == shown(bpe.encode(docs, ranks, known=bpe.frequent(dictionary))) == shown(bpe.encode_joined(docs, dictionary)) == want
    around = {str(k): v for k, v in shown(bpe.encode(docs, ranks, prepend=1, append=2).filter("doc_id < 16"))}
    assert around == {k: [1, *v, 2] for k, v in want if k in around} and len(around) == 16
    assert dictionary.count() == dictionary.select("chunk").distinct().count()
    with pytest.raises(Exception, match="not in the dictionary"):
        bpe.encode_joined(docs, dictionary.filter("chunk <> 'again'")).collect()


def test_each_distinct_chunk_is_encoded_once_a_batch(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "banana banana nan") for i in range(50)], "doc_id long, text string").coalesce(1)
    told = bpe.frequent(bpe.chunk_dictionary(docs, TRAINED))
    assert set(told) == {"banana", " banana", " nan"}
    want = [i for c in ("banana", " banana", " nan") for i in plain_encode(c.encode(), TRAINED)]
    # a shared table is used as it stands
    assert bpe.encode(docs, TRAINED, known=told).first()["ids"] == want
    assert bpe.encode(docs, TRAINED, known={**told, " nan": [7]}).first()["ids"][-1] == 7


def test_saved_vocabularies_and_special_tokens(spark, tmp_path):
    for first in (False, True):
        vocab = bpe.vocabulary(spark, TRAINED, specials_first=first)
        bpe.save_vocabulary(vocab, f"{tmp_path}/{first}")
        back = bpe.load_vocabulary(spark, f"{tmp_path}/{first}")
        assert bpe.ranks_of(back) == TRAINED and back.count() == len(TRAINED) + len(SPECIALS)
        start = 0 if first else len(TRAINED)
        assert [bpe.special_id(back, s) for s in SPECIALS] == list(range(start, start + 9)) and bpe.begin_id(back) == start
        assert back.filter("not is_special").agg(F.min("token_id")).first()[0] == (9 if first else 0)
    with pytest.raises(KeyError):
        bpe.special_id(back, "bos")
    other = back.filter("not is_special").union(spark.createDataFrame([(len(TRAINED) + 9, None, True, "<|endoftext|>", 0, 0)], back.schema))
    assert bpe.begin_id(other) == len(TRAINED) + 9
    with pytest.raises(KeyError):
        bpe.begin_id(back.filter("not is_special"))
    bpe.save_vocabulary(back.filter("token_id <> 20"), f"{tmp_path}/hole")
    with pytest.raises(ValueError):
        bpe.load_vocabulary(spark, f"{tmp_path}/hole")


def test_queries_train_once(spark, tmp_path, monkeypatch):
    corpus(spark, 40).write.parquet(f"{tmp_path}/documents.parquet")
    trained = []
    plain = bpe.train_bpe
    monkeypatch.setattr(bpe, "train_bpe", lambda *a: trained.append(a[1]) or plain(*a))
    sf = str(tmp_path)
    n = corpus_queries.bpe_train(spark, sf).count()
    ratios = corpus_queries.tok_compare(spark, sf).collect()
    whole = corpus_queries.bpe_roundtrip(spark, sf).first()
    words = corpus_queries.bpe_dictionary(spark, sf)
    assert trained == [corpus_queries.VOCAB] and n > 300 and len(ratios) == whole["n"] == whole["n_equal"] + 1  # the null text
    total = sum(r["our_tokens"] for r in ratios)
    assert words.select(F.sum(F.size(F.split("ids", ",")) * F.col("n"))).first()[0] == total
