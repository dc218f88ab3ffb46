"""Cases of the third round's findings: each failed before its finding was mended."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.plans import catalogue


@pytest.fixture
def against_sql(spark, same, tmp_path):
    """Holds a query against its SQL on tables made by SQL, a name and a statement each."""

    def check(query, **tables):
        con = duckdb.connect()
        for name, made in tables.items():
            con.sql(f"copy ({made}) to '{tmp_path}/{name}.parquet'")
            con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
        same(catalogue.QUERIES[query](spark, str(tmp_path)).toPandas(), con.execute(catalogue.SQL[query]).df())

    return check


def test_f1_throughput_of_no_time(against_sql):
    against_sql("throughput", events="select i::bigint event_id, [0.0, -0.0, 2.5, null][i + 1]::double as value from range(4) t(i)")


def test_f2_to_f8_losses_are_not_broadcast(spark, sf):
    """Rows that are exploded from short lists, whose size Spark takes for small, don't pass through the driver."""
    from weftline.operators import ngram_lm

    lists = spark.range(50).select("id", F.sequence(F.lit(1), F.lit(40)).alias("ids"))
    rows = ngram_lm.triples(lists, ["id"], F.col("ids"))
    met = ngram_lm.with_losses(rows, ngram_lm.fit(ngram_lm.triples(lists, [], F.col("ids"))))
    assert met.count() == 2000
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_f9_running_mean_adds_newest_first(spark):
    """To the last bit, with one task or many, and beyond the values that are added up one by one."""
    rows = [(run, step, (run * 37 + step * step * 13) % 9973 / 100) for run in range(3) for step in range(900)]
    got = metrics.debiased_ema(spark.createDataFrame(rows, "run long, step long, value double").coalesce(1), by="run").toPandas()
    x = {(run, step): v for run, step, v in rows}
    wrong = 0
    for r in got.itertuples():
        total = 0.0
        for lag in range(min(r.step + 1, 400)):
            total += (1 - 0.9) * x[r.run, r.step - lag] * math.pow(0.9, lag)
        wrong += total != r.ema
        assert math.isclose(total, r.ema, rel_tol=1e-13)
    # only rows soon after a task's first may add the older ones last
    assert len(got) == len(rows) and wrong < len(rows) // 4


def test_f10_steps_of_more_digits(against_sql):
    """Names of files hold whole steps."""
    against_sql("run_files", events="select i::bigint * 7000 event_id, i::bigint user_id, 'view' event_type from range(10) t(i)")


def test_f11_stream_of_files_in_any_order(spark, sql, same, sf, tmp_path):
    """Files whose times and keys go different ways."""
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    con = duckdb.connect()
    for i in range(3):
        con.sql(f"copy (select * from '{sf}/documents.parquet' where doc_id % 3 = {i} order by doc_id desc) to '{folder}/part-{i}.parquet'")
        os.utime(folder / f"part-{i}.parquet", (1_700_000_000 - 100 * i,) * 2)
    same(catalogue.QUERIES["stream_shards"](spark, str(tmp_path)).toPandas(), sql(catalogue.SQL["stream_shards"]))


def test_f12_scans_learn_from_all_findings(spark):
    """More findings than a task trains on: each is used once, in some part, and reruns give the same net."""
    from weftline.llm import secrets

    docs = spark.range(4500).select(F.concat(F.lit("see token = "), F.md5(F.col("id").cast("string")), F.lit(" there")).alias("text"))
    rows, parts = secrets.training_rows(docs)
    found = rows.filter(f"turn not between 0 and {secrets.MADE}")
    assert found.count() == found.select("turn").distinct().count() == 4500
    assert parts == rows.select("part").distinct().count() == 3
    a, b = (secrets.train_parts(rows, parts, epochs=2) for _ in range(2))
    assert (a.conv == b.conv).all() and (a.scale, a.thresholds) == (b.scale, b.thresholds)


def test_f17_only_bytes_before_the_stop_become_ids(spark, against_sql):
    """As few ids as a first sentence has, whatever follows; and the same results on odd texts."""
    against_sql("sample_stops", documents="select i::bigint doc_id, ['.', 'ab.', 'é.ü.', 'none', 'a..', repeat('x.', 1000)][i + 1] as text from range(6) t(i)")
    from weftline.operators import sampling

    texts = spark.createDataFrame([("ab." + "x" * 100_000,), ("none",), (None,)], "text string")
    assert [r[0] for r in texts.select(F.length(sampling.text_until_stop(F.col("text"), "."))).collect()] == [2, 4, 0]


def test_f18_a_listing_takes_more_sums_along(spark, tmp_path):
    """Lengths and sums of ids from the same scan."""
    from weftline.operators import corpus
    from weftline.sources import shards

    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"))
    shards.write_shards(corpus.byte_fragments(docs, 40), str(tmp_path / "s"))
    ids = F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i)).alias("id_sum")
    got = shards.list_shards(spark, str(tmp_path / "s"), "train", ids).collect()
    assert [(r["shard_id"], r["length"], r["id_sum"]) for r in got] == [(1, 40, 10 * (256 + 97 + 98 + 99))]


def test_f13_texts_are_coded_a_few_at_a_time(spark):
    """Lists of a batch are cut by what they hold, not by rows, and results stay those of one batch."""
    import pyarrow as pa

    from weftline.operators import bpe

    most = bpe.TEXTS_AT_ONCE
    sizes = [0, most // 2, most // 2, 1, most + 5, None, 3, most]
    lists = pa.array([None if n is None else [0] * n for n in sizes], pa.list_(pa.int32()))
    parts = list(bpe._few(iter([pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), lists], names=["key", "ids"])])))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6], [7]]
    ranks = bpe.merge_pairs({"ab": 3, " ab": 5, "é": 2}, 270)
    docs = spark.createDataFrame([(1, " ab" * most), (2, None), (3, "é ab"), (4, " ab" * 5)], "doc_id long, text string").coalesce(1)
    coded = bpe.encode(docs, ranks, keep=("text",))
    back = bpe.decode(coded, bpe.vocabulary(spark, ranks), keep=("text",), out="back")
    assert back.filter("back <=> coalesce(text, '')").count() == 4 and coded.agg(F.sum(F.size("ids"))).first()[0] == most + 2 + 5


def test_f14_a_budget_shuffles_no_text(spark):
    """The rows of a budget, with null and repeated keys and repeated rows, from thin rows."""
    from collections import Counter

    from weftline.operators import corpus

    rows = [(None, "null key"), (None, None), (None, "null key"), (3, "same"), (3, "same"), (3, "same"), (3, "other!"), (1, "a" * 30), (2, None), (2, ""), (5, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for cap, budget in ((4, 0), (4, 5), (4, 12), (100, 1), (100, 31), (100, 36), (100, 40), (100, 60), (100, 1000)):
        want = Counter((r["doc_id"], r["text"]) for r in corpus.capped_budget(docs, cap, budget).collect())
        assert Counter((r["doc_id"], r["text"]) for r in corpus.capped_texts(docs, cap, budget).collect()) == want
    plan = corpus.capped_texts(docs, 100, 40)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning" not in plan


def test_f15_chunks_are_merged_side_by_side():
    """Many chunks at once get the ids that each gets by itself."""
    import random

    from weftline.operators import bpe

    rng = random.Random(5)
    chunks = [c.encode() for c in {"".join(rng.choice("abné ") for _ in range(rng.randint(1, 70))) for _ in range(3000)}]
    trained = bpe.merge_pairs({t: i + 1 for i, t in enumerate(["banana", "bandana", "aaaa", "an", "nan", "abab", "éé", "naa"])}, 300)
    for ranks in (trained, {bytes([b]): b for b in range(256)}):
        assert bpe.encode_chunks(chunks, ranks, bpe.joins(ranks)) == [bpe.encode_chunk(c, ranks) for c in chunks]
    assert bpe.encode_chunks([], trained, bpe.joins(trained)) == []
    with pytest.raises(KeyError):
        bpe.encode_chunks([b"ab"], {b"a": 0}, bpe.joins({b"a": 0}))


def test_f16_rows_are_shuffled_once_for_a_running_sum(spark, tmp_path):
    """The parts' sums go to the rows, ids made in blocks are those of the expression, and a few tasks list the folders."""
    from weftline.operators import corpus, prefix
    from weftline.session import LISTERS_KEY
    from weftline.sources import shards

    texts = ["é" * 30, None, "", "ab" * 500, "x"] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    summed = prefix.running_sum(docs.select("doc_id", F.lit(2).cast("long").alias("n")), "n", [F.col("doc_id")], "off")
    assert summed.filter("off = 2 * doc_id").count() == len(texts)
    assert "hashpartitioning(part__" not in summed.drop("n")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    cut = corpus.byte_fragments(docs, 300)
    shown = lambda df: sorted((r["shard_id"], r["start"], r["doc_id"], tuple(r["ids"])) for r in df.collect())
    want = shown(corpus.with_ids(cut))
    assert shown(corpus.with_ids_in_blocks(cut)) == want and len(want) > corpus.IDS_ROWS
    before = spark.conf.get(LISTERS_KEY)
    shards.write_shards(cut, f"{tmp_path}/s")
    read = shards.read_shards(spark, f"{tmp_path}/s")
    assert shown(read) == want and spark.conf.get(LISTERS_KEY) == before
    stood = read.filter("stop <> start + size(ids)").count()
    assert stood == 0
