"""Queries on documents: budgets, token counts, shards, batches, byte vocabulary, trained tokenizers, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import byte_vocab as bv
from weftline.operators import bpe, corpus
from weftline.session import counted, materialize, new_path, scratch, table
from weftline.sources import shards
from weftline.streaming import token_stream

SIZE, BLOCK, LENGTH, RANKS = 100_000, 4096, 1024, 3
CAP, BUDGET = 10_000, 400_000
#: Goes in which documents arrive as a stream.
GOES = 8
#: The reference's training budget in characters and its vocabulary.
TRAIN_BUDGET, VOCAB = 2_000_000_000, 32_768


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def corpus_budget(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.capped_budget(docs(spark, sf), CAP, BUDGET).select("doc_id", "n", F.md5("text").alias("text_md5"))


def resume_skip(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.resume_after(docs(spark, sf), 100).select("doc_id", "seq")


def first_rows_concat(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.first_rows_joined(docs(spark, sf), 50).select(F.md5("text").alias("text_md5"), F.char_length("text").cast("long").alias("n"))


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.token_counts(docs(spark, sf))


def counted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that go into shards, counted on their way."""
    d, seen = counted(docs(spark, sf), f"documents-{uuid.uuid4().hex}")
    shards.write_shards(corpus.byte_fragments(materialize(d, "documents"), SIZE), new_path(spark, "shards"))
    return spark.createDataFrame([(seen.get["n"],)], "n long")


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.concat(F.array(F.lit(bv.BOS)), bv.byte_ids(F.col("text")))
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, i: a + i)
    return docs(spark, sf).withColumn("ids", ids).select("doc_id", F.size("ids").cast("long").alias("n"), total.alias("id_sum"), F.element_at("ids", -1).alias("last_id"))


def doc_tokens_specials_first(spark: SparkSession, sf: str) -> DataFrame:
    """doc_tokens in the layout whose special tokens come before the bytes; their ids are looked up by name."""
    vocab = bpe.vocabulary(spark, {bytes([b]): b for b in range(256)}, specials_first=True)
    begin, shift = bpe.begin_id(vocab), bpe.special_id(vocab, bv.SPECIALS[-1]) + 1
    ids = F.concat(F.array(F.lit(begin)), F.transform(bv.byte_ids(F.col("text")), lambda i: i + shift))
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, i: a + i)
    return docs(spark, sf).withColumn("ids", ids).select("doc_id", F.size("ids").cast("long").alias("n"), total.alias("id_sum"), F.element_at("ids", -1).alias("last_id"))


def decode_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("back", bv.bytes_text(bv.byte_ids(F.col("text"))))
    return d.agg(F.count("*").alias("n"), F.count_if(F.col("back") == F.col("text")).alias("n_equal"))


def _fragments(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.shard_fragments(corpus.stream_offsets(docs(spark, sf)), SIZE)


def shard_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.shard_summary(_fragments(spark, sf))


def shard_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return _fragments(spark, sf).select("shard_id", "split", "doc_id", "start", "tokens")


def shard_files(spark: SparkSession, sf: str) -> DataFrame:
    """Shards written, listed by split, and read back."""
    path = new_path(spark, "shards")
    with scratch(spark):  # what the shards are made from goes when they are written
        shards.write_shards(corpus.byte_fragments(docs(spark, sf), SIZE), path)
    total = F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i)).alias("id_sum")
    out = shards.list_shards(spark, path, "val", total).union(shards.list_shards(spark, path, "train", total))
    return out.select(shards.shard_name(F.col("split"), F.col("shard_id")).alias("name"), "split", F.col("shard_id").cast("long").alias("shard_id"), F.col("length").cast("long").alias("length"), "id_sum")


def _indexed_shards(spark: SparkSession, sf: str) -> str:
    path = new_path(spark, "shards")
    with scratch(spark):  # what the shards are made from goes when they are written
        shards.write_shards(corpus.byte_fragments(docs(spark, sf), SIZE), path)
    shards.write_index(spark, path)
    return path


def shard_index(spark: SparkSession, sf: str) -> DataFrame:
    index = shards.read_index(spark, _indexed_shards(spark, sf))
    return index.select("split", F.col("shard_id").cast("long").alias("shard_id"), "row_group", "first_token", "end_token", "fragments")


def resume_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of stored shards from a checkpoint on, read through the index; the first shard is for validation and is left out."""
    rows = shards.resumed_batches(spark, _indexed_shards(spark, sf), 1, 3 * BLOCK, BLOCK, RANKS, LENGTH, "train")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, i: a + i)
    return rows.select(F.col("shard_id").cast("long").alias("shard_id"), "rank", "batch_no", "row_no", total("x").alias("x_sum"), total("y").alias("y_sum"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return shard_summary(spark, sf).select("shard_id", F.col("tokens").alias("length"))


def loader_batches(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.loader_batches(_lengths(spark, sf), BLOCK, RANKS)


def loader_resume(spark: SparkSession, sf: str) -> DataFrame:
    b = loader_batches(spark, sf)
    return b.filter((F.col("shard_id") > 1) | ((F.col("shard_id") == 1) & (F.col("first") >= 3 * BLOCK)))


def batch_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.batch_rows(corpus.byte_fragments(docs(spark, sf), SIZE), loader_batches(spark, sf), BLOCK, LENGTH)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, i: a + i)
    return rows.select("shard_id", "rank", "batch_no", "row_no", F.size("x").alias("n"), total("x").alias("x_sum"), total("y").alias("y_sum"), F.element_at("x", 1).alias("x_first"), F.element_at("y", -1).alias("y_last"))


def next_token_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.next_token_pairs(docs(spark, sf), SIZE)


def _used(spark: SparkSession, sf: str) -> DataFrame:
    """The byte vocabulary with the uses of each token in the stream of all documents."""
    counted = docs(spark, sf).select(F.explode(F.concat(F.array(F.lit(bv.BOS)), bv.byte_ids(F.col("text")))).alias("token_id")).groupBy("token_id").agg(F.count("*").alias("uses"))
    return bv.vocabulary(spark).join(counted, "token_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))


def token_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _used(spark, sf).select("token_id", "is_special", "special", "n_bytes", "raw_bytes", "uses")


def token_bytes_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Of the tokens that the corpus uses."""
    return bpe.token_byte_stats(_used(spark, sf).filter("uses > 0"))


def bpe_pretokenize(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).withColumn("c", bpe.chunks(F.col("text")))
    return d.select("doc_id", F.size("c").alias("n_chunks"), (F.array_join("c", "") == F.col("text")).alias("whole"))


#: Where an application keeps the vocabulary trained on a corpus.
_trained: dict[tuple[str, str], str] = {}


def trained_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary of a corpus, trained once an application, stored, and read back by every query."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        ranks = bpe.train_bpe(corpus.capped_texts(docs(spark, sf), CAP, TRAIN_BUDGET), VOCAB)
        path = new_path(spark, "vocabulary")
        bpe.save_vocabulary(bpe.vocabulary(spark, ranks), path)
        _trained[key] = path
    return bpe.load_vocabulary(spark, _trained[key])


def bpe_train(spark: SparkSession, sf: str) -> DataFrame:
    return trained_vocabulary(spark, sf).select("token_id", F.hex("bytes").alias("bytes_hex"), "is_special", "special", "n_bytes", "raw_bytes")


def bpe_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct chunk of the corpus with its tokens."""
    d = bpe.chunk_dictionary(docs(spark, sf), bpe.ranks_of(trained_vocabulary(spark, sf)))
    return d.select(F.hex(F.encode("chunk", "UTF-8")).alias("chunk_hex"), "n", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def tok_compare(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.ranks_of(trained_vocabulary(spark, sf))
    # thin rows, made here, for it holds batches of texts to few rows
    ours = materialize(bpe.compression(docs(spark, sf), ranks), "compression").withColumn("base_tokens", F.col("bytes"))
    return bpe.comparison(ours, "doc_id", "tokens")


def tok_compare_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The byte vocabulary against a token for each character."""
    d = corpus.token_counts(docs(spark, sf).withColumn("doc_id", F.struct("doc_id", F.char_length("text").cast("long").alias("chars"))))
    d = d.select("doc_id.doc_id", "n_tokens", "n_bytes", "doc_id.chars")
    return bpe.comparison(d, "doc_id", "n_tokens", "chars", "n_bytes")


def bpe_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d, vocab = docs(spark, sf), trained_vocabulary(spark, sf)
    back = bpe.decode(bpe.encode(d, bpe.ranks_of(vocab), keep=("text",)), vocab, keep=("text",), out="back")
    # made here, for it holds batches of texts and ids to few rows
    return materialize(back.agg(F.count("*").alias("n"), F.count_if(F.col("back") == F.col("text")).alias("n_equal")), "roundtrip")


def odd_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of all documents with null and repeated keys and null texts: every token once, whatever the order of rows with one key."""
    d = docs(spark, sf).select(F.when(F.col("doc_id") % 7 != 0, F.call_function("div", F.col("doc_id"), F.lit(3))).alias("doc_id"), F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("text"))
    f = corpus.token_fragments(d, SIZE)
    return f.groupBy("shard_id", "split").agg(F.sum(F.size("ids")).cast("long").alias("tokens"), F.min("start").alias("first_token"))


def stream_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "stream")
    token_stream.run_ordered(docs(spark, sf).select("doc_id", "text"), out, SIZE, GOES)
    return corpus.shard_summary(token_stream.streamed_fragments(spark, out))


_O = """o as (select doc_id, text, strlen(text) + 1 n,
  coalesce(sum(strlen(text) + 1) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint off from documents),
f as (select doc_id, text, n, off, unnest(range(off // {N}, (off + n - 1) // {N} + 1)) k from o),
s as (select k shard_id, sum(least(off + n, (k + 1) * {N}) - greatest(off, k * {N}))::bigint length from f group by k)""".replace("{N}", str(SIZE))
_LOADER = f"""b as (select shard_id, r rank, unnest(range(greatest(1, ((length - 1) // {BLOCK} - r) // {RANKS})))::bigint batch_no
  from s cross join (select unnest(range({RANKS}))::int r) where length >= {BLOCK} * (r + 1) + 1),
l as (select shard_id, rank, batch_no, {BLOCK} * (rank + batch_no * {RANKS}) as first, {BLOCK} * (rank + batch_no * {RANKS}) + {BLOCK} as last from b)"""
_BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda i: ('0x' || i)::int)"
#: One row for each token of the stream: p is its place in its shard.
_TOKENS = f"""tok as (select doc_id, off, unnest(list_prepend(256, {_BYTES.format(t="text")})) t, unnest(range(0, n)) i from o),
pos as (select (off + i) // {SIZE} shard_id, (off + i) % {SIZE} p, t from tok)"""
_SUMMARY = f"""with {_O} select k shard_id, case when k = 0 then 'val' else 'train' end split,
  sum(least(off + n, (k + 1) * {SIZE}) - greatest(off, k * {SIZE}))::bigint tokens, count(*) fragments, min(doc_id) first_doc, max(doc_id) last_doc from f group by k"""
_NAMES = ", ".join(f"'{s}'" for s in bv.SPECIALS)

SQL = {
    "corpus_budget": f"""with c as (select doc_id, substr(text, 1, {CAP}) t from documents),
      s as (select doc_id, t, length(t)::bigint n, coalesce(sum(length(t)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) b from c)
      select doc_id, n, md5(t) text_md5 from s where b < {BUDGET}""",
    "resume_skip": "select * from (select doc_id, row_number() over (order by doc_id) - 1 seq from documents) where seq >= 100",
    "first_rows_concat": "select md5(string_agg(text, chr(10) order by doc_id)) text_md5, length(string_agg(text, chr(10) order by doc_id))::bigint n from (select * from documents order by doc_id limit 50)",
    "token_counts": "select doc_id, (1 + strlen(text))::bigint n_tokens, strlen(text)::bigint n_bytes, strlen(text)::double / (1 + strlen(text)) ratio from documents",
    "doc_tokens": f"""with b as (select doc_id, text, {_BYTES.format(t="text")} ids from documents)
      select doc_id, (1 + strlen(text))::bigint n, (256 + coalesce(list_sum(ids), 0))::bigint id_sum, coalesce(ids[-1], 256)::int last_id from b""",
    "counted_rows": "select count(*) n from documents",
    "doc_tokens_specials_first": f"""with b as (select doc_id, text, {_BYTES.format(t="text")} ids from documents)
      select doc_id, (1 + strlen(text))::bigint n, (coalesce(list_sum(ids), 0) + 9 * strlen(text))::bigint id_sum, coalesce(ids[-1] + 9, 0)::int last_id from b""",
    "decode_roundtrip": "select count(*) n, count(*) n_equal from documents",
    "shard_summary": _SUMMARY,
    "shard_fragments": f"""with {_O} select k shard_id, case when k = 0 then 'val' else 'train' end split, doc_id, greatest(off, k * {SIZE}) - k * {SIZE} as start,
      least(off + n, (k + 1) * {SIZE}) - greatest(off, k * {SIZE}) tokens from f""",
    "shard_files": f"""with {_O}, {_TOKENS} select 'tokens_' || case when shard_id = 0 then 'val' else 'train' end || '_' || lpad(shard_id::varchar, 6, '0') as name,
      case when shard_id = 0 then 'val' else 'train' end split, shard_id, count(*) length, sum(t)::bigint id_sum from pos group by shard_id""",
    "loader_batches": f"with {_O}, {_LOADER} select shard_id, rank, batch_no, first, last from l",
    "loader_resume": f"with {_O}, {_LOADER} select shard_id, rank, batch_no, first, last from l where shard_id > 1 or (shard_id = 1 and first >= {3 * BLOCK})",
    "batch_rows": f"""with {_O}, {_LOADER}, {_TOKENS},
      cut as (select l.shard_id, rank, batch_no, r::int row_no, first + r * {LENGTH} lo from l cross join (select unnest(range({BLOCK // LENGTH})) r)),
      hit as (select cut.*, pos.p - lo q, t from pos join cut on pos.shard_id = cut.shard_id and pos.p // {LENGTH} = lo // {LENGTH}
              union all select cut.*, {LENGTH}, t from pos join cut on pos.shard_id = cut.shard_id and pos.p = lo + {LENGTH})
      select shard_id, rank, batch_no, row_no, count(*) filter (q < {LENGTH})::int n, sum(t) filter (q < {LENGTH})::bigint x_sum, sum(t) filter (q > 0)::bigint y_sum,
        max(t) filter (q = 0)::int x_first, max(t) filter (q = {LENGTH})::int y_last from hit group by 1, 2, 3, 4""",
    "shard_index": f"""with {_O}, p as (select k, greatest(off, k * {SIZE}) - k * {SIZE} a, least(off + n, (k + 1) * {SIZE}) - k * {SIZE} e from f),
      r as (select *, ((row_number() over (partition by k order by a) - 1) // {shards.GROUP})::bigint row_group from p)
      select case when k = 0 then 'val' else 'train' end split, k shard_id, row_group, min(a) first_token, max(e) end_token, count(*) fragments from r group by k, row_group""",
    "resume_rows": f"""with {_O}, {_LOADER}, {_TOKENS},
      kept as (select * from l where shard_id > 1 or (shard_id = 1 and first >= {3 * BLOCK})),
      cut as (select kept.shard_id, rank, batch_no, r::int row_no, first + r * {LENGTH} lo from kept cross join (select unnest(range({BLOCK // LENGTH})) r)),
      hit as (select cut.*, pos.p - lo q, t from pos join cut on pos.shard_id = cut.shard_id and pos.p // {LENGTH} = lo // {LENGTH}
              union all select cut.*, {LENGTH}, t from pos join cut on pos.shard_id = cut.shard_id and pos.p = lo + {LENGTH})
      select shard_id, rank, batch_no, row_no, sum(t) filter (q < {LENGTH})::bigint x_sum, sum(t) filter (q > 0)::bigint y_sum from hit group by 1, 2, 3, 4""",
    "next_token_bigrams": f"""with {_O}, {_TOKENS}, nx as (select t token_id, lead(t) over (partition by shard_id order by p) next_id from pos)
      select token_id::int token_id, next_id::int next_id, count(*) n from nx where next_id is not null group by 1, 2""",
    "token_bytes": f"""with u as (select unnest(list_prepend(256, {_BYTES.format(t="text")})) i from documents), n as (select i, count(*) uses from u group by i)
      select v.i::int token_id, v.i >= 256 is_special, case when v.i >= 256 then ([{_NAMES}])[(v.i - 255)::int] end special, (case when v.i < 128 then 1 when v.i < 256 then 3 else 0 end)::int n_bytes,
        (case when v.i < 256 then 1 else 0 end)::int raw_bytes, coalesce(uses, 0) uses from (select unnest(range(265)) i) v left join n using (i)""",
    "token_bytes_stats": f"""with v as (select case when i < 128 then 1 else 3 end b from (select distinct unnest({_BYTES.format(t="text")}) i from documents))
      select count(*) n, min(b) min_bytes, max(b) max_bytes, avg(b) mean_bytes, stddev_samp(b) std_bytes from v""",
    "bpe_roundtrip": "select count(*) n, count(*) n_equal from documents",
    "stream_shards": _SUMMARY,
    "tok_compare_plain": """with t as (select doc_id, (1 + strlen(text))::bigint our_tokens, length(text)::bigint base_tokens, strlen(text) b from documents),
      r as (select doc_id, our_tokens, b / our_tokens our_ratio, base_tokens, b / nullif(base_tokens, 0) base_ratio from t)
      select *, 100 * ((base_tokens - our_tokens) / nullif(base_tokens, 0)) relative_diff, case when base_ratio > our_ratio then 'Base' when our_ratio > base_ratio then 'Ours' else 'Tie' end better from r""",
    "odd_stream": f"""with n as (select sum(1 + case when doc_id % 11 <> 0 then strlen(text) else 0 end)::bigint n from documents), k as (select unnest(range((n + {SIZE} - 1) // {SIZE})) k, n from n)
      select k shard_id, case when k = 0 then 'val' else 'train' end split, least({SIZE}, n - k * {SIZE})::bigint tokens, 0::bigint first_token from k""",
}

QUERIES = {
    f.__name__: f
    for f in (
        shard_summary, corpus_budget, resume_skip, first_rows_concat, token_counts, counted_rows, doc_tokens, doc_tokens_specials_first, decode_roundtrip, shard_fragments, shard_files, shard_index, resume_rows, loader_batches, loader_resume,
        batch_rows, next_token_bigrams, token_bytes, token_bytes_stats, bpe_pretokenize, bpe_train, bpe_dictionary, tok_compare, tok_compare_plain, bpe_roundtrip, stream_shards, odd_stream,
    )
}
