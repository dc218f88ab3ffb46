"""Queries on the losses of a language model that is fitted on nine tenths of `documents` and judged on the rest: bits per byte, losses by
document, and multiple choice: which of four passages continues a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import byte_vocab as bv
from weftline.operators import choices, metrics, ngram_lm
from weftline.operators.prefix import numbered
from weftline.plans.event_queries import micro, micro_sql
from weftline.plans.metric_queries import CLASS
from weftline.session import materialize, new_path, table
from weftline.sources import chat_lines, runs

#: Documents whose id this divides are held out. Characters of a context and of an ending.
HELD, CONTEXT, ENDING = 10, 64, 32


def _held() -> F.Column:
    return F.coalesce(F.col("doc_id") % HELD == 0, F.lit(False))


def fitted(spark: SparkSession, sf: str) -> ngram_lm.Model:
    return ngram_lm.fit(ngram_lm.triples(table(spark, sf, "documents").filter(~_held()), []))


def document_losses(spark: SparkSession, sf: str) -> DataFrame:
    held = ngram_lm.triples(table(spark, sf, "documents").filter(_held()), ["doc_id"])
    return ngram_lm.document_losses(held, fitted(spark, sf), "doc_id")


def bits_per_byte(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bits_per_byte(document_losses(spark, sf), bv.vocabulary(spark))


def loss_by_document(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens, summed and mean loss of each held-out document with a token."""
    total = F.sum(F.col("n") * F.col("loss"))
    sums = document_losses(spark, sf).groupBy("doc_id").agg(F.sum("n").alias("n"), total.alias("loss_sum"))
    return sums.withColumn("loss_mean", F.col("loss_sum") / F.col("n")).select("doc_id", "n", micro("loss_sum"), micro("loss_mean"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """item, label, ctx, endings: the beginning of each held-out document, and what follows in it and in the next three, the right one at
    the place that its number says."""
    long = table(spark, sf, "documents").filter(_held() & (F.char_length("text") >= CONTEXT + ENDING))
    part = long.select("doc_id", F.substring("text", 1, CONTEXT).alias("ctx"), F.substring("text", CONTEXT + 1, ENDING).alias("ending"))
    d = materialize(numbered(part, ["doc_id"], "item"), "items")
    n = d.count()
    asked = d.select("item", "ctx", (F.col("item") % 4).cast("int").alias("label"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift"))
    asked = asked.withColumn("choice", F.pmod(F.col("label") + F.col("shift"), F.lit(4))).withColumn("of", F.pmod(F.col("item") + F.col("shift"), F.lit(max(n, 1)).cast("long")))
    met = asked.join(d.select(F.col("item").alias("of"), "ending").hint("shuffle_merge"), "of")
    return met.groupBy("item", "label", "ctx").agg(F.transform(F.array_sort(F.collect_list(F.struct("choice", "ending"))), lambda x: x["ending"]).alias("endings"))


def stored_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items, written as JSON lines and read back."""
    path = new_path(spark, "items")
    items(spark, sf).select(F.to_json(F.struct(F.col("item").alias("ind"), "ctx", "endings", "label")).alias("value")).write.text(path)
    return chat_lines.read_completion_lines(spark, path).select(F.col("ind").cast("int").alias("item"), "ctx", "endings", "label")


def _joined(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def mc_completion_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return choices.completion_tokens(stored_items(spark, sf)).select("item", "choice", "label", F.size("ids").cast("long").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"), F.md5(_joined(F.col("mask"))).alias("mask_md5"))


def _choice_losses(spark: SparkSession, sf: str) -> DataFrame:
    t = choices.completion_tokens(stored_items(spark, sf))
    placed = ngram_lm.placed_triples(t, ["item", "choice", "label", "mask"], F.col("ids")).withColumn("mask", F.get("mask", F.col("pos")))
    return choices.masked_losses(ngram_lm.with_losses(placed.filter("mask = 1"), fitted(spark, sf)))


def _preds(spark: SparkSession, sf: str) -> DataFrame:
    return choices.predictions(_choice_losses(spark, sf))


def mc_losses(spark: SparkSession, sf: str) -> DataFrame:
    return _choice_losses(spark, sf).select("item", "choice", "label", micro("loss_sum"), micro("loss_mean"))


def mc_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _preds(spark, sf)


def mc_running(spark: SparkSession, sf: str) -> DataFrame:
    return choices.running_accuracy(materialize(_preds(spark, sf), "predictions"))


def mc_first(spark: SparkSession, sf: str) -> DataFrame:
    """The running accuracies up to the twentieth item, which is the last that counts."""
    return choices.first_items(mc_running(spark, sf), 20)


def mc_classes(spark: SparkSession, sf: str) -> DataFrame:
    return choices.class_report(_preds(spark, sf))


def mc_report(spark: SparkSession, sf: str) -> DataFrame:
    return choices.accuracy_report(materialize(_preds(spark, sf), "predictions"))


def eval_result(spark: SparkSession, sf: str) -> DataFrame:
    """The report as a JSON file, read back."""
    path = new_path(spark, "result")
    runs.write_result(mc_report(spark, sf), path)
    return spark.read.json(path).select("num_total", "num_correct", "num_correct_norm", "acc", "acc_norm", "macro_f1")


_D = ngram_lm.DISCOUNT
_BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda i: ('0x' || i)::int)"


def _triples_sql(rows: str, keep: str, ids: str) -> str:
    """keep, pos, a, b, c of the tokens of rows."""
    return f"""(select {keep}, pos, coalesce(lag(t, 2) over w, {bv.BOS}) a, coalesce(lag(t, 1) over w, {bv.BOS}) b, t c
      from (select {keep}, unnest({ids}) t, unnest(range(0, len({ids}))) pos from {rows}) window w as (partition by {keep} order by pos))"""


#: Counts as in ngram_lm.fit; loss(a, b, c) of wanted triples, which `want` holds, as `lost`.
_MODEL = f"""abc as (select a, b, c, count(*) n from {_triples_sql("documents where doc_id % 10 <> 0", "doc_id", _BYTES.format(t="text"))} group by all),
ab as (select a, b, sum(n) n, count(*) k from abc group by all), bc as (select b, c, count(*) n from abc group by all), b as (select b, sum(n) n, count(*) k from bc group by all),
c as (select c, count(*) n from bc group by all), z as (select sum(n) n, count(*) k from c),
p1 as (select want.a, want.b, want.c, (greatest(coalesce(c.n, 0) - {_D}::double, 0) + {_D}::double * z.k / {ngram_lm.TOKENS}) / z.n p from (select distinct a, b, c from want) want left join c using (c) cross join z),
p2 as (select p1.a, p1.b, p1.c, case when b.n > 0 then (greatest(coalesce(bc.n, 0) - {_D}::double, 0) + {_D}::double * b.k * p) / b.n else p end p from p1 left join bc using (b, c) left join b using (b)),
lost as (select p2.a, p2.b, p2.c, -ln(case when ab.n > 0 then (greatest(coalesce(abc.n, 0) - {_D}::double, 0) + {_D}::double * ab.k * p) / ab.n else p end) loss from p2 left join abc using (a, b, c) left join ab using (a, b))"""
_HELD = f"want as (select doc_id, a, b, c from {_triples_sql('documents where doc_id % 10 = 0', 'doc_id', _BYTES.format(t='text'))})"
_ITEMS = f"""d as (select row_number() over (order by doc_id) - 1 item, count(*) over () n, substr(text, 1, {CONTEXT}) ctx, substr(text, {CONTEXT + 1}, {ENDING}) ending
  from documents where doc_id % {HELD} = 0 and length(text) >= {CONTEXT + ENDING}),
q as (select d.item, (d.item % 4)::int label, ((d.item + s) % 4)::int choice, d.ctx, e.ending from d cross join (select unnest(range(4)) s) join d e on e.item = (d.item + s) % d.n),
x as (select item, label, choice, ctx || ' ' || ending t, strlen(ctx) h from q)"""
_ASKED = f"want as (select * from {_triples_sql('x', 'item, choice, label, h', _BYTES.format(t='t'))} where pos >= h)"
_LOSS = f"with {_ITEMS}, {_ASKED}, {_MODEL}, s as (select item, choice, label, sum(loss) loss_sum, avg(loss) loss_mean from want join lost using (a, b, c) group by all)"
_PRED = f"{_LOSS}, p as (select item, label, (list(choice order by loss_sum, choice))[1] pred, (list(choice order by loss_mean, choice))[1] pred_norm from s group by all)"
_REPORT = "select (select count(*) from p) num_total, (select count(*) from p where pred = label) num_correct, (select count(*) from p where pred_norm = label) num_correct_norm"
_SHARE = "(select avg((pred = label)::int) from p)", "(select avg((pred_norm = label)::int) from p)", "(select avg(f1) from h)"
_RUNNING = f"{_PRED}, r as (select item, row_number() over (order by item) n, avg((pred = label)::int) over (order by item rows unbounded preceding) acc, avg((pred_norm = label)::int) over (order by item rows unbounded preceding) acc_norm from p) select item, n, acc, acc_norm from r"

SQL = {
    "bits_per_byte": f"with {_HELD}, {_MODEL}, v as (select loss, case when c < 128 then 1 else 3 end n from want join lost using (a, b, c)) select sum(loss) nats, sum(n)::bigint as bytes, sum(loss) / (ln(2) * sum(n)) bpb from v",
    "loss_by_document": f"with {_HELD}, {_MODEL}, s as (select doc_id, count(*) n, sum(loss) l from want join lost using (a, b, c) group by doc_id) select doc_id, n, {micro_sql('l', 'loss_sum')}, {micro_sql('l / n', 'loss_mean')} from s",
    "mc_completion_tokens": f"""with {_ITEMS} select item::int item, choice, label, strlen(t)::bigint n, md5(array_to_string({_BYTES.format(t="t")}, ',')) ids_md5,
      md5(array_to_string(list_transform(range(0, strlen(t)), lambda i: case when i < h then 0 else 1 end), ',')) mask_md5 from x""",
    "mc_losses": f"{_LOSS} select item::int item, choice, label, {micro_sql('loss_sum', 'loss_sum')}, {micro_sql('loss_mean', 'loss_mean')} from s",
    "mc_predict": f"{_PRED} select item::int item, label, pred, pred_norm from p",
    "mc_running": _RUNNING,
    "mc_first": f"{_RUNNING} where n <= 20",
    "mc_classes": f"{_PRED}, {CLASS.replace('{n}', '4')} select class, tp, fp, fn, precision, recall, f1 from h",
    "mc_report": f"{_PRED}, {CLASS.replace('{n}', '4')} {_REPORT}, {_SHARE[0]} acc, {_SHARE[1]} acc_norm, {_SHARE[2]} macro_f1",
    "eval_result": f"{_PRED}, {CLASS.replace('{n}', '4')} {_REPORT}, round({_SHARE[0]}, 4) acc, round({_SHARE[1]}, 4) acc_norm, round({_SHARE[2]}, 4) macro_f1",
}

QUERIES = {f.__name__: f for f in (bits_per_byte, loss_by_document, mc_completion_tokens, mc_losses, mc_predict, mc_running, mc_first, mc_classes, mc_report, eval_result)}
