"""Queries on conversations: validation, rendering, packing, views, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import byte_vocab as bv
from weftline.functions.permute import once_sql
from weftline.operators import bestfit, chat, views
from weftline.operators.prefix import numbered
from weftline.session import new_path, table
from weftline.sources import chat_lines

LENGTH, RANKS, MAX = 4096, 2, 4096


def convs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.assemble(table(spark, sf, "conversations"))


def _joined(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def conv_validate(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return convs(spark, sf).select("conv_id", chat.chat_problem(m).isNull().alias("is_chat"), chat.render_problem(m).isNull().alias("is_renderable"))


def broken_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of all conversations, most of them spoilt in a way that their id says: without a beginning, one role only, no text, one turn only,
    a system message in place of the first."""
    way = F.col("conv_id") % 7
    t = table(spark, sf, "conversations").filter(~((way.isin(1, 5) & (F.col("turn") == 0)) | ((way == 4) & (F.col("turn") > 0))))
    role = F.when(way == 2, "user").otherwise(F.col("role"))
    text = F.when(~((way == 3) & (F.col("role") == "user")), F.col("text"))
    system = table(spark, sf, "conversations").filter(way == 5).select("conv_id", F.lit(-1).cast("long"), F.lit("system"), F.lit("s")).distinct()
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text")).union(system)


def conv_problems(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    return chat.assemble(broken_turns(spark, sf)).select("conv_id", chat.chat_problem(m).alias("chat_problem"), chat.render_problem(m).alias("render_problem"))


def conv_render(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render(convs(spark, sf)).select("conv_id", _joined(F.col("ids")).alias("ids"), _joined(F.col("mask")).alias("mask"))


def conv_render_tools(spark: SparkSession, sf: str) -> DataFrame:
    """Every reply followed by a tool call and its output; tokens, masks and their view."""
    parts = lambda m: F.array(*(F.struct(F.lit(kind).alias("type"), text.alias("text")) for kind, text in (("text", m["content"]), ("python", F.col("conv_id").cast("string")), ("python_output", F.lit("ok")))))
    none = F.lit(None).cast("array<struct<type: string, text: string>>")
    with_tools = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] != "assistant", m["content"]).alias("content"), F.when(m["role"] == "assistant", parts(m)).otherwise(none).alias("parts")))
    out = chat.render(convs(spark, sf).withColumn("messages", with_tools))
    return out.select("conv_id", F.md5(_joined(F.col("ids"))).alias("ids_md5"), F.md5(_joined(F.col("mask"))).alias("mask_md5"), F.md5(chat.visible(F.col("ids"), F.col("mask"))).alias("view_md5"))


def conv_completion(spark: SparkSession, sf: str) -> DataFrame:
    return chat.render_for_completion(convs(spark, sf)).select("conv_id", F.size("ids").cast("long").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


def question_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's turn as a question by itself."""
    t = table(spark, sf, "conversations").filter("role = 'user'").withColumn("ids", chat.prompt_ids(F.col("text")))
    return t.select("conv_id", "turn", F.size("ids").cast("long").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


def chat_accumulated(spark: SparkSession, sf: str) -> DataFrame:
    """Chats that can be rendered and have no system message, turn by turn."""
    m = F.col("messages")
    c = convs(spark, sf).filter(chat.render_problem(m).isNull() & (F.get(m, 0)["role"] == "user")).withColumn("ids", chat.accumulated(m))
    return c.select("conv_id", F.size("ids").cast("long").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


def first_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of all conversations, from a file of JSON lines in their order."""
    path = new_path(spark, "chat")
    c = convs(spark, sf)
    n = c.count()
    chat_lines.write_chat_lines(c, path, n)
    back = chat_lines.read_first_lines(spark, path, n // 2)
    return back.select(F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("text_md5"))


def conv_length_report(spark: SparkSession, sf: str) -> DataFrame:
    return chat.length_report(convs(spark, sf))


def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    r = chat.render(convs(spark, sf), 1 << 30).select("conv_id", chat.context_window(F.col("ids"), 1024, 256).alias("ids"))
    return r.select("conv_id", F.size("ids").cast("long").alias("n"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


def auto_steps(spark: SparkSession, sf: str) -> DataFrame:
    r = chat.render(convs(spark, sf)).select("conv_id", F.size("ids").alias("n"))
    head = r.orderBy("conv_id").limit(200).agg(F.avg("n").alias("mean_len"))
    total = r.agg(F.count("*").alias("n_convs"))
    return total.join(F.broadcast(head)).select("n_convs", "mean_len", chat.steps_for(F.col("n_convs"), F.col("mean_len"), 16384).alias("steps"))


def pack_bestfit(spark: SparkSession, sf: str) -> DataFrame:
    rows = bestfit.pack_bestfit(chat.render(convs(spark, sf), MAX), ranks=RANKS, length=LENGTH)
    return rows.select("rank", "row_no", F.size("ids").alias("n"), _joined(F.col("convs")).alias("convs"), F.md5(_joined(F.col("ids"))).alias("ids_md5"))


def pack_sources(spark: SparkSession, sf: str) -> DataFrame:
    return bestfit.ranked(chat.render(convs(spark, sf), 1 << 30), "conv_id", RANKS, LENGTH + 1).select("conv_id", F.col("idx").cast("long").alias("idx"), "rank", F.size("ids").cast("long").alias("n"))


def pack_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Each rendered conversation as a row."""
    rows = bestfit.with_targets(chat.render(convs(spark, sf)))
    return rows.select("conv_id", F.md5(_joined(F.col("x"))).alias("x_md5"), F.md5(_joined(F.col("y"))).alias("y_md5"), F.exists("y", lambda v: v != bestfit.IGNORE).alias("learns"))


def pack_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return bestfit.packing_stats(bestfit.pack_bestfit(chat.render(convs(spark, sf), MAX), ranks=RANKS, length=LENGTH))


def _task(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), "source")


def task_slice(spark: SparkSession, sf: str) -> DataFrame:
    return views.slice_view(_task(spark, sf), 10, 5000, 7).select("idx", "physical", "source")


def _tasks(spark: SparkSession, sf: str) -> list:
    a = views.slice_view(_task(spark, sf), 0, 60, 2).select("idx", "source")
    b = views.slice_view(_task(spark, sf), 100, 140, 1).select("idx", "source")
    return [(a, 30), (b, 40), (a, 30)]


def task_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return views.sequence_view(_tasks(spark, sf)).select("idx", "task", "local", "source")


SEED = 42


def task_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """All documents, a task for each source, in one shuffled order; the first task is listed twice."""
    rows, tasks = views.grouped_tasks(_task(spark, sf).withColumnRenamed("idx", "doc_id"), "source", "doc_id")
    n_tasks, n, again = tasks.agg(F.count("*"), F.sum("n_rows"), F.min(F.when(F.col("task") == 0, F.col("n_rows")))).first()
    second = rows.filter("task = 0").withColumn("task", F.lit(n_tasks).cast("int")).withColumn("idx", F.col("local") + F.lit(n))
    return views.shuffled(rows.unionByName(second), (n or 0) + (again or 0), SEED).select("idx", "task", "local", "source")


def _numbered_documents(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(table(spark, sf, "documents").select("doc_id", "source"), ["doc_id"], "idx")


def task_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    rows = _numbered_documents(spark, sf)
    return views.shuffled(rows, rows.count(), SEED).select("idx", "in_order", "doc_id", "source")


def task_shuffle_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of the shuffle, found from its places."""
    rows = _numbered_documents(spark, sf)
    n = rows.count()
    return views.shuffled_page(rows, n, n // 2, n, SEED).select("idx", "in_order", "doc_id", "source")


def task_hash_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return views.hash_shuffled(_task(spark, sf), 42).select("idx", "shuffle_key")


def export_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first 50 conversations as JSON lines, read back."""
    path = new_path(spark, "chat")
    chat_lines.write_chat_lines(convs(spark, sf), path, 50)
    back = chat_lines.read_chat_lines(spark, path)
    return back.select(F.size("messages").cast("long").alias("n"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("text_md5"))


_C = """c as (select conv_id, list(role order by turn) roles, list(text order by turn) texts from conversations group by conv_id),
q as (select conv_id, case when roles[1] = 'system' then roles[2:] else roles end roles, case when roles[1] = 'system' then texts[2:] else texts end texts,
  case when roles[1] = 'system' then texts[1] end sys, roles[1] = 'system' has_sys from c),
k as (select *, len(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> case when i % 2 = 1 then 'user' else 'assistant' end)) = 0 alternates from q)"""
_BYTES = "list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda j: ('0x' || j)::int)"
#: A row a message, with the system text merged; ids and masks with their wrappers.
_R = f"""{_C}, m as (select conv_id, unnest(range(1, len(roles) + 1)) i, roles, texts, sys from k where alternates and len(roles) >= 1),
t as (select conv_id, i, roles[i] as role, case when i = 1 and sys is not null then sys || chr(10) || chr(10) || texts[i] else texts[i] end x from m),
w as (select conv_id, i, case when role = 'user' then list_append(list_prepend(257, {_BYTES.format(t="x")}), 258) else list_append(list_prepend(259, {_BYTES.format(t="x")}), 260) end ids,
  case when role = 'user' then list_transform(range(0, strlen(x) + 2), lambda j: 0) else list_prepend(0, list_transform(range(0, strlen(x) + 1), lambda j: 1)) end mask from t)"""
_ALL = f"{_R}, r as (select conv_id, list_prepend(256, flatten(list(ids order by i))) ids, list_prepend(0, flatten(list(mask order by i))) mask from w group by conv_id)"
_LEN = f"""{_C}, n as (select conv_id, least(2048, 1 + list_sum(list_transform(texts, lambda x: strlen(x) + 2)) + case when has_sys then strlen(sys) + 2 else 0 end)::bigint n,
  1 + case when has_sys then strlen(sys) + 2 else 0 end + strlen(texts[1]) + 2 < 2047 and len(roles) > 1 learns from k where alternates and len(roles) >= 1)"""

#: The places of rows (in_order below n) in a shuffled order, by the same rounds; `walked` has each row's place as v.
_SHUFFLE = f"""sized as (select *, floor(sqrt(n - 1))::bigint + 1 a from (select *, count(*) over () n from rows)),
walk as (select *, {once_sql("in_order", "a", "((n + a - 1) // a)", SEED)} v from sized
  union all select * exclude (v), {once_sql("v", "a", "((n + a - 1) // a)", SEED)} v from walk where v >= n),
walked as (select * from walk where v < n)"""
_NUMBERED = "rows as (select doc_id, source, row_number() over (order by doc_id nulls first) - 1 in_order from documents)"

SQL = {
    "task_mixture": f"""with recursive g as (select source, row_number() over (order by source nulls first) - 1 task, count(*) c from documents group by source),
      d as (select task, source, row_number() over (partition by task order by doc_id nulls first) - 1 as local, row_number() over (order by task, doc_id nulls first) - 1 in_order from documents join g using (source)),
      rows as (select * from d union all select (select count(*) from g), source, local, (select count(*) from d) + local from d where task = 0), {_SHUFFLE}
      select v::bigint idx, task::int task, local, source from walked""",
    "task_shuffle": f"with recursive {_NUMBERED}, {_SHUFFLE} select v::bigint idx, in_order, doc_id, source from walked",
    "task_shuffle_page": f"with recursive {_NUMBERED}, {_SHUFFLE} select v::bigint idx, in_order, doc_id, source from walked where v >= n // 2",
    "conv_validate": f"with {_C} select conv_id, alternates and len(roles) >= 2 is_chat, alternates and len(roles) >= 1 is_renderable from k",
    "conv_problems": """with chats as (select conv_id, turn, case when conv_id % 7 = 2 then 'user' else role end as role, case when not (conv_id % 7 = 3 and role = 'user') then text end as text
        from conversations where not ((conv_id % 7 in (1, 5) and turn = 0) or (conv_id % 7 = 4 and turn > 0)) union all select distinct conv_id, -1, 'system', 's' from conversations where conv_id % 7 = 5), c as (select conv_id, list(role order by turn) roles, list(coalesce(text, chr(1)) order by turn) texts from chats group by conv_id),
      q as (select conv_id, roles whole, case when roles[1] = 'system' then roles[2:] else roles end roles, case when roles[1] = 'system' then texts[2:] else texts end texts from c),
      k as (select *, len(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> case when i % 2 = 1 then 'user' else 'assistant' end)) = 0 alternates from q)
      select conv_id, case when len(roles) < 2 then 'fewer than two messages' when not alternates then 'roles do not alternate' when list_contains(texts, chr(1)) then 'content is no string' end chat_problem,
        case when whole[1] = 'system' and coalesce(whole[2], '') <> 'user' then 'no user message after system' when not alternates then 'roles do not alternate'
          when list_contains(texts, chr(1)) then 'user content is no string' end render_problem from k""",
    "conv_render": f"with {_ALL} select conv_id, array_to_string(ids[1:2048], ',') ids, array_to_string(mask[1:2048], ',') mask from r",
    "conv_completion": f"""with {_R}, e as (select conv_id from k where roles[-1] = 'assistant'), z as (select w.*, max(i) over (partition by conv_id) last from w where conv_id in (select conv_id from e)),
      p as (select conv_id, list_append(list_prepend(256, flatten(list(ids order by i)))[1:2048], 259) ids from z where i < last group by conv_id)
      select conv_id, len(ids)::bigint n, md5(array_to_string(ids, ',')) ids_md5 from p""",
    "question_prompts": f"""with p as (select conv_id, turn, ([256, 257] || {_BYTES.format(t="text")} || [258])[1:2048] || [259] ids from conversations where role = 'user') select conv_id, turn, len(ids)::bigint n, md5(array_to_string(ids, ',')) ids_md5 from p""",
    "chat_accumulated": f"""with {_C}, m as (select conv_id, unnest(range(1, len(roles) + 1)) i, roles, texts from k where alternates and len(roles) >= 1 and not coalesce(has_sys, false)),
      p as (select conv_id, i, case when roles[i] = 'user' then [257] || {_BYTES.format(t="texts[i]")} || [258, 259] else {_BYTES.format(t="texts[i]")} || [260] end ids from m),
      a as (select conv_id, [256] || flatten(list(ids order by i)) ids from p group by conv_id) select conv_id, len(ids)::bigint n, md5(array_to_string(ids, ',')) ids_md5 from a""",
    "first_lines": f"""with {_C}, o as (select *, row_number() over (order by conv_id) r, count(*) over () n from c)
      select len(roles)::bigint n, md5(array_to_string(list_transform(range(1, len(roles) + 1), lambda i: roles[i] || ':' || texts[i]), '|')) text_md5 from o where r <= o.n // 2""",
    "conv_length_report": f"""with {_LEN}, s as (select n, row_number() over (order by n) - 1 rk, count(*) over () c from n)
      select (select count(*) from n) n_convs, (select count(*) from n where n <= 1025) fits, (select count(*) from n where n <= 1025 and learns) fits_assistant,
        (select floor(avg(n))::bigint from n) avg_len, (select max(n) from n) max_len, (select n from s where rk = floor(c * 0.5::double)) p50, (select n from s where rk = floor(c * 0.9::double)) p90, (select n from s where rk = floor(c * 0.99::double)) p99""",
    "chat_context": f"with {_ALL}, x as (select conv_id, case when len(ids) > 764 then list_prepend(ids[1], ids[-763:]) else ids end ids from r) select conv_id, len(ids)::bigint n, md5(array_to_string(ids, ',')) ids_md5 from x",
    "auto_steps": f"with {_LEN}, h as (select n from n order by conv_id limit 200) select (select count(*) from n) n_convs, (select avg(n) from h) mean_len, greatest(1, floor((select avg(n) from h) * (select count(*) from n) / 16384))::bigint steps",
    "pack_sources": f"""with {_ALL}, x as (select conv_id, len(ids)::bigint n, row_number() over (order by conv_id) - 1 idx from r) select conv_id, idx, (idx % {RANKS})::int as rank, n from x where n <= {LENGTH + 1}""",
    "pack_targets": f"""with {_ALL}, cut as (select conv_id, ids[1:2048] ids, mask[1:2048] mask from r), shifted as (select conv_id, ids[1:len(ids) - 1] x, list_transform(range(2, len(ids) + 1), lambda i: case when mask[i] = 0 then -100 else ids[i] end) y from cut)
      select conv_id, md5(array_to_string(x, ',')) x_md5, md5(array_to_string(y, ',')) y_md5, len(list_filter(y, lambda v: v <> -100)) > 0 learns from shifted""",
    "conv_render_tools": f"""with {_R.split("w as (select")[0].rstrip().rstrip(",")}, p as (select *, list_transform({_BYTES.format(t="x")}, lambda b: [b, 1]) said, list_transform({_BYTES.format(t="conv_id::varchar")}, lambda b: [b, 1]) code from t),
      w as (select conv_id, i, case when role = 'user' then [[257, 0]] || list_transform({_BYTES.format(t="x")}, lambda b: [b, 0]) || [[258, 0]] else [[259, 0]] || said || [[261, 1]] || code || [[262, 1], [263, 0], [111, 0], [107, 0], [264, 0], [260, 1]] end k from p),
      r as (select conv_id, ([[256, 0]] || flatten(list(k order by i)))[1:2048] k from w group by conv_id)
      select conv_id, md5(array_to_string(list_transform(k, lambda v: v[1]), ',')) ids_md5, md5(array_to_string(list_transform(k, lambda v: v[2]), ',')) mask_md5,
        md5(array_to_string(list_transform(k, lambda v: chr(27) || case when v[2] = 1 then '[92m' else '[91m' end || v[1] || chr(27) || '[0m'), '|')) view_md5 from r""",
    "task_slice": "select (doc_id - 10) // 7 idx, doc_id physical, source from documents where doc_id >= 10 and doc_id < 5000 and (doc_id - 10) % 7 = 0",
    "task_sequence": """with a as (select doc_id // 2 l, source from documents where doc_id < 60 and doc_id % 2 = 0), b as (select doc_id - 100 l, source from documents where doc_id >= 100 and doc_id < 140)
      select l idx, 0 task, l as local, source from a union all select l + 30, 1, l, source from b union all select l + 70, 2, l, source from a""",
    "export_first": f"with {_C}, f as (select * from c order by conv_id limit 50) select len(roles)::bigint n, md5(array_to_string(list_transform(range(1, len(roles) + 1), lambda i: roles[i] || ':' || texts[i]), '|')) text_md5 from f",
}

QUERIES = {
    f.__name__: f
    for f in (
        conv_validate, conv_problems, conv_render, conv_render_tools, conv_completion, question_prompts, chat_accumulated, first_lines, conv_length_report, chat_context, auto_steps, pack_bestfit, pack_sources, pack_targets, pack_statistics,
        task_slice, task_sequence, task_mixture, task_shuffle, task_shuffle_page, task_hash_shuffle, export_first,
    )
}
