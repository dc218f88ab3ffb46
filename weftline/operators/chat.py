"""Conversations: assembly, validation, rendering with loss masks, completion prompts, lengths and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.byte_vocab import ASSISTANT_END, ASSISTANT_START, BOS, OUTPUT_END, OUTPUT_START, PYTHON_END, PYTHON_START, USER_END, USER_START, byte_ids
from weftline.operators.prefix import prefix_sum, whole_div

#: A message has content or parts, not both.
MESSAGES = "array<struct<role: string, content: string, parts: array<struct<type: string, text: string>>>>"
MAX_TOKENS = 2048


def assemble(turns: DataFrame) -> DataFrame:
    """conv_id, messages from rows of conv_id, turn, role, text."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    none = F.lit(None).cast("array<struct<type: string, text: string>>")
    ordered = F.transform(F.array_sort(F.collect_list(message)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), none.alias("parts")))
    return turns.groupBy("conv_id").agg(ordered.alias("messages"))


def _alternates(messages: Column) -> Column:
    return F.forall(F.transform(messages, lambda m, i: m["role"] == F.when(i % 2 == 0, "user").otherwise("assistant")), lambda x: F.coalesce(x, F.lit(False)))


def merged_system(messages: Column) -> Column:
    """A leading system message goes, with a blank line, before the next message's content."""
    first, second = F.get(messages, 0), F.get(messages, 1)
    joined = F.struct(second["role"].alias("role"), F.concat(first["content"], F.lit("\n\n"), second["content"]).alias("content"), second["parts"].alias("parts"))
    rest = F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0)))
    return F.when(first["role"] == "system", F.concat(F.array(joined), rest)).otherwise(messages)


def chat_problem(messages: Column) -> Column:
    """Null for a conversation fit as chat data, else what is wrong with it."""
    rest = F.when(F.get(messages, 0)["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return (
        F.when(F.size(messages) < 1, "empty")
        .when(F.size(rest) < 2, "fewer than two messages")
        .when(~_alternates(rest), "roles do not alternate")
        .when(F.exists(rest, lambda m: m["content"].isNull()), "content is no string")
    )


def render_problem(messages: Column) -> Column:
    """Null for a conversation that can be rendered, else what is wrong with it."""
    rest = merged_system(messages)
    wrong_part = lambda p: ~F.coalesce(p["type"].isin("text", "python", "python_output"), F.lit(False))
    return (
        F.when(F.size(messages) < 1, "empty")
        .when((F.get(messages, 0)["role"] == "system") & ~F.coalesce(F.get(messages, 1)["role"] == "user", F.lit(False)), "no user message after system")
        .when(F.size(rest) < 1, "empty")
        .when(~_alternates(rest), "roles do not alternate")
        .when(F.exists(rest, lambda m: (m["role"] == "user") & m["content"].isNull()), "user content is no string")
        .when(F.exists(rest, lambda m: m["content"].isNull() & m["parts"].isNull()), "no content")
        .when(F.exists(rest, lambda m: F.coalesce(F.exists(m["parts"], wrong_part), F.lit(False))), "unknown part")
    )


def _tokens(ids: Column, mask: int) -> Column:
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit(mask).alias("mask")))


def _one(token: int, mask: int) -> Column:
    return F.array(F.struct(F.lit(token).alias("id"), F.lit(mask).alias("mask")))


def _part(p: Column) -> Column:
    ids = byte_ids(p["text"])
    return (
        F.when(p["type"] == "python", F.concat(_one(PYTHON_START, 1), _tokens(ids, 1), _one(PYTHON_END, 1)))
        .when(p["type"] == "python_output", F.concat(_one(OUTPUT_START, 0), _tokens(ids, 0), _one(OUTPUT_END, 0)))
        .otherwise(_tokens(ids, 1))
    )


def _message(m: Column) -> Column:
    body = F.when(m["parts"].isNotNull(), F.flatten(F.transform(m["parts"], _part))).otherwise(_tokens(byte_ids(m["content"]), 1))
    return F.when(m["role"] == "user", F.concat(_one(USER_START, 0), _tokens(byte_ids(m["content"]), 0), _one(USER_END, 0))).otherwise(F.concat(_one(ASSISTANT_START, 0), body, _one(ASSISTANT_END, 1)))


def rendered(messages: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """array<struct<id, mask>> of a conversation, the first max_tokens; mask 1 where the model is to learn."""
    return F.slice(F.concat(_one(BOS, 0), F.flatten(F.transform(merged_system(messages), _message))), 1, max_tokens)


def render(convs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """conv_id, ids, mask of the conversations that can be rendered."""
    out = convs.filter(render_problem(F.col("messages")).isNull()).withColumn("tokens", rendered(F.col("messages"), max_tokens))
    return out.select("conv_id", F.col("tokens.id").alias("ids"), F.col("tokens.mask").alias("mask"))


def render_for_completion(convs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """conv_id, ids of conversations that end with the assistant: rendered without that turn, then assistant_start."""
    m = F.col("messages")
    ours = convs.filter(F.element_at(m, -1)["role"] == "assistant").withColumn("messages", F.slice(m, F.lit(1), F.size(m) - 1))
    return render(ours, max_tokens).select("conv_id", F.concat("ids", F.array(F.lit(ASSISTANT_START))).alias("ids"))


def prompt_ids(question: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """ids of a prompt that asks a model one question: the question as a user's turn, rendered as if a reply followed, then assistant_start."""
    none = F.lit(None).cast("array<struct<type: string, text: string>>")
    asked = F.array(F.struct(F.lit("user").alias("role"), question.alias("content"), none.alias("parts"))).cast(MESSAGES)
    return F.concat(F.transform(rendered(asked, max_tokens), lambda t: t["id"]), F.array(F.lit(ASSISTANT_START)))


def asked(so_far: Column, question: Column) -> Column:
    """A chat's ids after a user's turn, ready for a reply; so_far: its ids before, empty at first."""
    begun = F.when(F.size(so_far) == 0, F.array(F.lit(BOS))).otherwise(so_far)
    return F.concat(begun, F.array(F.lit(USER_START)), byte_ids(question), F.array(F.lit(USER_END), F.lit(ASSISTANT_START)))


def answered(so_far: Column, reply: Column) -> Column:
    """A chat's ids after a reply's ids, which end with assistant_end whether or not the reply did."""
    return F.concat(so_far, reply, F.when(F.element_at(reply, -1) == ASSISTANT_END, F.array().cast("array<int>")).otherwise(F.array(F.lit(ASSISTANT_END))))


def accumulated(messages: Column) -> Column:
    """A chat's ids after its turns one by one, a user's by `asked` and the others by `answered`."""
    turn = lambda ids, m: F.when(m["role"] == "user", asked(ids, m["content"])).otherwise(answered(ids, byte_ids(m["content"])))
    return F.aggregate(messages, F.array().cast("array<int>"), turn)


def visible(ids: Column, mask: Column) -> Column:
    """Tokens joined by bars, green where learnt and red elsewhere."""
    return F.array_join(F.zip_with(ids, mask, lambda i, k: F.concat(F.when(k == 1, "\x1b[92m").otherwise("\x1b[91m"), i.cast("string"), F.lit("\x1b[0m"))), "|")


def index_percentiles(values: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """quantile, value: of the sorted values, the one at zero-based rank floor(n q), without interpolation.

    Whole values are counted first; a rank lies in the run of its value, which prefix sums over the distinct values give.
    """
    counts = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    runs = prefix_sum(counts.withColumn("bucket_", whole_div(F.col("value"), 1024)), "c", ["value"], "bucket_", "lo", fan=1 << 16)
    total = values.agg(F.count("*").alias("n"))
    asked = runs.join(F.broadcast(total)).withColumn("quantile", F.explode(F.array(*map(F.lit, quantiles))))  # total is one row
    rank = F.floor(F.col("n") * F.col("quantile"))
    return asked.filter((F.col("lo") <= rank) & (rank < F.col("lo") + F.col("c"))).select("quantile", "value")


def length_report(convs: DataFrame, fits: int = 1025) -> DataFrame:
    """One row: n, fits, fits_assistant, avg, max, p50, p90, p99 of rendered lengths."""
    r = render(convs).select(F.size("ids").cast("long").alias("n"), F.exists("mask", lambda k: k == 1).alias("learns"))
    total = r.agg(F.count("*").alias("n_convs"), F.count_if(F.col("n") <= fits).alias("fits"), F.count_if((F.col("n") <= fits) & F.col("learns")).alias("fits_assistant"), F.floor(F.avg("n")).alias("avg_len"), F.max("n").alias("max_len"))
    p = index_percentiles(r, "n", [0.5, 0.9, 0.99]).groupBy().pivot("quantile", [0.5, 0.9, 0.99]).agg(F.first("value"))
    p = p.toDF("p50", "p90", "p99")
    return total.join(F.broadcast(p))


def context_window(ids: Column, block: int, max_new: int) -> Column:
    """The first token and the last block - max_new - 5 others, where there are more than block - max_new - 4."""
    most = block - max_new - 4
    return F.when(F.size(ids) > most, F.concat(F.slice(ids, 1, 1), F.slice(ids, -(most - 1), most - 1))).otherwise(ids)


def steps_for(n_convs: Column, mean_length: Column, tokens_per_step: int) -> Column:
    """Steps of about one epoch, one at least."""
    return F.greatest(F.lit(1), F.floor(mean_length * n_convs / tokens_per_step))
