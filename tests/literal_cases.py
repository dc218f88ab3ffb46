"""Cases of evaluations, rewards, sampling, schedules and run files over small literal tables, with their SQL: ties, nulls and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import schedules as sch
from weftline.operators import bestfit, chat, choices, metrics, rollouts, sampling
from literals import cte, literal
from weftline.session import new_path, ship
from weftline.sources import chat_lines, runs


def _joined(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")


def mc_render(spark: SparkSession, sf: str) -> DataFrame:
    a = choices.four_choice(literal(spark, "four_choice")).select("item", "prompt", "reply", "is_valid", F.lit("four").alias("kind"))
    b = choices.lettered(literal(spark, "lettered")).select("item", "prompt", "reply", "is_valid", F.lit("lettered").alias("kind"))
    return a.unionByName(b)


def mc_categorical(spark: SparkSession, sf: str) -> DataFrame:
    j = literal(spark, "lettered").join(literal(spark, "responses"), "item")
    return j.select("item", choices.categorical(F.col("response"), F.col("answer"), F.col("letters")).alias("correct"))


def mc_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(choices.SUBJECTS)), "no int, subject string")


def mc_completion_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Completion items written as JSON lines, read back and laid out as tokens."""
    path = new_path(spark, "items")
    items = literal(spark, "completion_items")
    items.select(F.to_json(F.struct(F.col("item").alias("ind"), "ctx", "endings", "label")).alias("value")).write.text(path)
    back = chat_lines.read_completion_lines(spark, path).select(F.col("ind").cast("int").alias("item"), "ctx", "endings", "label")
    return choices.completion_tokens(back).select("item", "choice", "label", _joined(F.col("ids")).alias("ids"), _joined(F.col("mask")).alias("mask"))


def _preds(spark: SparkSession) -> DataFrame:
    return choices.predictions(choices.masked_losses(literal(spark, "tie_losses")))


def mc_losses(spark: SparkSession, sf: str) -> DataFrame:
    return choices.masked_losses(literal(spark, "tie_losses"))


def mc_predict(spark: SparkSession, sf: str) -> DataFrame:
    return _preds(spark)


def mc_running(spark: SparkSession, sf: str) -> DataFrame:
    return choices.running_accuracy(_preds(spark))


def mc_classes(spark: SparkSession, sf: str) -> DataFrame:
    return choices.class_report(_preds(spark))


def mc_report(spark: SparkSession, sf: str) -> DataFrame:
    return choices.accuracy_report(_preds(spark))


def validation_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.validation_loss(literal(spark, "rank_batches"), 20)


def ema_debiased(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.debiased_ema(literal(spark, "series"))


def running_best(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.running_best(literal(spark, "series").filter("series = 'a'"), "value")


def reward_extract(spark: SparkSession, sf: str) -> DataFrame:
    a = literal(spark, "answers")
    return a.select("item", rollouts.extracted_answer(F.col("answer")).alias("extracted"), rollouts.reward(F.col("gold"), F.col("answer")).alias("reward"))


def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.advantages(literal(spark, "rollouts"), ["step", "example"]).select("step", "example", "sample", "reward", "advantage")


def reward_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.step_statistics(literal(spark, "rollouts"))


def pass_at_1(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.pass_at_1(literal(spark, "rollouts").filter("sample = 0").select("step", (F.col("reward") > 0).cast("int").alias("correct")))


def zero_streak(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.zero_streaks(rollouts.step_statistics(literal(spark, "rollouts")))


def rollout_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = rollouts.padded_targets(literal(spark, "rollout_tokens"), ["example"])
    return p.select("example", "sample", _joined(F.col("x")).alias("x"), _joined(F.col("y")).alias("y"))


def policy_objective(spark: SparkSession, sf: str) -> DataFrame:
    return rollouts.policy_objective(literal(spark, "objective_tokens"), 2, 4)


def rollout_seeds(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.range(0, 300000, 1001).select(F.col("id").alias("step"))
    return r.select("step", rollouts.rollout_seed(F.col("step"), F.pmod("step", F.lit(97)), F.pmod("step", F.lit(3))).alias("seed"), (F.col("step") % 4).cast("int").alias("rank"))


def sample_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.greedy(literal(spark, "logits"))


def topk_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_k_exact(literal(spark, "logits"), 3, 0.8)


def topk_ties(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.top_k_ties(literal(spark, "logits"), 3, 0.8)


def sample_draw(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.draw(sampling.top_k_exact(literal(spark, "logits"), 3), 7)


def sample_stops(spark: SparkSession, sf: str) -> DataFrame:
    s = literal(spark, "sampled")
    return s.select("row", _joined(sampling.until_stop(F.col("ids"), 260)).alias("batch"), _joined(sampling.through_stop(F.col("ids"), 260)).alias("stream"))


def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    it = F.col("it")
    return spark.range(0, sch.MAX_STEPS, 37).select(F.col("id").alias("it")).select("it", sch.pretrain_lr(it).alias("lr"), sch.pretrain_momentum(it).alias("momentum"), sch.weight_decay(it, 0.2).alias("decay"))


def tuning_schedule(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.range(0, 500).select(F.col("id").alias("it"))
    p = F.col("it") / 499
    return r.select("it", sch.tuning_lr(p, 0.05, 0.5).alias("lr"), sch.tuning_momentum(F.col("it")).alias("momentum"), sch.rollout_lr(F.col("it"), 400).alias("rollout_lr"))


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    per_token = sch.flops_per_token(768, 12, 6, 1024, 32768)
    r = spark.range(1, 20).select((F.col("id") / 10.0).alias("dt"))
    r = r.withColumn("accum", F.lit(sch.accumulation_steps(524288, 64, 1024, 4))).withColumn("flops_token", F.lit(per_token).cast("long")).withColumn("rl_steps", F.lit(sch.rollout_steps(7473, 16, 2)))
    return r.select("dt", "accum", "flops_token", "rl_steps", (F.lit(524288) / F.col("dt")).alias("tok_s"), sch.utilisation(F.lit(524288), F.col("dt"), per_token, F.lit(989e12), 4).alias("mfu"))


def peak_flops(spark: SparkSession, sf: str) -> DataFrame:
    return sch.peak_flops(spark, literal(spark, "devices")).select("device", F.when(F.col("flops") == float("inf"), -1.0).otherwise(F.col("flops")).alias("flops"))


def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    """A log written in two runs, the second resuming, read and parsed."""
    ship(spark)
    path = new_path(spark, "log")
    lines = literal(spark, "log_lines")
    runs.append_log(lines.filter("value like 'broken%'"), path, False)
    runs.append_log(lines.filter("value not like 'broken%'"), path, True)
    p = sch.parsed_log(spark.read.text(path))
    bad = F.isnan("metric_value") | (F.abs("metric_value") == float("inf"))
    return p.select("step", "metric", F.when(~bad, F.col("metric_value")).alias("metric_value"), (~bad).alias("is_finite"))


def run_files(spark: SparkSession, sf: str) -> DataFrame:
    """Latest step, largest tag, tag by time."""
    a = runs.latest_step(literal(spark, "checkpoint_files"))
    b = runs.largest_tag(literal(spark, "model_tags")).withColumnRenamed("tag", "largest")
    c = runs.largest_tag(literal(spark, "untagged")).withColumnRenamed("tag", "newest")
    return a.join(F.broadcast(b)).join(F.broadcast(c))


def run_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata written by rank 0, read back, and patched."""
    path = new_path(spark, "meta")
    runs.write_metadata(literal(spark, "configs"), path)
    runs.write_metadata(literal(spark, "configs").limit(0), path, rank=1)
    p = runs.patched_config(spark.read.json(path))
    return p.select("run", F.col("n_layer").cast("int").alias("n_layer"), _joined(F.col("resid_lambdas")).alias("resid_lambdas"), _joined(F.col("x0_lambdas")).alias("x0_lambdas"))


def eval_result(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "result")
    runs.write_result(choices.accuracy_report(_preds(spark)), path)
    return spark.read.json(path).select("num_total", "num_correct", "num_correct_norm", "acc", "acc_norm", "macro_f1")


_LOSS = f"""with {cte("tie_losses")}, a as (select item, choice, label, sum(loss) loss_sum, avg(loss) loss_mean from tie_losses where mask = 1 and pos > 0 group by 1, 2, 3)"""
_PRED = f"""{_LOSS}, p as (select item, label, (list(choice order by loss_sum, choice))[1] pred, (list(choice order by loss_mean, choice))[1] pred_norm from a group by 1, 2)"""
_CLASS = """d as (select unnest(range({n}))::int as class),
  k as (select class, count(*) filter (pred = class and label = class) tp, count(*) filter (pred = class and label <> class) fp, count(*) filter (pred <> class and label = class) fn from d cross join p group by class),
  g as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double recall from k),
  h as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::double f1 from g)"""
_REPORT = """select (select count(*) from p) num_total, (select count(*) from p where pred = label) num_correct, (select count(*) from p where pred_norm = label) num_correct_norm"""
_SHARE = "(select avg((pred = label)::int) from p)", "(select avg((pred_norm = label)::int) from p)", "(select avg(f1) from h)"
_ANSWER = r"nullif(replace(regexp_extract({t}, '####\s*([\d,.\-]+)', 1), ',', ''), '')"
_TOPK = """{head}, r as (select "row", token_id, logit, {rank} r from logits), k as (select *, exp((logit - max(logit) over (partition by "row")) / {t}) e from r where r <= 3)
  select "row", token_id, logit, e / sum(e) over (partition by "row") prob from k"""
_STATS = "s as (select step, avg(r) reward_mean, stddev_pop(r) reward_std, sum(l) / sum(n) mean_len from (select step, example, avg(reward) r, sum(length) l, count(*) n from rollouts group by 1, 2) group by step)"
_DOWN = round(sch.DECAY * sch.MAX_STEPS)
_RULES = " ".join("when " + " and ".join(f"contains(lower(device), '{p}')" for p in parts) + f" then {v!r}::double" for parts, v in sch.PEAK_FLOPS)

SQL = {
    "mc_render": f"""with {cte("four_choice")}, {cte("lettered")}, u as (select item, question, choices, ['A','B','C','D'] letters, (['A','B','C','D'])[answer + 1] reply, len(choices) = 4 is_valid, 'four' kind from four_choice
      union all select item, question, choices, letters, answer, list_contains(letters, answer), 'lettered' from lettered)
      select item, '{choices.HEAD}' || question || chr(10) || array_to_string(list_transform(range(1, least(len(letters), len(choices)) + 1), lambda i: '- ' || choices[i] || '=' || letters[i] || chr(10)), '') || chr(10) || '{choices.TAIL.strip()}' prompt, reply, is_valid, kind from u""",
    "mc_categorical": f"with {cte('lettered')}, {cte('responses')} select item, case when list_contains(letters, response) then response = answer end correct from lettered join responses using (item)",
    "mc_completion_tokens": f"""with {cte("completion_items")}, e as (select item, label, ctx, unnest(range(0, 4))::int choice, endings from completion_items), t as (select item, choice, label, ctx || ' ' || endings[choice + 1] x, strlen(ctx) h from e)
      select item, choice, label, array_to_string(list_transform(range(0, strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), (i * 2 + 1)::int, 2))::int), ',') ids, array_to_string(list_transform(range(0, strlen(x)), lambda i: case when i < h then 0 else 1 end), ',') mask from t""",
    "mc_losses": f"{_LOSS} select item, choice, label, loss_sum, loss_mean from a",
    "mc_predict": f"{_PRED} select item, label, pred, pred_norm from p",
    "mc_running": f"{_PRED} select item, row_number() over (order by item) n, avg((pred = label)::int) over (order by item rows unbounded preceding) acc, avg((pred_norm = label)::int) over (order by item rows unbounded preceding) acc_norm from p",
    "mc_classes": f"{_PRED}, {_CLASS.replace('{n}', '4')} select class, tp, fp, fn, precision, recall, f1 from h",
    "mc_report": f"{_PRED}, {_CLASS.replace('{n}', '4')} {_REPORT}, {_SHARE[0]} acc, {_SHARE[1]} acc_norm, {_SHARE[2]} macro_f1",
    "validation_loss": f"with {cte('rank_batches')} select avg(l) val_loss from (select rank, avg(loss) l from rank_batches where batch_no < 20 group by rank)",
    "ema_debiased": f"""with {cte("series")}, n as (select *, row_number() over (partition by series order by step) i from series),
      e as (select a.series, a.step, a.value, a.i, sum(0.1::double * b.value * pow(0.9::double, a.i - b.i)) ema from n a join n b on a.series = b.series and b.i <= a.i group by 1, 2, 3, 4)
      select series, step::bigint step, value, ema, ema / (1 - pow(0.9::double, step + 1)) debiased from e""",
    "running_best": f"with {cte('series')} select step, value, min(value) over (order by step rows unbounded preceding) best from series where series = 'a'",
    "reward_extract": f"""with {cte("answers")}, x as (select item, {_ANSWER.format(t="gold")} g, {_ANSWER.format(t="answer")} a from answers)
      select item, a extracted, case when coalesce(try_cast(g as double) = try_cast(a as double), false) then 1.0::double else 0.0::double end reward from x""",
    "group_advantage": f"with {cte('rollouts')} select step, example, sample, reward, reward - avg(reward) over (partition by step, example) advantage from rollouts",
    "reward_stats": f"with {cte('rollouts')}, {_STATS} select step, reward_mean, reward_std, mean_len from s",
    "pass_at_1": f"with {cte('rollouts')} select step, count(*) filter (reward > 0) correct, count(*) total, count(*) filter (reward > 0) / count(*) pass1 from rollouts where sample = 0 group by step",
    "zero_streak": f"""with {cte("rollouts")}, {_STATS}, i as (select step, reward_mean, count(*) filter (reward_mean <> 0) over (order by step rows unbounded preceding) g from s),
      z as (select step, reward_mean, case when reward_mean = 0 then count(*) filter (reward_mean = 0) over (partition by g order by step rows unbounded preceding) else 0 end streak from i)
      select step, reward_mean, streak, streak >= 5 warn from z""",
    "rollout_targets": f"""with {cte("rollout_tokens")}, m as (select *, max(len(ids)) over (partition by example) most from rollout_tokens),
      p as (select example, sample, list_transform(range(1, most + 1), lambda i: case when i <= len(ids) then ids[i] else 256 end) x, list_transform(range(1, most + 1), lambda i: case when i > prefix and i <= len(ids) then 1 else 0 end) k, most from m)
      select example, sample, array_to_string(x[1:most - 1], ',') x, array_to_string(list_transform(range(2, most + 1), lambda i: case when k[i] = 0 then -100 else x[i] end), ',') y from p""",
    "policy_objective": f"with {cte('objective_tokens')} select step, sum(logp * adv) total, count(*) filter (target <> -100) valid, sum(logp * adv) / (greatest(count(*) filter (target <> -100), 1) * 8) objective from objective_tokens group by step",
    "rollout_seeds": "select s step, (s * 10000 + (s % 97) * 100 + s % 3) & 2147483647 seed, (s % 4)::int as rank from (select unnest(range(0, 300000, 1001)) s)",
    "sample_greedy": f"""with {cte("logits")} select "row", (list(token_id order by logit desc, token_id))[1] token_id from logits group by "row" """,
    "topk_exact": _TOPK.format(head=f"with {cte('logits')}", rank='row_number() over (partition by "row" order by logit desc, token_id)', t="0.8::double"),
    "topk_ties": _TOPK.format(head=f"with {cte('logits')}", rank='rank() over (partition by "row" order by logit desc)', t="0.8::double"),
    "sample_stops": f"""with {cte("sampled")}, p as (select *, coalesce(list_position(ids, 260), 0) a from sampled)
      select "row", array_to_string(case when a > 0 then ids[1:a - 1] else ids end, ',') batch, array_to_string(case when a > 0 then ids[1:a] else ids end, ',') stream from p""",
    "lr_schedule": f"""with t as (select unnest(range(0, {sch.MAX_STEPS}, 37)) i), v as (select i, ({sch.MAX_STEPS} - i) / {_DOWN}::double l, (i - {sch.MAX_STEPS - _DOWN}) / {_DOWN}::double m, i / 400::double e from t)
      select i it, case when i < 715 then (i + 1) / 715::double when i <= {sch.MAX_STEPS - _DOWN} then 1.0::double else l + (1 - l) * 0.1::double end lr,
        case when i < 400 then (1 - e) * 0.85::double + e * 0.97::double when i >= {sch.MAX_STEPS - _DOWN} then 0.97::double * (1 - m) + 0.9::double * m else 0.97::double end momentum, 0.1::double * (1 + cos(pi() * i / {sch.MAX_STEPS})) decay from v""",
    "tuning_schedule": """with t as (select unnest(range(0, 500)) i), v as (select i, i / 499::double p from t)
      select i it, case when p < 0.05::double then (p + 1e-8::double) / 0.05::double when p <= 0.5::double then 1.0::double else 1.0::double - (p - 0.5::double) / 0.5::double end lr,
        (1 - least(i / 300::double, 1)) * 0.85::double + least(i / 300::double, 1) * 0.95::double momentum, greatest(0.0::double, 1 - i / 400::double) rollout_lr from v""",
    "throughput": """with t as (select unnest(range(1, 20)) / 10::double dt), f as (select dt, (12 * 12 * 2 * 768 * 768 + 12 * 2 * 6 * 128 * 1024 + 2 * 768 * 32768)::bigint k from t)
      select dt, 2 accum, k flops_token, 934 rl_steps, 524288 / dt tok_s, 100 * (k * (524288 / dt) * 3) / (989e12::double * 4) mfu from f""",
    "peak_flops": f"with {cte('devices')} select device, case {_RULES} else -1.0::double end flops from devices",
    "log_parse": """select * from (values (0, 'train', 4.123456::double, true), (1, 'train', 3.5::double, true), (1, 'norm', 0.9123::double, true), (1, 'val', 3.4::double, true), (2, 'val_bpb', 1.0312::double, true),
      (3, 'pass@1', 0.25::double, true), (3, 'reward', 0.125::double, true), (3, 'std', 0.2165::double, true), (3, 'len', 181.5::double, true), (4, 'train', null, false), (5, 'train', null, false), (5, 'norm', 2.0::double, true), (6, 'train', 2.75::double, true)) t(step, metric, metric_value, is_finite)""",
    "run_files": "select 1000000::bigint step, 'd20_wide' largest, 'beta' newest",
    "run_metadata": f"""with {cte("configs")} select run, n_layer, array_to_string(list_transform(range(0, n_layer), lambda i: '1.0'), ',') resid_lambdas, array_to_string(list_transform(range(0, n_layer), lambda i: '0.0'), ',') x0_lambdas from configs""",
    "eval_result": f"{_PRED}, {_CLASS.replace('{n}', '4')} {_REPORT}, round({_SHARE[0]}, 4) acc, round({_SHARE[1]}, 4) acc_norm, round({_SHARE[2]}, 4) macro_f1",
}

QUERIES = {
    f.__name__: f
    for f in (
        mc_render, mc_categorical, mc_subjects, mc_completion_tokens, mc_losses, mc_predict, mc_running, mc_classes, mc_report, validation_loss, ema_debiased, running_best,
        reward_extract, group_advantage, reward_stats, pass_at_1, zero_streak, rollout_targets, policy_objective, rollout_seeds, sample_greedy, topk_exact, topk_ties, sample_draw,
        sample_stops, lr_schedule, tuning_schedule, throughput, peak_flops, log_parse, run_files, run_metadata, eval_result,
    )
}


def conv_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons, on small conversations that are wrong in every way."""
    m = F.col("messages")
    return chat.assemble(literal(spark, "chats")).select("conv_id", chat.chat_problem(m).alias("chat_problem"), chat.render_problem(m).alias("render_problem"))


def pack_targets(spark: SparkSession, sf: str) -> DataFrame:
    rows = bestfit.with_targets(literal(spark, "packed_rows"))
    return rows.select("row_no", _joined(F.col("x")).alias("x"), _joined(F.col("y")).alias("y"), F.exists("y", lambda v: v != bestfit.IGNORE).alias("learns"))


SQL |= {
    "conv_problems": f"""with {cte("chats")}, c as (select conv_id, list(role order by turn) roles, list(coalesce(text, chr(1)) order by turn) texts from chats group by conv_id),
      q as (select conv_id, roles whole, case when roles[1] = 'system' then roles[2:] else roles end roles, case when roles[1] = 'system' then texts[2:] else texts end texts from c),
      k as (select *, len(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> case when i % 2 = 1 then 'user' else 'assistant' end)) = 0 alternates from q)
      select conv_id, case when len(roles) < 2 then 'fewer than two messages' when not alternates then 'roles do not alternate' when list_contains(texts, chr(1)) then 'content is no string' end chat_problem,
        case when whole[1] = 'system' and coalesce(whole[2], '') <> 'user' then 'no user message after system' when not alternates then 'roles do not alternate'
          when list_contains(texts, chr(1)) then 'user content is no string' end render_problem from k""",
    "pack_targets": f"""with {cte("packed_rows")}, t as (select row_no, ids[1:len(ids) - 1] x, list_transform(range(2, len(ids) + 1), lambda i: case when mask[i] = 0 then -100 else ids[i] end) y from packed_rows)
      select row_no, array_to_string(x, ',') x, array_to_string(y, ',') y, len(list_filter(y, lambda v: v <> -100)) > 0 learns from t""",
}
QUERIES |= {f.__name__: f for f in (conv_problems, pack_targets)}
