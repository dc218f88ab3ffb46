"""Queries that feed given tables to streams with state in several goes, each a new start."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.event_queries import micro, micro_sql
from weftline.operators.prefix import numbered
from weftline.session import new_path, table
from weftline.streaming import run_monitor, turn_buffer

RUNS, ALL = 20, 1_000_000
#: Conversations that lose a turn on the way.
LOST, LOST_TURN = "conv_id % 10 = 3", 1


def live_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Events as logs of runs, which grow while they are watched: the loss and the reward of each step, an error being a reward of 0."""
    e = numbered(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), ["event_id"], "step")
    reward = F.when(F.col("event_type") == "error", "0").otherwise("1")
    line = F.concat_ws(" ", "step", F.lit("loss"), F.col("value").cast("string"), F.lit("reward"), reward)
    lines = e.select(F.pmod("user_id", F.lit(RUNS)).alias("run"), "step", line.alias("value"))
    n, logs, out = e.count(), new_path(spark, "logs"), new_path(spark, "live")
    for part in (F.col("step") < n // 2, F.col("step") >= n // 2):
        # names of files follow the steps
        sorted_ = lines.filter(part).repartitionByRange("step").sortWithinPartitions("run", "step").select("run", "value")
        sorted_.write.mode("append").partitionBy("run").text(logs)
        run_monitor.run_monitor(run_monitor.log_stream(spark, logs, ALL), out)
    rows = run_monitor.stateful_rows(spark, out)
    return rows.select(F.col("run").cast("long").alias("run"), "metric", "attempt", "step", "metric_value", "best", "streak", micro("ema"), micro("debiased"))


def live_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns in three shuffled goes, some lost; whole conversations at once, the others when their time is up."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    announced = c.withColumn("n_turns", F.count("*").over(Window.partitionBy("conv_id")))
    sent = announced.filter(f"not ({LOST} and turn = {LOST_TURN})").withColumn("go", F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    src, out = new_path(spark, "turns"), new_path(spark, "live")
    at = lambda minutes: (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.lit(minutes))).alias("at")
    beat = lambda k: spark.range(1).select(F.lit(-k).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("").alias("text"), F.lit(1).cast("long").alias("n_turns"))
    goes = [(sent.filter(F.col("go") == k).drop("go"), k) for k in range(3)] + [(beat(1), 200), (beat(2), 201)]  # the last move the clock on
    for rows, minutes in goes:
        rows.select("*", at(minutes)).write.mode("append").parquet(src)
        stream = spark.readStream.schema("conv_id long, turn long, role string, text string, n_turns long, at timestamp").parquet(src)
        run_monitor.run_stateful(turn_buffer.ordered_conversations(stream), out)
    done = run_monitor.stateful_rows(spark, out).filter("conv_id >= 0")
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return done.select("conv_id", "complete", F.size("messages").cast("long").alias("n"), F.md5(text).alias("text_md5"))


SQL = {
    "live_metrics": f"""with e as (select row_number() over (order by event_id) - 1 step, user_id % {RUNS} run, value, case when event_type = 'error' then 0.0 else 1.0 end reward from events),
      m as (select run, 'loss' metric, step, value::double x from e union all select run, 'reward', step, reward::double from e),
      n as (select *, row_number() over (partition by run, metric order by step) i, min(x) over (partition by run, metric order by step rows unbounded preceding) best,
        count(*) filter (x <> 0) over (partition by run, metric order by step rows unbounded preceding) g from m),
      s as (select *, case when x = 0 then count(*) filter (x = 0) over (partition by run, metric, g order by step rows unbounded preceding) else 0 end streak from n),
      w as (select a.run, a.metric, a.step, sum(0.1::double * b.x * pow(0.9::double, a.i - b.i)) ema from s a join s b on a.run = b.run and a.metric = b.metric and b.i <= a.i and b.i > a.i - 400 group by all)
      select run, metric, 0 attempt, step, x metric_value, best, streak, {micro_sql("ema", "ema")}, {micro_sql("ema / (1 - pow(0.9::double, step + 1))", "debiased")} from s join w using (run, metric, step)""",
    "live_conversations": f"""with c as (select *, {LOST} and count(*) over (partition by conv_id) > {LOST_TURN} lost from conversations)
      select conv_id, not lost complete, count(*) n, md5(string_agg(role || ':' || text, '|' order by turn)) text_md5 from c where not lost or turn < {LOST_TURN} group by conv_id, lost""",
}

QUERIES = {f.__name__: f for f in (live_metrics, live_conversations)}
