"""Queries that read `events` as the metrics of runs: an event is a step, its value a loss, its user a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators import metrics
from weftline.operators.prefix import numbered
from weftline.session import table

BETA = 0.9


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    """run, step (from 0 in each run), value, event_type of every event."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", "event_type", "value")
    step = F.row_number().over(Window.partitionBy("run").orderBy("event_id")) - 1
    return e.withColumn("step", step.cast("long"))


def all_steps(spark: SparkSession, sf: str) -> DataFrame:
    """step (from 0, over all events), value, event_type."""
    return numbered(table(spark, sf, "events").select("event_id", "event_type", "value"), ["event_id"], "step")


def micro(value: str) -> F.Column:
    """Millionths, rounded at a third, which no decimal number meets, so that engines agree."""
    return F.floor(F.col(value) * 1e6 + 1 / 3).cast("long").alias(f"{value}_micro")


def ema_users(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.debiased_ema(by_user(spark, sf), BETA, by="run")
    return out.select("run", "step", micro("ema"), micro("debiased"))


def ema_events(spark: SparkSession, sf: str) -> DataFrame:
    """All events as one series."""
    out = metrics.debiased_ema(all_steps(spark, sf).withColumn("run", F.lit("all")), BETA, by="run")
    return out.select("step", micro("ema"), micro("debiased"))


_USERS = "u as (select user_id run, row_number() over (partition by user_id order by event_id) - 1 step, event_type, value x from events)"
_ALL = "u as (select 'all' run, row_number() over (order by event_id) - 1 step, event_type, value x from events)"
#: Weights below 0.9 ** 400 are lost to double precision.
_EMA = f"e as (select a.run, a.step, sum({1 - BETA}::double * b.x * pow({BETA}::double, a.step - b.step)) ema from u a join u b on a.run = b.run and b.step <= a.step and b.step > a.step - 400 group by a.run, a.step)"
micro_sql = lambda x, name: f"floor(({x}) * 1e6::double + {1 / 3}::double)::bigint {name}_micro"
_TOLD = f"{micro_sql('ema', 'ema')}, {micro_sql(f'ema / (1 - pow({BETA}::double, step + 1))', 'debiased')}"

SQL = {
    "ema_users": f"with {_USERS}, {_EMA} select run, step, {_TOLD} from e",
    "ema_events": f"with {_ALL}, {_EMA} select step, {_TOLD} from e",
}

QUERIES = {f.__name__: f for f in (ema_users, ema_events)}
