"""Metrics of live runs: best value, streak of zeros and debiased mean of each run's metric, kept in the state store while logs grow.

A run's log is text, lines such as `12 loss 3.4 reward 0`, in files that come one after another. The state of a run and metric is one row
of a few numbers, whatever the log's length: its last step, least value, streak, mean, and how often it has begun anew. A batch's lines of a
run are taken in the order of their files' names and of their steps. A step that is not beyond the last one says that the log was truncated:
the run begins anew, as its next attempt. Values that are not finite give no row, but their steps advance the mean's exponent, and they end
no streak. A stop loses nothing: state and offsets are committed together, and the sink takes each batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline.functions.schedules import parsed_log
from weftline.session import ship

#: The store that keyed state with several variables and timers needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

OUT = "run string, metric string, attempt int, step long, metric_value double, best double, streak long, ema double, debiased double"


class Curve(StatefulProcessor):
    """The state of one run's metric."""

    def __init__(self, beta: float):
        self.beta = beta

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("curve", "attempt int, last_step long, best double, streak long, ema double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempt, last, best, streak, ema = self.state.get() if self.state.exists() else (0, -1, None, 0, 0.0)
        new, out = pd.concat(list(rows)).sort_values(["file", "step"], kind="stable"), []  # a run's lines in a batch
        for step, x in zip(new["step"].tolist(), new["metric_value"].tolist(), strict=True):
            if step <= last:
                attempt, best, streak, ema = attempt + 1, None, 0, 0.0
            last = step
            if x is None or not isfinite(x):
                continue
            best = x if best is None else min(best, x)
            streak = streak + 1 if x == 0 else 0
            ema = self.beta * ema + (1 - self.beta) * x
            out.append((*key, attempt, step, x, best, streak, ema, ema / (1 - self.beta ** (step + 1))))
        self.state.update((attempt, last, best, streak, ema))
        if out:
            yield pd.DataFrame(out, columns=["run", "metric", "attempt", "step", "metric_value", "best", "streak", "ema", "debiased"])

    def close(self) -> None:
        pass


def log_stream(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """run, file, metric, step, metric_value of the logs in path/run=.../*.txt, as they come."""
    ship(spark)
    lines = spark.readStream.schema("value string, run string").option("maxFilesPerTrigger", files_a_batch).text(path)
    named = lines.select("value", "run", F.col("_metadata.file_name").alias("file"))
    return parsed_log(named, keep=("run", "file")).filter("step is not null")


def monitor(logs: DataFrame, beta: float = 0.9) -> DataFrame:
    """logs: a stream of run, file, metric, step, metric_value. A row for each usable value, with the run's state after it."""
    own = logs.select("run", "file", "metric", F.col("step").cast("long").alias("step"), "metric_value")
    return own.groupBy("run", "metric").transformWithStateInPandas(statefulProcessor=Curve(beta), outputStructType=OUT, outputMode="Append", timeMode="None")


def run_monitor(logs: DataFrame, out: str, beta: float = 0.9) -> None:
    """Takes all lines that there are now, then stops; called again, it goes on where it stopped."""
    run_stateful(monitor(logs, beta), out)


def run_stateful(rows: DataFrame, out: str) -> None:
    """Writes a stream's rows to out/rows, its state beside them, until it has seen all that there is now."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        query = rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(*((PROVIDER[0], before) if before else PROVIDER))


def stateful_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/rows")
