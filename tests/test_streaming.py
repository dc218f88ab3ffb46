"""Streams with state, stopped and started in between, against plain loops and batch results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import chat
from weftline.streaming import run_monitor as rm
from weftline.streaming import turn_buffer as tb


def plain_curve(values, beta=0.9):
    """(attempt, step, value, best, streak, ema) after each usable value of one metric; values: (step, value) in order."""
    out, attempt, last, best, streak, e = [], 0, -1, None, 0, 0.0
    for step, x in values:
        if step <= last:
            attempt, best, streak, e = attempt + 1, None, 0, 0.0
        last = step
        if x is not None:
            best = x if best is None else min(best, x)
            streak = streak + 1 if x == 0 else 0
            e = beta * e + (1 - beta) * x
            out.append((attempt, step, x, best, streak, pytest.approx(e)))
    return out


def write(folder, run, name, lines):
    path = folder / f"run={run}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(lines) + "\n")


def test_live_runs_with_a_restart_and_a_truncated_log(spark, tmp_path):
    rng, logs, out = random.Random(2), tmp_path / "logs", str(tmp_path / "out")
    series = {run: [(s, rng.choice([0.0, 0.0, 0.5, 1.25, None])) for s in range(40)] for run in ("a", "b")}
    series["b"] += [(s, 0.25) for s in (3, 4)]  # b's log was truncated and goes on from step 3
    lines = {run: [f"{s} loss {'nan' if x is None else x}" for s, x in values] for run, values in series.items()}
    write(logs, "a", "0.txt", [*lines["a"][:10], "not a line", "", "7"])
    write(logs, "b", "0.txt", lines["b"][:25])
    rm.run_monitor(rm.log_stream(spark, str(logs), 1), out)
    write(logs, "a", "1.txt", lines["a"][10:])
    write(logs, "b", "1.txt", lines["b"][25:40])
    rm.run_monitor(rm.log_stream(spark, str(logs), 2), out)
    write(logs, "b", "2.txt", lines["b"][40:])
    rm.run_monitor(rm.log_stream(spark, str(logs)), out)
    rm.run_monitor(rm.log_stream(spark, str(logs)), out)  # nothing new
    got = rm.stateful_rows(spark, out).collect()
    for run, values in series.items():
        own = sorted((r["attempt"], r["step"], r["metric_value"], r["best"], r["streak"], r["ema"]) for r in got if r["run"] == run)
        assert own == plain_curve(values) and {r["metric"] for r in got} == {"loss"}
    assert max(r["attempt"] for r in got) == 1


def test_turns_in_any_order(spark, tmp_path):
    """Shuffled turns over several batches and a restart give what assemble gives; one without its end comes out on the timer."""
    rng, day = random.Random(3), datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    convs = {c: [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for t in range(rng.randint(1, 6))] for c in range(12)}
    gone = {3: 0, 7: len(convs[7]) - 1}
    rows = [(*r, len(convs[r[0]])) for c in convs.values() for r in c if gone.get(r[0]) != r[1]]
    rng.shuffle(rows)
    rows += [rows[5], (None, 0, "user", "x", 1), (99, 5, "user", "beyond", 2)]
    schema = "conv_id long, turn long, role string, text string, n_turns long, at timestamp"
    src, out = str(tmp_path / "turns"), str(tmp_path / "out")

    def feed(part, minute):
        stamped = [(*r, day + datetime.timedelta(minutes=minute)) for r in part]
        spark.createDataFrame(stamped, schema).coalesce(1).write.mode("append").parquet(src)
        rm.run_stateful(tb.ordered_conversations(spark.readStream.schema(schema).parquet(src)), out)

    for k in range(3):
        feed(rows[k::3], k)
    got = rm.stateful_rows(spark, out)
    assert {r["conv_id"] for r in got.collect()} == set(convs) - set(gone) and all(r["complete"] for r in got.collect())
    feed([(1000, 0, "user", "later", 1)], 200)  # two hours on, the watermark passes the timers
    feed([(1001, 0, "user", "later", 1)], 201)
    told = {r["conv_id"]: (r["complete"], [(m["role"], m["content"]) for m in r["messages"]]) for r in rm.stateful_rows(spark, out).collect()}
    turns = spark.createDataFrame([r for c in convs.values() for r in c], "conv_id long, turn long, role string, text string")
    for r in chat.assemble(turns).collect():
        whole = [(m["role"], m["content"]) for m in r["messages"]]
        gap = gone.get(r["conv_id"])
        assert told[r["conv_id"]] == ((True, whole) if gap is None else (False, whole[:gap]))
    assert set(told) == {*convs, 1000, 1001}


@pytest.mark.parametrize("bad", ["x loss 1", "1 loss", "-1 loss 3"])
def test_lines_that_are_no_metrics(spark, bad):
    from weftline.functions.schedules import parsed_log

    lines = spark.createDataFrame([(bad, "r"), ("4 a 1.5 b inf", "r")], "value string, run string")
    assert sorted(map(tuple, parsed_log(lines, keep=("run",)).filter(F.col("metric") == "a").collect())) == [("r", 4, "a", 1.5)]
