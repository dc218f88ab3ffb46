"""Cases of the fourth round's findings: each failed before its finding was mended."""

import duckdb
import pytest
from pyspark.sql import functions as F

from weftline.operators import choices
from weftline.plans import catalogue
from weftline.sources import runs


@pytest.mark.parametrize("tasks", [1, 5])
def test_f3_equal_choices_tie(spark, tasks):
    """Losses of equal choices have the same sum and mean, in whatever order the rows come: the lowest choice wins."""
    losses = [0.1, 0.2, 0.3, 0.7, 1e-9, 12.3]
    told = lambda item, choice, places: [(item, choice, 1, p + 1, 1, losses[p]) for p in places]
    rows = [r for item in range(20) for c, places in enumerate(([0, 1, 2, 3, 4, 5], [5, 4, 3, 2, 1, 0], [2, 0, 1, 5, 3, 4], [4, 2, 5, 1, 0, 3])) for r in told(item, (c + item) % 4, places)]
    schema = "item int, choice int, label int, pos int, mask int, loss double"
    summed = choices.masked_losses(spark.createDataFrame(rows, schema).repartition(tasks, "loss" if tasks > 1 else "mask"))
    assert summed.select("loss_sum", "loss_mean").distinct().count() == 1
    assert {(r["pred"], r["pred_norm"]) for r in choices.predictions(summed).collect()} == {(0, 0)}


def test_f3_losses_that_are_null(spark):
    """As sums and means in SQL: null losses don't count, and nothing but null gives null."""
    rows = [(1, 0, 0, 1, 1, 2.0), (1, 0, 0, 2, 1, None), (1, 0, 0, 3, 1, 4.0), (1, 1, 0, 1, 1, None), (1, 2, 0, 0, 1, 5.0), (1, 3, 0, 1, 0, 5.0), (1, 3, 0, 2, 1, float("inf"))]
    got = choices.masked_losses(spark.createDataFrame(rows, "item int, choice int, label int, pos int, mask int, loss double")).orderBy("choice").collect()
    assert [(r["choice"], r["loss_sum"], r["loss_mean"]) for r in got] == [(0, 6.0, 3.0), (1, None, None), (3, float("inf"), float("inf"))]


def test_f2_classes_of_tied_choices(spark):
    """A tie is counted for the lowest class, whichever of the equal choices' rows come first."""
    losses = [0.1, 0.2, 0.3]
    rows = [(item, c, 2, p + 1, 1, losses[p]) for item in range(8) for c, places in ((1, [0, 1, 2]), (3, [2, 1, 0])) for p in places]
    tokens = spark.createDataFrame(rows, "item int, choice int, label int, pos int, mask int, loss double").coalesce(1)
    got = choices.class_report(choices.predictions(choices.masked_losses(tokens))).orderBy("class").collect()
    assert [(r["class"], r["tp"], r["fp"], r["fn"]) for r in got] == [(0, 0, 0, 0), (1, 0, 8, 0), (2, 0, 0, 8), (3, 0, 0, 0)]


@pytest.mark.parametrize("n", [4000, 20000, 24985])
def test_f1_ratios_are_rounded_as_in_sql(spark, tmp_path, n):
    """Every share of n, halves of the fourth place included."""
    want = [r[0] for r in duckdb.sql(f"select round(k / {n}, 4) from range({n} + 1) t(k) order by k").fetchall()]
    share = F.col("id") / n
    report = spark.range(n + 1).select(F.col("id").alias("num_total"), share.alias("acc"), (1 - share).alias("acc_norm"), share.alias("macro_f1"))
    runs.write_result(report, f"{tmp_path}/result")
    got = [(r["acc"], r["macro_f1"]) for r in spark.read.json(f"{tmp_path}/result").orderBy("num_total").collect()]
    assert got == [(w, w) for w in want]


def test_f4_throughput_of_odd_values(spark, tmp_path):
    """To the last bit, with zeros of both signs (which a list of decimals in SQL does not hold), numbers too small to divide by, and none."""
    values = ["0", "-0", "5e-324", "-5e-324", "1e-303", "1e308", "-2.5", "3", "nan", "inf", "-inf", "0.01", "560.21"]
    made = " union all ".join([f"select {i}::bigint event_id, '{v}'::double as value" for i, v in enumerate(values)] + ["select 99, null"])
    con = duckdb.connect()
    con.sql(f"copy ({made}) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    assert con.execute("select count(*) from events where value = 0 and value::varchar = '-0.0'").fetchone() == (1,)
    shown = lambda rows: sorted(map(repr, rows))
    got = catalogue.QUERIES["throughput"](spark, str(tmp_path))
    assert shown(tuple(r) for r in got.collect()) == shown(con.execute(catalogue.SQL["throughput"]).fetchall())
