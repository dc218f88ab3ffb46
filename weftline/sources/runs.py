"""Files of training runs: checkpoints' metadata, logs, evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def padded(number: Column, digits: int = 6) -> Column:
    """A number of so many digits at least; longer ones stay whole, where lpad would cut them."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(digits)), "0")


def latest_step(paths: DataFrame, column: str = "path") -> DataFrame:
    """One row: the greatest step, as a number, among names like model_000100.pt."""
    step = F.regexp_extract(F.col(column), r"model_(\d+)\.pt$", 1)
    return paths.agg(F.max(F.when(step != "", step.cast("long"))).alias("step"))


def largest_tag(tags: DataFrame) -> DataFrame:
    """tags: tag, modified. The tag d<N...> of the greatest N, else the one modified last."""
    n = F.regexp_extract("tag", r"^d(\d+)", 1)
    number = F.when(n != "", n.cast("long"))
    # null numbers sort first, so any numbered tag wins
    return tags.agg(F.max_by("tag", F.struct(number.alias("n"), F.when(number.isNull(), F.col("modified")).alias("m"))).alias("tag"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_metadata(row: DataFrame, path: str, rank: int = 0) -> None:
    """Rank 0 alone writes."""
    if rank == 0:
        row.coalesce(1).write.mode("overwrite").json(path)


def patched_config(configs: DataFrame) -> DataFrame:
    """Configs of older runs: a key no longer known goes, and missing weights get their defaults for n_layer layers."""
    out = configs.drop("window_pattern")
    for name, value in (("resid_lambdas", 1.0), ("x0_lambdas", 0.0)):
        default = F.array_repeat(F.lit(value), F.col("n_layer").cast("int"))
        out = out.withColumn(name, F.coalesce(F.col(name), default) if name in out.columns else default)
    return out


def write_generation(rows: DataFrame, path: str, generation: int) -> None:
    """Adds the files of one generation of runs, with whatever columns they have."""
    rows.write.mode("append").parquet(f"{path}/generation={generation}")


def read_generations(spark: SparkSession, path: str, names: list[str], defaults: dict[int, dict]) -> DataFrame:
    """generation and the wanted columns of run files of all generations, whose columns may differ: the files' schemas are merged, columns that
    are not wanted are not read, and what files of a generation lack has that generation's default (or is null). Filters on the
    generation prune folders, others reach the scan."""
    files = spark.read.option("mergeSchema", True).option("basePath", path).parquet(path)
    kinds = dict(files.dtypes)

    def column(name: str) -> F.Column:
        own = F.col(name) if name in kinds else F.lit(None)
        for generation, values in defaults.items():
            if name in values:
                own = F.when(own.isNull() & (F.col("generation") == generation), F.lit(values[name])).otherwise(own)
        return own.cast(kinds[name]).alias(name) if name in kinds else own.alias(name)

    return files.select(F.col("generation").cast("int").alias("generation"), *map(column, names))


def append_log(lines: DataFrame, path: str, resuming: bool) -> None:
    """Adds lines to a run's log, or starts it anew."""
    lines.write.mode("append" if resuming else "overwrite").text(path)


def four_places(ratio: Column) -> Column:
    """A ratio to four places as SQL's round of a double makes it: the double times 10,000, halves away from zero. F.round goes by the shortest decimal that stands for the double, and gives 0.0002 for 0.00015."""
    return F.round(ratio * 10000, 0) / 10000


def write_result(report: DataFrame, path: str) -> None:
    """One JSON object of an evaluation's figures, ratios to four places."""
    ratios = ("acc", "acc_norm", "macro_f1")
    report.select(*(four_places(F.col(c)).alias(c) if c in ratios else F.col(c) for c in report.columns)).coalesce(1).write.mode("overwrite").json(path)
