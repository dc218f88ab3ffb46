"""Session settings and the folder that every executor shares."""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("weftline")
    settings = {
        "spark.sql.shuffle.partitions": shuffle_partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, str(value))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; unset, a temporary one, in local mode only."""
    ship(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Paths made while it is open, all but the kept ones to be deleted when it closes."""

    def __init__(self):
        self.paths: list[str] = []

    def keep(self, *tables: DataFrame) -> None:
        """Tables (of materialize) that are read later still; an enclosing scratch takes them over."""
        wanted = {t._weftline_path for t in tables}
        self.paths = [p for p in self.paths if p not in wanted]
        if len(_open_scratches) > 1:
            _open_scratches[-2].paths += wanted


_open_scratches: list[Scratch] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes the intermediate tables of the block when it ends, so that long sessions don't gather them."""
    own = Scratch()
    _open_scratches.append(own)
    try:
        yield own
    finally:
        _open_scratches.remove(own)
        for path in own.paths:
            delete_path(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends, or before by an open scratch."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    if _open_scratches:
        _open_scratches[-1].paths.append(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows that go to a Python worker at once while a table is materialized; a row may hold a long text or array.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Holds Arrow batches to BATCH_ROWS rows for the actions inside, then restores the session's setting."""
    before = spark.conf.get(BATCH_KEY)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


LISTERS_KEY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """Parquet in many folders, listed by a few tasks for each core; by itself Spark takes a task for each folder, up to 10,000."""
    before = spark.conf.get(LISTERS_KEY)
    spark.conf.set(LISTERS_KEY, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(LISTERS_KEY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def counted(df: DataFrame, name: str = "counted") -> tuple[DataFrame, Observation]:
    """df, and a count of its rows that the first action over it takes along the way: `.get["n"]` when it has ended."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where PYTHONPATH or --py-files don't: by path in local mode, else as a zip."""
    root, sc = str(Path(__file__).resolve().parents[1]), spark.sparkContext
    if getattr(sc, "_weftline_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or root.endswith((".zip", ".egg")):
        return
    sc._weftline_shipped = True
    if sc.master.startswith("local["):
        known = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *known])
    else:
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/weftline", "zip", root, "weftline"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
