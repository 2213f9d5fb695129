"""Session defaults, the shared working folder and table loading."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Partitions that `fine` makes for each core, at least.
FINE_PER_CORE = 16


def build_session(app_name: str = "fleetaudit", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared folder the cluster names.

    `spark.checkpoint.dir` wins; only an unset value on a local master falls
    back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.gettempdir()
    return os.path.join(shared, f"fleetaudit-{uuid.uuid4().hex}")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written in this block takes its shuffle files along when it is done.

    Else they stay until the driver collects its garbage.  It is for tables that are read back from where they are
    written, so that nothing reads their shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def step(df: DataFrame) -> DataFrame:
    """The table, written to a new folder of the shared one and read back; its shuffle files end before the next step begins."""
    folder = work_dir(df.sparkSession)
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy scan as many tasks as there are cores.

    Only an input with fewer splits than cores is moved, so at most one split
    per core travels; a large table keeps its own splits and does not shuffle.
    `keys` identify a row, which makes the placement even and repeatable.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def fine(df: DataFrame, *keys: str) -> DataFrame:
    """Place the rows by `keys` in many small partitions, for a join or a grouping by them that holds most of a table.

    Spark itself joins small partitions by their compressed bytes to about one per core, so that a task sorts and
    holds more rows with every size of the table.  Partitions of a number that is asked for stay as they are.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), FINE_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
