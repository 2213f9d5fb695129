"""Structured Streaming: incremental scans, duplicate suppression, lifecycle counters, isolation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..schemas import ARTIFACTS

BatchFn = Callable[[DataFrame], DataFrame]


def append_batches(stream: DataFrame, transform: BatchFn, out: str, checkpoint: str,
                   keys: list[str] | None = None, mode: str = "append") -> StreamingQuery:
    """Run `transform` on every micro-batch and write its rows once.

    A batch writes its own `batch_id` partition in overwrite mode, so a batch
    repeated after a failure replaces its rows instead of doubling them.  With `keys`, one row of
    each key is written over the whole stream, from the first batch that has the key, however
    late or early its event is; see `_append_unseen`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch)
        if keys:
            _append_unseen(rows, out, checkpoint, keys)
        else:
            rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _append_unseen(rows: DataFrame, out: str, checkpoint: str, keys: list[str]) -> None:
    """Write the rows whose key no earlier call with this `checkpoint` had.

    The keys are keyed state of an inner stream over the rows, kept by key on the executors and saved as a
    log of changes: a call touches the keys of its own rows and never those of earlier output.  Rows are
    appended to `<checkpoint>-rows` first, so a repeated batch adds copies, which the state drops, and
    an inner batch cut off by a failure still finds its files.  Keys are kept for good: first wins without
    a horizon (`skip_seen` has one).
    """
    landed = f"{checkpoint}-rows"
    rows.write.mode("append").parquet(landed)
    # The session of a micro-batch is the stream's own copy; its settings reach no other query.
    session = rows.sparkSession
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    unseen = session.readStream.schema(rows.schema).parquet(landed).dropDuplicates(keys)
    append_batches(unseen, lambda batch: batch, out, f"{checkpoint}-seen").awaitTermination()


def incremental_scan(spark: SparkSession, source: str, out: str, checkpoint: str, transform: BatchFn,
                     schema: str = ARTIFACTS, files_per_batch: int | None = None,
                     keys: list[str] | None = None) -> StreamingQuery:
    """New artifact files to findings, each file once; `keys` as in `append_batches`."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return append_batches(reader.parquet(source), transform, out, checkpoint, keys)


def skip_seen(stream: DataFrame, key: str, event_time: str, horizon: str) -> DataFrame:
    """Drop content whose hash was seen within `horizon`; state is bounded by the watermark."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])


def lifecycle_counts(stream: DataFrame, event_time: str, status: str, window: str = "1 day",
                     lateness: str = "1 hour") -> DataFrame:
    """Items per status and tumbling window; a window's state ends `lateness` after it.

    Write it in update mode (`append_batches(…, mode="update")`) and read it with `latest_counts`.
    """
    return (
        stream.withWatermark(event_time, lateness)
        .groupBy(F.window(event_time, window).alias("w"), F.col(status).alias("status"))
        .agg(F.count("*").alias("items"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "items")
    )


def latest_counts(updates: DataFrame) -> DataFrame:
    """The last count of each window and status among the written updates."""
    return updates.groupBy("window_start", "window_end", "status").agg(F.max_by("items", "batch_id").alias("items"))


def isolate_failures(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Mark each row COMPLETE or FAILED with the names of the failed checks; nothing is raised.

    A check is a boolean Column built from `try_` functions; null counts as failed.
    """
    failed = F.concat_ws("; ", *[
        F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items()
    ])
    return rows.withColumn("error_message", F.nullif(failed, F.lit(""))).withColumn(
        "status", F.when(F.col("error_message").isNull(), "COMPLETE").otherwise("FAILED"))
