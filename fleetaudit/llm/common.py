"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freed_shuffles

#: Column with the number of a row.
ROW = "__row"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a bitmap of keys: at most 2^19 rows of 16 bytes, however many keys there are.
MARKS = 1 << 25


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty.

    `lower` is fast but also changes letters outside ASCII, so it serves only texts
    that have none.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts the lineage and frees its shuffle files."""
    with freed_shuffles(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, path: str) -> DataFrame:
    """The rows with a number of their own in `ROW`, the same each time they are read.

    It is made of the file (one row a file goes to the driver) and the place in it.  Rows without such a place
    are stored first; `docs` must not repeat rows of a file, as an explode or a join would.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, path)
    files = docs.select("_metadata.file_path").distinct().orderBy("file_path").collect()
    number = docs.sparkSession.createDataFrame(
        [(r["file_path"], i << 40) for i, r in enumerate(files)], "__file string, __first long")
    placed = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    return placed.join(F.broadcast(number), "__file").select(*docs.columns, (F.col("__first") + F.col("__place")).alias(ROW))


def marks(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the keys by their hash, a row for each 64 bits.  It tells which rows cannot have one of the keys."""
    return keys.groupBy(F.expr(f"shiftright(pmod(xxhash64({key}), {MARKS}), 6)").alias("__word")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST(pmod(xxhash64({key}), 64) AS INT)))").alias("__bits"))


def marked(rows: DataFrame, key: str, bitmap: DataFrame, there: bool = True) -> DataFrame:
    """The rows whose key may be among those of `marks`, without moving them; or all others, which have none of them."""
    word = F.expr(f"shiftright(pmod(xxhash64({key}), {MARKS}), 6)")
    bit = F.expr(f"coalesce(shiftright(__bits, CAST(pmod(xxhash64({key}), 64) AS INT)) & 1, 0) = {int(there)}")
    return rows.withColumn("__word", word).join(F.broadcast(bitmap), "__word", "inner" if there else "left").filter(bit).select(rows.columns)


def small_batches(spark: SparkSession, limit: int = 4 << 20) -> None:
    """Has Spark hand the session's Arrow batches over at `limit` bytes, as `small_slices` cuts them anyway.

    By rows alone a batch of long texts or of index segments may take tens of MB, several times over on its way.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def small_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `limit` bytes of text.

    A row is never cut, so a run holds one row at least.  Keeps the numpy buffers of
    an operator small however long the texts of a batch are.
    """
    for batch in batches:
        sizes = batch.column(text).nbytes
        if sizes <= limit:
            if batch.num_rows:
                yield batch
            continue
        start = used = 0
        for i, value in enumerate(batch.column(text)):
            n = value.as_buffer().size if value.is_valid else 0
            if i > start and used + n > limit:
                yield batch.slice(start, i - start)
                start, used = i, 0
            used += n
        yield batch.slice(start)


def one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch of few but large rows, one Python row at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]
