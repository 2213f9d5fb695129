"""Exact de-duplication with an extendible-hash index kept in shared files.

Texts are equal when identical after lower-casing A-Z.  Everything is DataFrame code.

1. Entries.  One row for each different text: rows are grouped by (64-bit hash, text), so
   Spark compares the bytes and combines copies on the map side before they travel.  A text
   with millions of copies leaves each task as one row.
2. Directory.  The leading bits of the hash are the directory index.  It starts at the depth
   at which an average bucket is full; while a bucket holds more than `capacity` entries the
   directory doubles and the overfull buckets split by the next bit, others keep their local
   depth and are named by several directory cells.
3. Index.  Owner tasks get ranges of directory cells (range partitioning), chain entries of
   equal hash behind one another and write their buckets to the shared folder.
4. Look-up.  Each document finds its chain entry by hash and digest and takes the row to keep
   from it.  Only 48 bytes a document move; a hot text is split by the adaptive skew join.

Edge cases: null text counts as empty; rows without doc_id belong to a group but are kept only
if no row of the group has an id; rows that repeat id and text are all marked alike, but the filter keeps one of them; an empty
table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, ascii_lower, numbered, stored

CAPACITY = 16_384
#: The directory may double so often beyond its first depth; buckets still overfull then chain.
DOUBLINGS = 6


def _cell(key: Column, depth: int) -> Column:
    """The leading `depth` bits of a 64-bit hash."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def _text_keys(norm: Column) -> list[Column]:
    return [F.xxhash64(norm).alias("hash"), F.unhex(F.sha2(norm, 256)).alias("digest")]


def entries(docs: DataFrame) -> DataFrame:
    """One row for each different text: hash, digest, keep_id (largest doc_id), group_size."""
    norm = docs.select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    grouped = norm.groupBy(F.xxhash64("norm").alias("hash"), "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return grouped.select("hash", F.unhex(F.sha2("norm", 256)).alias("digest"), "keep_id", "group_size")


def directory(entry_rows: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """Directory cells of the index and their depth: cell, local_depth, bucket.

    The driver sees one flag for each doubling.
    """
    total = entry_rows.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / capacity)))
    last = min(depth + DOUBLINGS, 40)
    open_cells = entry_rows.groupBy(_cell(F.col("hash"), last).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    done = None
    while True:
        bucket = F.shiftrightunsigned("cell", last - depth)
        level = open_cells.withColumn("size", F.sum("n").over(Window.partitionBy(bucket)))
        fits = level if depth == last else level.filter(F.col("size") <= capacity)
        fits = fits.select("cell", F.lit(depth).alias("local_depth"), bucket.alias("bucket"))
        done = fits if done is None else done.unionByName(fits)
        open_cells = level.filter(F.col("size") > capacity).select("cell", "n")
        if depth == last or open_cells.isEmpty():
            return done, last
        depth += 1


def build_index(docs: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """Writes entries, directory and buckets below `folder`; returns the index.

    Columns: cell, bucket, local_depth, hash, chain (0 for the first entry of a hash), digest,
    keep_id, group_size.
    """
    entry_rows = stored(entries(docs), f"{folder}/entries")
    cells, depth = directory(entry_rows, capacity)
    cells = stored(cells, f"{folder}/directory")
    chain = F.row_number().over(Window.partitionBy("cell", "hash").orderBy("digest")) - 1
    owned = entry_rows.withColumn("cell", _cell(F.col("hash"), depth)).join(cells, "cell")
    owned = owned.repartitionByRange("cell").select(
        "cell", "bucket", "local_depth", "hash", chain.alias("chain"), "digest", "keep_id", "group_size")
    return stored(owned, f"{folder}/index")


def exact_duplicates(docs: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain; also its number if given."""
    index = build_index(docs.select("doc_id", "text"), folder, capacity)
    row = [ROW] if ROW in docs.columns else []
    keys = docs.select("doc_id", *row, *_text_keys(ascii_lower(F.col("text"))))
    found = keys.join(index, ["hash", "digest"], "left")
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "bucket", "chain", *row)


def drop_exact_duplicates(docs: DataFrame, folder: str, capacity: int = CAPACITY) -> DataFrame:
    """One row of each text, with all its columns; of rows with the id to keep, the first."""
    rows = numbered(docs, f"{folder}/rows")
    keep = exact_duplicates(rows, folder, capacity).filter("kept").groupBy("text_sha256").agg(F.min(ROW).alias(ROW))
    return rows.join(keep, ROW, "left_semi").select(docs.columns)
