"""Application archives as a table of entries."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import printable_runs
from ..operators.admission import ARCHIVE_TEXT, BINARY_SUFFIXES, Limits
from .targets import pool_targets, text_targets

ENTRY_SCHEMA = (
    "app_id string, archive_size bigint, entry_seq bigint, entry_name string, "
    "file_size bigint, compress_size bigint, error string"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(app_id, sha256, archive_size, content) of every file below `path`.

    `content` is only read by plans that use it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("app_id"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("archive_size"),
        "content",
    )


def _listing(app_id: str, content: bytes) -> list[tuple]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [
                (app_id, len(content), i, e.filename, e.file_size, e.compress_size, None)
                for i, e in enumerate(z.infolist())
            ]
    except Exception as exc:  # a damaged archive becomes a row, not a failed job
        return [(app_id, len(content), None, None, None, None, f"{type(exc).__name__}: {exc}")]


def archive_entries(archives: DataFrame) -> DataFrame:
    """One row per archive entry; an unreadable archive gives one row with `error` set.

    Only the zip directory is decoded in Python, archive by archive.
    """
    columns = [c.split()[0] for c in ENTRY_SCHEMA.split(", ")]

    def list_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for a, c in zip(pdf["app_id"], pdf["content"]) for r in _listing(a, bytes(c))]
            out = pd.DataFrame(rows, columns=columns)
            for c in ("archive_size", "entry_seq", "file_size", "compress_size"):
                out[c] = out[c].astype("Int64")
            yield out

    return archives.select("app_id", "content").mapInPandas(list_batches, ENTRY_SCHEMA)


CONTENT_SCHEMA = "app_id string, entry_seq bigint, entry_name string, text string, dex binary, error string"


def _wanted(name: str, size: int, limits: Limits) -> str | None:
    """`text`, `dex` or nothing, from the name and the declared size alone."""
    path = name.replace("\\", "/")
    if not path or "\0" in path or path.startswith("/") or path[1:2] == ":" or ".." in path.split("/"):
        return None
    if name.lower().endswith(tuple(BINARY_SUFFIXES)):
        return None
    if name.endswith(".dex"):
        return "dex" if size <= limits.scanned_file_bytes * limits.dex_factor else None
    text = name.endswith(tuple(ARCHIVE_TEXT)) or name == "AndroidManifest.xml"
    return "text" if text and size <= limits.scanned_file_bytes else None


def archive_contents(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Text entries and dex entries of each archive, one row per entry.

    Entries leave the task one at a time, so a batch never holds more than one
    archive and one decompressed entry.  What cannot be read is a row with `error`
    set; an archive that is no archive has no entry in it.
    """

    def row(app: str, seq: int | None, name: str | None, text: str | None, dex: bytes | None, error: str | None) -> pd.DataFrame:
        return pd.DataFrame({"app_id": [app], "entry_seq": pd.array([seq], "Int64"), "entry_name": [name], "text": [text],
                             "dex": [dex], "error": [error]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for app, content in zip(pdf["app_id"], pdf["content"]):
                try:
                    z = zipfile.ZipFile(io.BytesIO(bytes(content)))
                except Exception as exc:
                    yield row(app, None, None, None, None, f"{type(exc).__name__}: {exc}")
                    continue
                with z:
                    for i, e in enumerate(z.infolist()):
                        kind = _wanted(e.filename, e.file_size, limits)
                        if kind is None:
                            continue
                        try:
                            data = z.read(e)
                        except Exception as exc:
                            yield row(app, i, e.filename, None, None, f"{type(exc).__name__}: {exc}")
                            continue
                        text = data.decode("utf-8", "replace") if kind == "text" else None
                        yield row(app, i, e.filename, text, None if kind == "text" else data, None)

    return archives.select("app_id", "content").mapInPandas(read, CONTENT_SCHEMA)


def string_pool(binaries: DataFrame, content: str = "content", order: str | None = None) -> DataFrame:
    """Distinct printable ASCII runs of at least four characters per application.

    `string_seq` is the first position of the string, after `order` if several
    binaries of an application are read.
    """
    text = F.decode(F.col(content), "ISO-8859-1")
    base = F.shiftleft(F.col(order).cast("bigint"), 32) if order else F.lit(0).cast("bigint")
    return (
        binaries.select("app_id", base.alias("base"), F.posexplode(printable_runs(text)).alias("pos", "string"))
        .groupBy("app_id", "string")
        .agg(F.min(F.col("base") + F.col("pos")).alias("string_seq"))
    )


def artifacts_from_archives(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Scan table of a set of archives; only the strings of the pools are shuffled.

    All dex files of an application give one string-pool target, each text entry one
    file target.  Entries that cannot be read are listed by `unreadable_entries`.
    """
    contents = archive_contents(archives, limits)
    pools = pool_targets(string_pool(contents.where("dex IS NOT NULL"), "dex", "entry_seq"))
    files = contents.where("text IS NOT NULL").select(
        "app_id", F.col("entry_seq").alias("file_seq"), F.col("entry_name").alias("location"), "text")
    return text_targets(files, pools)


def unreadable_entries(archives: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(app_id, entry_seq, entry_name, error) of archives and entries that could not be read."""
    return archive_contents(archives, limits).where("error IS NOT NULL").select("app_id", "entry_seq", "entry_name", "error")
