"""Removal of boilerplate lines by their frequency within a site.

Pages are grouped by host.  A line is boilerplate of a host if it stands on at least `least_pages` of its
pages and on more than `ratio` of them.  Lines are compared without blanks at their ends and counted once
a page; empty lines are never boilerplate.

All steps are DataFrame code.  Counts are taken from 128-bit line keys that are combined on the map side
before they move, so a line that stands on every page of a large host is one row a task.  Boilerplate lines
are few: a page of `n` lines adds to `n / ratio` of them at most.  They find their pages by a join on host
and key, and only these short hits and the texts are joined by page; no host is gathered in one task.

Edge cases: null text is empty and stays empty; a null host is the host named by the empty text; rows
that repeat an id on one host share their hits and count as pages each; a text may lose all lines and
become empty; texts of any length are read whole; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
LEAST_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    line = F.trim(line)
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate_lines(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, a, b (the line key), pages: the boilerplate of each host; needs host, keys."""
    counts = pages.select("host", F.explode("keys").alias("k")).groupBy("host", "k.a", "k.b").agg(F.count(F.lit(1)).alias("pages"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    return counts.filter(F.col("pages") >= least_pages).join(totals, "host").filter(
        F.col("pages") > ratio * F.col("host_pages")).select("host", "a", "b", "pages")


def drop_boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """doc_id, host, n_lines, n_dropped, text for each row of doc_id, text and a host column."""
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), "text")
    filled = F.filter(_lines(F.col("text")), lambda x: F.trim(x) != "")
    pages = rows.select("doc_id", "host", F.array_distinct(F.transform(filled, _key)).alias("keys"))
    bad = boilerplate_lines(pages, ratio, least_pages)
    found = pages.select("doc_id", "host", F.explode("keys").alias("k")).select("doc_id", "host", "k.a", "k.b").join(
        bad.select("host", "a", "b"), ["host", "a", "b"])
    hits = found.groupBy("doc_id", "host").agg(F.collect_set(F.struct("a", "b")).alias("hits")).select(
        F.col("doc_id").alias("hit_id"), F.col("host").alias("hit_host"), "hits")
    joined = rows.join(hits, rows["doc_id"].eqNullSafe(hits["hit_id"]) & (rows["host"] == hits["hit_host"]), "left")
    lines = _lines(F.col("text"))
    kept = F.when(F.col("hits").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.array_contains("hits", _key(x))))
    return joined.select(
        "doc_id", "host", F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))
