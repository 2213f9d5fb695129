"""Scan history: summaries, pages, lookups, upsert and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.metrics import version_label
from ..session import fine

# The four orders of the history list.
ORDERS: dict[str, tuple[str, bool]] = {
    "Newest First": ("created_at", False),
    "Oldest First": ("created_at", True),
    "Highest Risk": ("risk_score", False),
    "Lowest Risk": ("risk_score", True),
}


def scan_counts(findings: DataFrame, name: str) -> DataFrame:
    """Rows per scan; combined before the shuffle, so a huge scan costs one row per task."""
    return findings.groupBy("scan_id").agg(F.count("*").alias(name))


def history(scans: DataFrame, apps: DataFrame, findings: DataFrame, permissions: DataFrame) -> DataFrame:
    """Scan summaries with application data and both row counts."""
    app = apps.select(
        "app_id", F.col("sha256").alias("file_hash"), "filename", "package_name",
        version_label(F.col("version_name"), F.col("version_code")).alias("version"),
        F.col("analyzed_at").alias("analysis_timestamp"), "app_name",
    )
    return (
        scans.join(app, "app_id")
        .join(scan_counts(findings, "findings_count"), "scan_id", "left")
        .join(scan_counts(permissions, "permissions_count"), "scan_id", "left")
        .select(
            F.col("scan_id").alias("id"), "risk_score", "risk_rating", "duration", "analyzer_version", "created_at",
            F.col("app_id").alias("application_id"), "file_hash", "filename", "package_name", "version",
            "analysis_timestamp", "app_name",
            F.coalesce("findings_count", F.lit(0)).alias("findings_count"),
            F.coalesce("permissions_count", F.lit(0)).alias("permissions_count"),
        )
    )


def _newest_first(ident: str) -> list[Column]:
    return [F.col("created_at").desc(), F.col(ident)]


def history_page(rows: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, newest first; runs as a distributed top-k of offset + limit rows."""
    return rows.orderBy(*_newest_first("id")).offset(max(0, offset)).limit(max(1, limit))


def order_history(rows: DataFrame, order: str) -> DataFrame:
    column, ascending = ORDERS[order]
    key = F.coalesce(F.col(column), F.lit(0)) if column == "risk_score" else F.col(column)
    return rows.orderBy(key.asc() if ascending else key.desc(), "id")


def search_history(rows: DataFrame, query: str) -> DataFrame:
    q = query.strip().lower()
    name = F.coalesce(F.nullif("app_name", F.lit("")), F.nullif("filename", F.lit("")), F.lit(""))
    haystack = F.lower(F.concat_ws(" ", name, F.coalesce("package_name", F.lit(""))))
    return rows.where(F.contains(haystack, F.lit(q))) if q else rows


def find_by_hash(scans: DataFrame, apps: DataFrame, findings: DataFrame, permissions: DataFrame, file_hash: str) -> DataFrame:
    """History of one content hash; the hash filter reaches the application scan first.

    Rows of dependants need no more than their scan to be counted, and move in small partitions.
    """
    same = apps.where(F.col("sha256") == file_hash.strip())
    wanted = scans.join(same.select("app_id"), "app_id", "left_semi")
    ids = fine(wanted.select("scan_id"), "scan_id")
    kept = lambda rows: fine(rows.select("scan_id"), "scan_id").join(ids, "scan_id", "left_semi")
    return history(wanted, same, kept(findings), kept(permissions))


def newest_per_hash(scans: DataFrame, apps: DataFrame) -> DataFrame:
    newest = Window.partitionBy("sha256").orderBy(F.col("created_at").desc(), "scan_id")
    return (
        scans.join(apps.select("app_id", "sha256"), "app_id")
        .withColumn("rn", F.row_number().over(newest))
        .where("rn = 1")
        .drop("rn")
    )


def upsert_scans(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace by id: the last row written for an id wins."""
    both = existing.withColumn("__batch", F.lit(0)).unionByName(incoming.withColumn("__batch", F.lit(1)))
    last = Window.partitionBy("scan_id").orderBy(F.col("__batch").desc(), F.col("created_at").desc())
    return both.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "__batch")


def delete_scans(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the given scans, their dependants and applications left without scans.

    Rows meet in small partitions, so what a task sorts is far below a core's share of a table.
    """
    gone = fine(ids.select("scan_id"), "scan_id").distinct()
    left = lambda name: fine(tables[name], "scan_id").join(gone, "scan_id", "left_anti")
    scans = left("scans")
    touched = fine(tables["scans"], "scan_id").join(gone, "scan_id", "left_semi").select("app_id")
    orphans = fine(touched, "app_id").distinct().join(fine(scans.select("app_id"), "app_id"), "app_id", "left_anti")
    return {
        "scans": scans,
        "findings": left("findings"),
        "permissions": left("permissions"),
        "apps": fine(tables["apps"], "app_id").join(orphans, "app_id", "left_anti"),
    }


def clear_history(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty tables and the number of scans they held."""
    removed = tables["scans"].agg(F.count("*").alias("removed"))
    return {name: df.limit(0) for name, df in tables.items()}, removed
