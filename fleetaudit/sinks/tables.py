"""Parquet and CSV sinks for scans, evaluation, comparison and batch summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.metrics import fixed, format_iso
from ..functions.text import neutralize_formula
from ..operators.history import upsert_scans

SCAN_TABLES = ["apps", "scans", "permissions", "findings"]


def append_scan(base: str, tables: dict[str, DataFrame]) -> None:
    """Append a batch of scans to the four tables, partitioned by `created_date`.

    Rows are rebalanced by date: small dates share a task and write one file,
    and a date that holds much of the data is split over many tasks at run time.
    """
    for name in SCAN_TABLES:
        tables[name].hint("rebalance", "created_date").write.mode("append").partitionBy("created_date").parquet(f"{base}/{name}")


def read_scan_tables(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{base}/{name}") for name in SCAN_TABLES}


def replace_scans(spark: SparkSession, base: str, incoming: DataFrame, scratch: str) -> None:
    """Newest row per scan id over stored and incoming rows, in place.

    Only dates that hold or get one of the incoming scans are read whole and written again; other dates
    keep their files.  The merged dates are stored in `scratch` before any file of the table is replaced, so a run
    that is cut off can be repeated, and a repeated run leaves the same rows.  The touched dates go to the
    driver, which lists a folder for each of them anyway.  A date that loses its last scan stays as an empty folder.
    """
    path = f"{base}/scans"
    stored = spark.read.parquet(path)
    incoming = incoming.withColumn("created_date", F.col("created_date").cast(stored.schema["created_date"].dataType)).select(*stored.columns)
    moved = stored.select("scan_id", "created_date").join(incoming.select("scan_id").distinct(), "scan_id", "left_semi")
    held = {r["created_date"] for r in moved.select("created_date").distinct().collect()}
    gets = {r["created_date"] for r in incoming.select("created_date").distinct().collect()}
    day = F.col("created_date")
    # Null is a date of its own here: rows without one share a folder.
    touched = day.isin(list((held | gets) - {None})) | (day.isNull() & F.lit(None in held | gets))
    upsert_scans(stored.where(touched), incoming).write.mode("overwrite").parquet(scratch)
    merged = spark.read.schema(stored.schema).parquet(scratch)
    merged.hint("rebalance", "created_date").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("created_date").parquet(path)
    left = {r["created_date"] for r in merged.select("created_date").distinct().collect()}
    for date in held - left:
        folder = "__HIVE_DEFAULT_PARTITION__" if date is None else date
        merged.drop("created_date").limit(0).write.mode("overwrite").parquet(f"{path}/created_date={folder}")


BATCH_COLUMNS = [
    "filename", "package", "SHA-256", "analysis timestamp", "risk score", "risk rating",
    "critical count", "high count", "medium count", "low count", "analysis duration",
]


def batch_summary(items: DataFrame) -> DataFrame:
    """Eleven text columns without evidence; counts are blank where there is no result.

    `items` is (filename, package_name, sha256, completed_at, risk_score, risk_rating,
    critical, high, medium, low, duration) with null score and rating for failed items.
    """
    has_result = F.col("risk_score").isNotNull()
    count = lambda c: F.when(has_result, F.coalesce(F.col(c), F.lit(0)).cast("string"))
    seconds = F.concat(fixed(F.coalesce("duration", F.lit(0.0)), 2), F.lit("s"))
    cells = [
        F.col("filename"), F.col("package_name"), F.col("sha256"), format_iso(F.col("completed_at")),
        F.when(has_result, fixed(F.col("risk_score"), 1)), F.col("risk_rating"),
        count("critical"), count("high"), count("medium"), count("low"),
        F.when(has_result | (F.coalesce("duration", F.lit(0.0)) > 0), seconds),
    ]
    return items.select(*[neutralize_formula(c).alias(n) for c, n in zip(cells, BATCH_COLUMNS)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_evaluation(records: DataFrame, totals: DataFrame, rules: DataFrame, base: str) -> None:
    """Per-application records as JSON lines, a flat CSV of them, totals and per-rule metrics."""
    records.write.mode("overwrite").json(f"{base}/apps")
    # The flat table is made of the written rows; the plan of the records runs once.
    stored = records.sparkSession.read.schema(records.schema).json(f"{base}/apps")
    flat = stored.select(*[c for c, t in records.dtypes if not t.startswith(("array", "map", "struct"))])
    write_csv(flat, f"{base}/apps_csv")
    totals.write.mode("overwrite").json(f"{base}/totals")
    rules.write.mode("overwrite").json(f"{base}/rules")


COMPARISON_COLUMNS = [
    "apk_hash", "comparison_tool", "our_findings_count", "external_findings_count", "common_findings_count",
    "unique_our_tool_count", "unique_external_tool_count", "finding_jaccard_similarity",
    "category_jaccard_similarity", "common_categories", "unique_our_categories", "unique_external_categories",
]


def comparison_summary(rows: DataFrame, tools: DataFrame) -> DataFrame:
    """Comparison rows with the tool list; `tools` is a single short string."""
    return rows.withColumn("comparison_tool", tools.limit(1).scalar()).select(*COMPARISON_COLUMNS)
