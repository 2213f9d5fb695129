"""Operators on the findings table: dedupe, filters, orders, counts, rule report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..catalogs import SEVERITIES
from ..functions.classify import display_category, severity_rank
from .ordinals import with_ordinal
from .rows import side_by_side

# Display categories.
DISPLAY_CATEGORIES = [
    "Secrets", "Network", "Storage", "Cryptography", "Third-Party SDK", "Permissions", "Manifest", "Other",
]


def concatenate(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def deduplicate(findings: DataFrame) -> DataFrame:
    """First finding per (rule, title, evidence, location) of an application, untrimmed."""
    first = Window.partitionBy("app_id", "rule_id", "title", "evidence", "location").orderBy("finding_seq")
    return findings.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def filter_findings(
    findings: DataFrame, severity: str = "ALL", category: str = "All", query: str = "", fields: list[str] | None = None
) -> DataFrame:
    """Severity, display category and substring search, combined."""
    out = findings
    if severity.strip().upper() != "ALL":
        out = out.where(F.upper("severity") == severity.strip().upper())
    if category.strip() not in ("All", "All Categories"):
        out = out.where(display_category(F.col("category")) == category.strip())
    q = query.strip().lower()
    if q:
        wanted = fields or ["title", "rule_id", "description", "evidence", "location", "impact", "remediation"]
        # An absent value reads as the word None, as in the original search box.
        text = [F.coalesce(c, F.lit("None")) for c in wanted if c in out.columns]
        haystack = F.lower(F.concat_ws(" ", *text, display_category(F.col("category"))))
        out = out.where(F.contains(haystack, F.lit(q)))
    return out


# Settings that switch whole categories.
CATEGORY_SWITCHES = {
    "secrets": "HARDCODED_SECRET",
    "network": "NETWORK_INDICATOR",
    "storage": "STORAGE_INSECURITY",
    "crypto": "CRYPTO_FLAW",
    "sdks": "TRACKING_SDK",
    "permissions": "PERMISSION",
    "manifest": "MANIFEST_MISCONFIG",
}


def enabled_findings(
    findings: DataFrame, disabled_rules: list[str] = (), disabled_categories: list[str] = ()
) -> DataFrame:
    off = [CATEGORY_SWITCHES.get(c, c) for c in disabled_categories]
    out = findings
    if disabled_rules:
        out = out.where(~F.col("rule_id").isin(list(disabled_rules)))
    if off:
        out = out.where(~F.col("category").isin(off))
    return out


def severity_counts(findings: DataFrame) -> DataFrame:
    s = F.lower("severity")
    return findings.groupBy("app_id").agg(*[F.count_if(s == t.lower()).alias(t.lower()) for t in SEVERITIES])


def category_counts(findings: DataFrame) -> DataFrame:
    """Counts per display category; categories without findings show zero."""
    counts = findings.agg(*[
        F.count_if(display_category(F.col("category")) == c).alias(c) for c in DISPLAY_CATEGORIES
    ])
    return counts.unpivot([], DISPLAY_CATEGORIES, "display_category", "findings")


def detected_sets(findings: DataFrame) -> DataFrame:
    """Sorted rule and category sets per application; both bounded by the rule list."""
    return findings.groupBy("app_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("detected_rules"),
        F.array_sort(F.collect_set("category")).alias("detected_categories"),
    )


def dataset_totals(findings: DataFrame, scores: DataFrame) -> DataFrame:
    """Findings per severity (INFO is not part of the total) and the mean score."""
    counts = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s.lower()}_findings") for s in SEVERITIES[:4]])
    mean = scores.agg(
        F.coalesce(F.bround(F.avg(F.col("score").cast("decimal(10,4)")).cast("decimal(14,8)"), 2), F.lit(0))
        .cast("double").alias("average_risk_score")
    )
    total = reduce(lambda a, b: a + b, [F.col(f"{s.lower()}_findings") for s in SEVERITIES[:4]])
    return side_by_side(counts.withColumn("total_findings", total), mean)


def rule_report(findings: DataFrame, rules: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per rule: executed, skipped, errored and number of findings.

    `rules` has (rule_id, enabled); `errors` has one row (rule_id) per failed evaluation.
    """
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    out = rules.join(counts, "rule_id", "left")
    failed = F.lit(0)
    if errors is not None:
        out = out.join(errors.groupBy("rule_id").agg(F.count("*").alias("failed")), "rule_id", "left")
        failed = F.coalesce("failed", F.lit(0))
    return out.select(
        "rule_id",
        F.col("enabled").alias("executed"),
        (~F.col("enabled")).alias("skipped"),
        (failed > 0).alias("errored"),
        F.when(F.col("enabled"), F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("findings"),
    )


def rule_report_totals(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count_if("executed").alias("executed_count"),
        F.count_if("skipped").alias("skipped_count"),
        F.count_if("errored").alias("error_count"),
        F.sum("findings").alias("findings_count"),
    )


def top_findings(findings: DataFrame, k: int = 5) -> DataFrame:
    """Worst findings per application: a top-k report."""
    worst = Window.partitionBy("app_id").orderBy(severity_rank(F.col("severity")), "finding_seq")
    return findings.withColumn("position", F.row_number().over(worst)).where(F.col("position") <= k)


def report_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("app_id", severity_rank(F.col("severity")), "rule_id", "finding_seq")


def report_ordinals(findings: DataFrame) -> DataFrame:
    """Number of each finding in its report, by severity rank then rule."""
    rank = severity_rank(F.col("severity"))
    return with_ordinal(findings, ["app_id"], "finding_seq", "finding_no", [rank, F.col("rule_id")])


def rule_occurrences(findings: DataFrame) -> DataFrame:
    return with_ordinal(findings, ["app_id", "rule_id"], "finding_seq", "occurrence")


def rule_dimension(spark: SparkSession, rule_ids: list[str], disabled: list[str] = ()) -> DataFrame:
    """(rule_id, enabled) of the registered rules: a plan-time list."""
    return spark.createDataFrame([(r, r not in disabled) for r in rule_ids], "rule_id string, enabled boolean")
