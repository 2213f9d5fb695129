"""Detection quality against ground truth, timing statistics and stage timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import metrics as M
from ..functions.text import strip


def match_truth(apps: DataFrame, truth: DataFrame) -> DataFrame:
    """(app_id, gt_key, prio, expected_rules): truth entry by filename, else content hash, else package.

    Each application offers the keys it has in order of precedence; one equi-join finds
    the entries and the best offer wins, so neither side has to be small.
    """
    norm = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    offers = apps.select(
        "app_id", F.posexplode(F.array(norm("filename"), norm("sha256"), norm("package_name"))).alias("prio", "gt_key")
    ).where("gt_key <> ''")
    best = F.min_by(F.struct("gt_key", "prio", "expected_rules"), "prio").alias("best")
    return offers.join(truth.select("gt_key", "expected_rules"), "gt_key").groupBy("app_id").agg(best).select("app_id", "best.*")


def outcomes(detected: DataFrame, matched: DataFrame) -> DataFrame:
    """(app_id, expected, found): sets of rules of each application with a truth entry.

    Detected rules are combined before they move; a set is bounded by the rule list.
    """
    none = F.array().cast("array<string>")
    found = detected.groupBy("app_id").agg(F.collect_set("rule_id").alias("found"))
    return matched.select("app_id", F.array_distinct(F.coalesce("expected_rules", none)).alias("expected")).join(
        found, "app_id", "left").select("app_id", "expected", F.coalesce("found", none).alias("found"))


def confusion(sets: DataFrame) -> DataFrame:
    """(app_id, rule_id, tp, fp, fn) over the rules that are expected or found."""
    e, d = F.array_contains("expected", F.col("rule_id")), F.array_contains("found", F.col("rule_id"))
    return sets.select("app_id", "expected", "found", F.explode(F.array_union("expected", "found")).alias("rule_id")).select(
        "app_id", "rule_id",
        (e & d).cast("int").alias("tp"), (~e & d).cast("int").alias("fp"), (e & ~d).cast("int").alias("fn"),
    )


def _with_metrics(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return counts.select(
        "*",
        M.precision(tp, fp).alias("precision"),
        M.recall(tp, fn).alias("recall"),
        M.f1_score(tp, fp, fn).alias("f1_score"),
    )


def _sums() -> list[Column]:
    return [
        F.sum("tp").alias("true_positives"),
        F.sum("fp").alias("false_positives"),
        F.sum("fn").alias("false_negatives"),
    ]


def app_metrics(sets: DataFrame) -> DataFrame:
    """Counts and metrics per matched application, also where nothing was expected or found."""
    size = lambda c, name: F.size(c).cast("bigint").alias(name)
    return _with_metrics(sets.select(
        "app_id", size(F.array_intersect("expected", "found"), "true_positives"),
        size(F.array_except("found", "expected"), "false_positives"),
        size(F.array_except("expected", "found"), "false_negatives")))


def rule_metrics(flags: DataFrame) -> DataFrame:
    return _with_metrics(flags.groupBy("rule_id").agg(*_sums()))


def overall_metrics(flags: DataFrame) -> DataFrame:
    """One row; every value is null when no counted pair exists."""
    out = _with_metrics(flags.agg(*_sums()))
    any_pair = F.col("true_positives") + F.col("false_positives") + F.col("false_negatives") > 0
    names = {"precision": "overall_precision", "recall": "overall_recall", "f1_score": "overall_f1_score"}
    return out.select(*[F.when(any_pair, F.col(c)).alias(names.get(c, f"total_{c}")) for c in out.columns])


def timing_statistics(scans: DataFrame, column: str = "duration") -> DataFrame:
    """Mean, median, minimum, maximum and total; nulls and 0.0 when there are no rows.

    All come from one scan: values are counted before they meet.
    """
    counts = scans.select(F.col(column).cast("decimal(18,6)").alias("d")).where("d IS NOT NULL").groupBy("d").agg(F.count("*").alias("n"))
    total = F.sum((F.col("d") * F.col("n")).cast("decimal(28,6)"))
    r = lambda c: F.bround(c, 4).cast("double")
    return counts.agg(
        r((total / F.sum("n")).cast("decimal(22,10)")).alias("mean_analysis_time_seconds"),
        r(F.expr("percentile(d, 0.5, n)").cast("decimal(22,10)")).alias("median_analysis_time_seconds"),
        r(F.min("d")).alias("minimum_analysis_time_seconds"),
        r(F.max("d")).alias("maximum_analysis_time_seconds"),
        r(F.coalesce(total, F.lit(0))).alias("total_analysis_time_seconds"),
    )


def stage_timing(runs: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Mean seconds per stage and its share of the sum of the means."""
    means = runs.groupBy(F.col(stage).alias("stage")).agg(
        F.bround(F.avg(F.col(seconds).cast("decimal(18,6)")), 4).alias("mean_seconds")
    )
    total = F.sum("mean_seconds").over(Window.partitionBy())
    share = F.when(total > 0, F.bround(F.col("mean_seconds") / total * 100, 1)).otherwise(F.lit(0))
    return means.select("stage", F.col("mean_seconds").cast("double"), share.cast("double").alias("percent_of_total"))


def evaluation_records(
    scans: DataFrame, detected: DataFrame, severity: DataFrame, permissions: DataFrame, metrics: DataFrame
) -> DataFrame:
    """Result table of an evaluation run: one row per application.

    Inputs are already aggregated per application: scans (app data, score, status),
    detected rule sets, severity counts, permission counts and confusion metrics.
    """
    return (
        scans.join(detected, "app_id", "left")
        .join(severity, "app_id", "left")
        .join(permissions, "app_id", "left")
        .join(metrics, "app_id", "left")
    )


def first_apps(apps: DataFrame, k: int) -> DataFrame:
    """First k applications by file name."""
    return apps.orderBy("filename", "app_id").limit(k) if k and k > 0 else apps.orderBy("filename", "app_id")
