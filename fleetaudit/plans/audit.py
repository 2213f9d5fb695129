"""End-to-end audit of a fleet: tables in, findings and scores out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import findings as fnd, permissions as prm, scoring
from ..operators.rules.registry import Inputs, RuleRegistry


def audit_findings(inputs: Inputs, registry: RuleRegistry | None = None, by_stage: bool = False) -> DataFrame:
    """All findings of all applications, first of each equal set.

    One scan of the text, one of each small table; the only shuffles move findings.
    """
    return fnd.deduplicate((registry or RuleRegistry()).run(inputs, by_stage))


def audit_scores(findings: DataFrame, apps: DataFrame, model: scoring.ScoreModel = scoring.ScoreModel()) -> DataFrame:
    return scoring.app_scores(findings, apps, model)


def audit_summary(findings: DataFrame, apps: DataFrame, permissions: DataFrame) -> DataFrame:
    """One row per application: score, rating, severity counts and permission counts.

    Give `findings` as a written table: it is read twice here, and recomputing
    the text scan for each reader would double the work.
    """
    scores = audit_scores(findings, apps)
    severity = fnd.severity_counts(findings)
    perms = prm.permission_summary(prm.classify_permissions(permissions))
    out = scores.join(severity, "app_id", "left").join(perms, "app_id", "left")
    counts = ["critical", "high", "medium", "low", "info", "total_permissions", "dangerous_permissions"]
    return out.select(
        "app_id", "score", "rating", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], "sensitive_families")
