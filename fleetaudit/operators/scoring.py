"""Explainable risk score per application.

Only the first three occurrences of a rule earn points, so after removing exact
copies the plan keeps at most three rows per (application, rule) - a limit that
Spark applies before the shuffle.  What is left of an application is bounded by
three times the number of rules; the caps then work on these few rows.  Points
are decimals, which makes the half-even roundings exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import literal_case, rating_band
from ..functions.metrics import fixed
from ..functions.text import strip
from ..session import fine, work_dir
from .ordinals import with_ordinal

POINTS = "decimal(18,6)"

DISCLAIMER = (
    "This risk score is a heuristic prioritisation metric and should not be interpreted as CVSS "
    "or proof of exploitation."
)


@dataclass(frozen=True)
class ScoreModel:
    """Default weights, multipliers and caps."""

    severity_weights: dict[str, float] = field(
        default_factory=lambda: {"CRITICAL": 25.0, "HIGH": 15.0, "MEDIUM": 8.0, "LOW": 3.0, "INFO": 0.0}
    )
    confidence_multipliers: dict[str, float] = field(
        default_factory=lambda: {"HIGH": 1.0, "MEDIUM": 0.75, "LOW": 0.5}
    )
    decay: tuple[float, ...] = (1.0, 0.5, 0.25)
    rule_cap: float = 25.0
    low_cap: float = 15.0
    category_cap: float = 35.0


def _dec(x: float, kind: str = POINTS) -> Column:
    return F.lit(Decimal(str(x))).cast(kind)


def duplicate_keys() -> list[Column]:
    return [
        F.col("app_id"),
        F.col("rule_id"),
        F.col("title"),
        strip(F.coalesce("evidence", F.lit(""))).alias("evidence_key"),
        strip(F.coalesce("location", F.lit(""))).alias("location_key"),
    ]


def unique_findings(findings: DataFrame) -> DataFrame:
    """First of each set of exact copies, by discovery order."""
    first = Window.partitionBy(*duplicate_keys()).orderBy("finding_seq")
    return findings.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def duplicate_counts(findings: DataFrame) -> DataFrame:
    """(app_id, findings_evaluated, findings_deduplicated) without moving the rows."""
    copies = findings.groupBy(*duplicate_keys()).agg(F.count("*").alias("copies"))
    return copies.groupBy("app_id").agg(
        F.sum("copies").alias("findings_evaluated"),
        F.sum(F.col("copies") - 1).alias("findings_deduplicated"),
    )


def base_points(model: ScoreModel) -> Column:
    weight = literal_case("severity", {k: Decimal(str(v)) for k, v in model.severity_weights.items()}, Decimal("0"))
    factor = literal_case("confidence", {k: Decimal(str(v)) for k, v in model.confidence_multipliers.items()}, Decimal("1"))
    return (weight.cast("decimal(10,4)") * factor.cast("decimal(6,4)")).cast(POINTS)


def _decay(model: ScoreModel) -> Column:
    table = {i + 1: Decimal(str(d)) for i, d in enumerate(model.decay)}
    return literal_case("occurrence", table, Decimal("0")).cast("decimal(6,4)")


def scored_findings(findings: DataFrame, model: ScoreModel = ScoreModel(), deduplicated: bool = False) -> DataFrame:
    """The findings that can earn points: at most `len(decay)` per rule, after rule and low caps.

    Columns: app_id, finding_seq, rule_id, title, category, severity, confidence, occurrence,
    raw, decay, before_low (points after the rule cap), adjusted, low_total.
    """
    unique = findings if deduplicated else unique_findings(findings)
    per_rule = Window.partitionBy("app_id", "rule_id").orderBy("finding_seq")
    first = (
        unique.select("app_id", "finding_seq", "rule_id", "title", "category", "severity", "confidence")
        .withColumn("occurrence", F.row_number().over(per_rule))
        .where(F.col("occurrence") <= len(model.decay))
    )
    return capped_points(first, model)


def capped_points(first: DataFrame, model: ScoreModel = ScoreModel()) -> DataFrame:
    """Points of the first `len(decay)` findings of each rule, numbered by `occurrence`, after rule and low caps.

    The few rows left of an application are placed once, in small partitions, for all that is done by application.
    """
    first = fine(first, "app_id")
    per_rule = Window.partitionBy("app_id", "rule_id").orderBy("occurrence")
    kept = (
        first.withColumn("raw", base_points(model))
        .withColumn("decay", _decay(model))
        .withColumn("points", (F.col("raw") * F.col("decay")).cast(POINTS))
    )
    running = F.sum("points").over(per_rule.rowsBetween(Window.unboundedPreceding, 0))
    cap = _dec(model.rule_cap, "decimal(28,6)")
    kept = kept.withColumn("cum", running).withColumn(
        "before_low", (F.least(cap, F.col("cum")) - F.least(cap, F.col("cum") - F.col("points"))).cast(POINTS)
    )
    low = F.when(F.col("severity") == "LOW", F.col("before_low"))
    kept = kept.withColumn("low_total", F.coalesce(F.sum(low).over(Window.partitionBy("app_id")), _dec(0)))
    low_cap = _dec(model.low_cap)
    scaled = F.bround(
        (F.col("before_low").cast("double") * (F.lit(float(model.low_cap)) / F.col("low_total").cast("double")))
        .cast("decimal(18,9)"), 2,
    ).cast(POINTS)
    over = (F.col("severity") == "LOW") & (F.col("low_total") > low_cap)
    return kept.withColumn("adjusted", F.when(over, scaled).otherwise(F.col("before_low"))).drop("cum", "points")


def _category_score(model: ScoreModel) -> Column:
    cap = _dec(model.category_cap, "decimal(20,2)")
    return F.when(F.col("category_sum") > cap, cap).otherwise(F.bround("category_sum", 2).cast("decimal(20,2)"))


def category_scores(scored: DataFrame, model: ScoreModel = ScoreModel()) -> DataFrame:
    sums = scored.groupBy("app_id", "category").agg(F.sum("adjusted").alias("category_sum"))
    return sums.withColumn("category_score", _category_score(model))


def rule_contributions(scored: DataFrame) -> DataFrame:
    """Points per rule before the low-severity cap."""
    return scored.groupBy("app_id", "rule_id").agg(F.bround(F.sum("before_low"), 2).alias("contribution"))


def app_scores(findings: DataFrame, apps: DataFrame | None = None, model: ScoreModel = ScoreModel(),
               deduplicated: bool = False) -> DataFrame:
    """(app_id, score, rating); applications without findings score 0.0."""
    per_category = category_scores(scored_findings(findings, model, deduplicated), model)
    total = per_category.groupBy("app_id").agg(F.sum("category_score").alias("total"))
    if apps is not None:
        total = apps.select("app_id").join(total, "app_id", "left")
    bounded = F.least(_dec(100), F.greatest(_dec(0), F.bround(F.coalesce("total", _dec(0)), 1).cast(POINTS)))
    return total.select("app_id", bounded.cast("double").alias("score")).withColumn("rating", rating_band(F.col("score")))


def itemized_breakdown(findings: DataFrame, model: ScoreModel = ScoreModel()) -> DataFrame:
    """One row per unique finding; the rows beyond the decay table carry zero points.

    Occurrences are numbered once and written to the shared folder; the few rows of each rule that can
    earn points go through the caps, the others past them.  Rows without application or rule carry zero points.
    """
    unique = unique_findings(findings)
    numbered = with_ordinal(
        unique.select("app_id", "finding_seq", "rule_id", "title", "category", "severity", "confidence"),
        ["app_id", "rule_id"], "finding_seq", "occurrence",
    )
    spark, folder = findings.sparkSession, work_dir(findings.sparkSession)
    numbered.write.option("compression", "zstd").parquet(folder)
    numbered = spark.read.schema(numbered.schema).parquet(folder)
    earns = F.col("occurrence") <= len(model.decay)
    named = F.col("app_id").isNotNull() & F.col("rule_id").isNotNull()
    scored = capped_points(numbered.where(earns), model).select(
        *numbered.columns, F.when(named, F.col("adjusted")).otherwise(_dec(0)).alias("adjusted"),
    ).unionByName(numbered.where(~earns).withColumn("adjusted", _dec(0)))
    weight = literal_case("severity", dict(model.severity_weights), 0.0)
    factor = literal_case("confidence", dict(model.confidence_multipliers), 1.0)
    table = {i + 1: d for i, d in enumerate(model.decay)}
    return scored.select(
        "app_id", "finding_seq", "rule_id", "title", "category", "severity", "confidence",
        weight.alias("base_weight"),
        factor.alias("confidence_multiplier"),
        F.col("occurrence").alias("occurrence_index"),
        literal_case("occurrence", table, 0.0).alias("decay_factor"),
        base_points(model).cast("double").alias("raw_calculated"),
        F.col("adjusted").cast("double").alias("adjusted_score"),
    )


def score_report(findings: DataFrame, apps: DataFrame | None = None, model: ScoreModel = ScoreModel()) -> DataFrame:
    """Score, rating, per-category and per-rule maps and explanation lines per application.

    Maps and lines are bounded by the number of categories and rules.
    """
    # The scored rows are placed by application, so the three levels of grouping
    # below (rule, category, application) follow each other without a shuffle.
    one = lambda c: fixed(c, 1)
    per_rule = scored_findings(findings, model).groupBy("app_id", "category", "rule_id").agg(
        F.sum("adjusted").alias("adjusted"), F.sum("before_low").alias("before_low"), F.max("low_total").alias("low_total"))
    per_category = per_rule.groupBy("app_id", "category").agg(
        F.sum("adjusted").alias("category_sum"), F.max("low_total").alias("low_total"),
        F.collect_list(F.struct("rule_id", "before_low")).alias("rules"),
    ).withColumn("category_score", _category_score(model))
    cat_line = F.when(F.col("category_sum") > _dec(model.category_cap), F.concat(
        F.lit("Category Cap: Category '"), F.col("category"), F.lit("' sum ("), one(F.col("category_sum")),
        F.lit(f" pts) capped at {model.category_cap:.1f} pts."),
    ))
    per_app = per_category.groupBy("app_id").agg(
        F.sum("category_score").alias("total"), F.max("low_total").alias("low_total"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.struct("category", F.col("category_score").cast("double"))))).alias("category_scores"),
        F.array_sort(F.collect_list(cat_line)).alias("cap_lines"),
        F.flatten(F.collect_list("rules")).alias("rules"),
    )
    points_of = lambda r: F.aggregate(
        F.filter("rules", lambda x: x["rule_id"] == r), F.lit(0).cast("decimal(28,6)"),
        lambda acc, x: (acc + x["before_low"]).cast("decimal(28,6)"))
    contributions = F.map_from_entries(F.transform(
        F.array_sort(F.array_distinct(F.col("rules.rule_id"))),
        lambda r: F.struct(r, F.bround(points_of(r), 2).cast("double"))))
    out = per_app.withColumn("rule_contributions", contributions).join(duplicate_counts(findings), "app_id")
    if apps is not None:
        out = apps.select("app_id").join(out, "app_id", "left")
    score = F.least(_dec(100), F.greatest(_dec(0), F.bround(F.coalesce("total", _dec(0)), 1).cast(POINTS))).cast("double")
    removed, seen = F.col("findings_deduplicated"), F.col("findings_evaluated")
    dup_line = F.when(removed > 0, F.format_string(
        "Deduplication: Filtered %d exact duplicate finding(s) out of %d total.", removed, seen))
    low_line = F.when(F.col("low_total") > _dec(model.low_cap), F.concat(
        F.lit("Low-Severity Cap: Combined Low-severity findings ("), one(F.col("low_total")),
        F.lit(f" pts) capped at maximum {model.low_cap:.1f} pts to prevent inflation.")))
    none = F.array(F.lit(DISCLAIMER), F.lit(
        "No security findings were detected; assigned baseline score of 0.0 (Minimal risk)."))
    out = out.withColumn("score", score).withColumn("rating", rating_band(F.col("score")))
    final_line = F.concat(
        F.lit("Final Aggregation: Category subtotals sum to "), one(F.col("total")),
        F.lit(" pts; normalized score is "), one(F.col("score")), F.lit(" / 100.0 (Rating: "), F.col("rating"), F.lit(")."))
    lines = F.array_compact(F.concat(
        F.array(F.lit(DISCLAIMER), dup_line, low_line), F.col("cap_lines"), F.array(final_line)))
    return out.select(
        "app_id", "score", "rating",
        F.coalesce(seen, F.lit(0)).alias("findings_evaluated"),
        F.coalesce(removed, F.lit(0)).alias("findings_deduplicated"),
        "category_scores", "rule_contributions",
        F.when(F.col("total").isNull(), none).otherwise(lines).alias("explanations"),
    )
