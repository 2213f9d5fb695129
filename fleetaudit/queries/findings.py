"""Queries on findings: score, windows, dedupe, counts, orders, filters, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures.views import FX_RULES, Fixtures
from ..functions.classify import severity_rank
from ..operators import findings as ops, scoring
from ..operators.rules import registry
from ..session import work_dir
from .base import WS, query

_TRIM = f"trim(coalesce({{}}, ''), {WS})"
_EV, _LOC = _TRIM.format("evidence"), _TRIM.format("location")
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END"
_BAND = "CASE WHEN {0} >= 80 THEN 'CRITICAL' WHEN {0} >= 60 THEN 'HIGH' WHEN {0} >= 40 THEN 'MEDIUM' WHEN {0} >= 20 THEN 'LOW' ELSE 'MINIMAL' END"
_DISPLAY = """CASE WHEN contains(c, 'SECRET') THEN 'Secrets' WHEN contains(c, 'NET') THEN 'Network' WHEN contains(c, 'STOR') THEN 'Storage'
    WHEN contains(c, 'CRYPTO') THEN 'Cryptography' WHEN contains(c, 'SDK') THEN 'Third-Party SDK'
    WHEN contains(c, 'PERM') THEN 'Permissions' WHEN contains(c, 'MANIFEST') THEN 'Manifest' ELSE 'Other' END"""
_DISPLAY_OF = _DISPLAY.replace("(c,", "(replace(upper(category), ' ', '_'),")


def score_ctes(weights=(25, 15, 8, 3, 0), mult=("1", "0.75", "0.5"), low_cap=15, cat_cap=35) -> str:
    """The score step by step in SQL, up to per-category sums."""
    return f"""WITH uniq AS (
        SELECT *, row_number() OVER (PARTITION BY app_id, rule_id, title, {_EV}, {_LOC} ORDER BY finding_seq) AS dup
        FROM fx_findings),
    base AS (
        SELECT *, CAST(CASE severity WHEN 'CRITICAL' THEN {weights[0]} WHEN 'HIGH' THEN {weights[1]} WHEN 'MEDIUM' THEN {weights[2]}
                WHEN 'LOW' THEN {weights[3]} ELSE {weights[4]} END AS DECIMAL(10,4)) * CAST(CASE confidence WHEN 'HIGH' THEN {mult[0]}
                WHEN 'MEDIUM' THEN {mult[1]} WHEN 'LOW' THEN {mult[2]} ELSE 1 END AS DECIMAL(6,4)) AS raw,
            row_number() OVER (PARTITION BY app_id, rule_id ORDER BY finding_seq) AS occ
        FROM uniq WHERE dup = 1),
    decayed AS (
        SELECT *, CAST(raw * CAST(CASE occ WHEN 1 THEN 1 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0 END AS DECIMAL(6,4)) AS DECIMAL(18,6)) AS pts FROM base),
    running AS (
        SELECT *, sum(pts) OVER (PARTITION BY app_id, rule_id ORDER BY finding_seq ROWS UNBOUNDED PRECEDING) AS cum FROM decayed),
    capped AS (
        SELECT *, CAST(least(25, cum) - least(25, cum - pts) AS DECIMAL(18,6)) AS before_low FROM running),
    lows AS (
        SELECT *, coalesce(sum(CASE WHEN severity = 'LOW' THEN before_low END) OVER (PARTITION BY app_id), 0) AS low_total FROM capped),
    adj AS (
        SELECT *, CASE WHEN severity = 'LOW' AND low_total > {low_cap}
            THEN CAST(round_even(CAST(CAST(before_low AS DOUBLE) * (CAST({low_cap} AS DOUBLE) / CAST(low_total AS DOUBLE)) AS DECIMAL(18,9)), 2) AS DECIMAL(18,6))
            ELSE before_low END AS adjusted FROM lows),
    cats AS (
        SELECT app_id, category, sum(adjusted) AS category_sum,
            CASE WHEN sum(adjusted) > {cat_cap} THEN CAST({cat_cap} AS DECIMAL(20,2)) ELSE CAST(round_even(sum(adjusted), 2) AS DECIMAL(20,2)) END AS category_score
        FROM adj GROUP BY app_id, category),
    totals AS (
        SELECT app_id, CAST(least(100, greatest(0, round_even(sum(category_score), 1))) AS DOUBLE) AS score, sum(category_score) AS total
        FROM cats GROUP BY app_id)
    """


SCORE = score_ctes()
SCORE_ALL = SCORE + f"""
    SELECT a.app_id, coalesce(t.score, 0.0) AS score, {_BAND.format("coalesce(t.score, 0.0)")} AS rating
    FROM (SELECT app_id FROM fx_finding_apps UNION SELECT app_id FROM fx_apps) a LEFT JOIN totals t USING (app_id)"""


def all_apps(fx: Fixtures):
    return fx.finding_apps.select("app_id").union(fx.apps.select("app_id")).distinct()


@query("sco_7", SCORE_ALL)
def fleet_scores(fx: Fixtures):
    return scoring.app_scores(fx.findings, all_apps(fx))


@query("sco_1", f"""
    SELECT app_id, CAST(sum(n) AS BIGINT) AS findings_evaluated, CAST(sum(n - 1) AS BIGINT) AS findings_deduplicated
    FROM (SELECT app_id, count(*) AS n FROM fx_findings GROUP BY app_id, rule_id, title, {_EV}, {_LOC}) GROUP BY app_id""")
def sco_1(fx: Fixtures):
    return scoring.duplicate_counts(fx.findings)


@query("sco_2", SCORE + "SELECT app_id, finding_seq, rule_id, CAST(raw AS DOUBLE) AS raw FROM base")
def sco_2(fx: Fixtures):
    raw = scoring.base_points(scoring.ScoreModel()).cast("double").alias("raw")
    return scoring.unique_findings(fx.findings).select("app_id", "finding_seq", "rule_id", raw)


@query("sco_3", SCORE + """SELECT app_id, finding_seq, CAST(occ AS INTEGER) AS occurrence, CAST(pts AS DOUBLE) AS points
    FROM decayed WHERE occ <= 3""")
def sco_3(fx: Fixtures):
    s = scoring.scored_findings(fx.findings)
    points = (F.col("raw") * F.col("decay")).cast(scoring.POINTS).cast("double")
    return s.select("app_id", "finding_seq", "occurrence", points.alias("points"))


@query("sco_4", SCORE + """SELECT app_id, rule_id, CAST(sum(before_low) AS DOUBLE) AS rule_points FROM capped GROUP BY app_id, rule_id""")
def sco_4(fx: Fixtures):
    s = scoring.scored_findings(fx.findings)
    return s.groupBy("app_id", "rule_id").agg(F.sum("before_low").cast("double").alias("rule_points"))


@query("sco_5", SCORE + """SELECT app_id, finding_seq, CAST(low_total AS DOUBLE) AS low_total, CAST(adjusted AS DOUBLE) AS adjusted
    FROM adj WHERE severity = 'LOW' AND occ <= 3""")
def sco_5(fx: Fixtures):
    s = scoring.scored_findings(fx.findings).where("severity = 'LOW'")
    return s.select("app_id", "finding_seq", F.col("low_total").cast("double").alias("low_total"),
                    F.col("adjusted").cast("double").alias("adjusted"))


@query("sco_6", SCORE + "SELECT app_id, category, CAST(category_score AS DOUBLE) AS category_score FROM cats")
def sco_6(fx: Fixtures):
    c = scoring.category_scores(scoring.scored_findings(fx.findings))
    return c.select("app_id", "category", F.col("category_score").cast("double").alias("category_score"))


@query("sco_8", SCORE + """SELECT app_id, finding_seq, rule_id, severity, confidence, CAST(occ AS BIGINT) AS occurrence_index,
    CAST(CASE occ WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.25 ELSE 0.0 END AS DOUBLE) AS decay_factor,
    CAST(raw AS DOUBLE) AS raw_calculated, CAST(adjusted AS DOUBLE) AS adjusted_score FROM adj""")
def sco_8(fx: Fixtures):
    return scoring.itemized_breakdown(fx.findings).drop("title", "category", "base_weight", "confidence_multiplier")


@query("sco_9", SCORE + f"""SELECT t.app_id, t.score, {_BAND.format("t.score")} AS rating,
        (SELECT count(*) FROM cats c WHERE c.app_id = t.app_id AND category_sum > 35) AS capped_categories,
        coalesce((SELECT any_value(true) FROM adj l WHERE l.app_id = t.app_id AND low_total > 15), false) AS low_capped,
        'Final Aggregation: Category subtotals sum to ' || printf('%.1f', CAST(round_even(total, 1) AS DOUBLE)) || ' pts; normalized score is '
        || printf('%.1f', t.score) || ' / 100.0 (Rating: ' || {_BAND.format("t.score")} || ').' AS final_line
    FROM totals t""")
def sco_9(fx: Fixtures):
    r = scoring.score_report(fx.findings)
    starts = lambda p: F.size(F.filter("explanations", lambda e: F.startswith(e, F.lit(p))))
    return r.select(
        "app_id", "score", "rating", starts("Category Cap:").cast("bigint").alias("capped_categories"),
        (starts("Low-Severity Cap:") > 0).alias("low_capped"),
        F.element_at("explanations", -1).alias("final_line"),
    )


_CUSTOM = scoring.ScoreModel(
    severity_weights={"CRITICAL": 40.0, "HIGH": 20.0, "MEDIUM": 10.0, "LOW": 5.0, "INFO": 1.0},
    confidence_multipliers={"HIGH": 1.0, "MEDIUM": 0.8, "LOW": 0.4}, category_cap=50.0, low_cap=10.0)


@query("sco_10", score_ctes((40, 20, 10, 5, 1), ("1", "0.8", "0.4"), 10, 50)
       + f"SELECT app_id, score, {_BAND.format('score')} AS rating FROM totals")
def sco_10(fx: Fixtures):
    return scoring.app_scores(fx.findings, model=_CUSTOM)


@query("agg_16", SCORE + """SELECT app_id, string_agg(rule_id || '=' || printf('%.2f', c), ';' ORDER BY rule_id) AS contributions FROM (
    SELECT app_id, rule_id, CAST(round_even(sum(before_low), 2) AS DOUBLE) AS c FROM capped GROUP BY app_id, rule_id) GROUP BY app_id""")
def agg_16(fx: Fixtures):
    pairs = F.transform(F.map_entries("rule_contributions"),
                        lambda e: F.concat(e.key, F.lit("="), F.format_string("%.2f", e.value)))
    return scoring.score_report(fx.findings).select("app_id", F.array_join(pairs, ";").alias("contributions"))


@query("w_2", """SELECT app_id, finding_seq, rule_id, row_number() OVER (PARTITION BY app_id, rule_id ORDER BY finding_seq) AS occurrence
    FROM fx_findings""")
def w_2(fx: Fixtures):
    return ops.rule_occurrences(fx.findings.select("app_id", "finding_seq", "rule_id"))


@query("w_3", SCORE + "SELECT app_id, finding_seq, CAST(before_low AS DOUBLE) AS clamped FROM capped WHERE occ <= 3")
def w_3(fx: Fixtures):
    s = scoring.scored_findings(fx.findings)
    return s.select("app_id", "finding_seq", F.col("before_low").cast("double").alias("clamped"))


@query("w_4", SCORE + "SELECT DISTINCT app_id, CAST(low_total AS DOUBLE) AS low_total FROM lows")
def w_4(fx: Fixtures):
    s = scoring.scored_findings(fx.findings)
    return s.groupBy("app_id").agg(F.max("low_total").cast("double").alias("low_total"))


@query("w_6", f"""SELECT app_id, finding_seq, row_number() OVER (PARTITION BY app_id ORDER BY {_RANK}, rule_id, finding_seq) AS finding_no
    FROM fx_findings""")
def w_6(fx: Fixtures):
    # Sorted rows are written with all their columns, so only what is needed goes in.
    keys = fx.findings.select("app_id", "severity", "rule_id", "finding_seq")
    return ops.report_ordinals(keys).select("app_id", "finding_seq", "finding_no")


@query("set_5", """SELECT app_id, rule_id, title, evidence, location, min(finding_seq) AS finding_seq
    FROM fx_findings GROUP BY app_id, rule_id, title, evidence, location""")
def set_5(fx: Fixtures):
    return ops.deduplicate(fx.findings).select("app_id", "rule_id", "title", "evidence", "location", "finding_seq")


@query("agg_1", """SELECT app_id, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
    count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info
    FROM fx_findings GROUP BY app_id""")
def agg_1(fx: Fixtures):
    return ops.severity_counts(fx.findings)


@query("agg_2", f"""SELECT d.display_category, count(f.app_id) AS findings
    FROM (VALUES ('Secrets'), ('Network'), ('Storage'), ('Cryptography'), ('Third-Party SDK'), ('Permissions'), ('Manifest'), ('Other')) d(display_category)
    LEFT JOIN (SELECT app_id, {_DISPLAY_OF} AS dc FROM fx_findings) f ON f.dc = d.display_category GROUP BY 1""")
def agg_2(fx: Fixtures):
    return ops.category_counts(fx.findings)


@query("agg_5", """SELECT app_id, string_agg(DISTINCT rule_id, ';' ORDER BY rule_id) AS detected_rules,
    string_agg(DISTINCT category, ';' ORDER BY category) AS detected_categories FROM fx_findings GROUP BY app_id""")
def agg_5(fx: Fixtures):
    d = ops.detected_sets(fx.findings)
    return d.select("app_id", *[F.array_join(c, ";").alias(c) for c in ("detected_rules", "detected_categories")])


@query("agg_7", SCORE + """SELECT count(*) FILTER (severity = 'CRITICAL') AS critical_findings, count(*) FILTER (severity = 'HIGH') AS high_findings,
    count(*) FILTER (severity = 'MEDIUM') AS medium_findings, count(*) FILTER (severity = 'LOW') AS low_findings,
    count(*) FILTER (severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW')) AS total_findings,
    (SELECT CAST(round_even(CAST(avg(score) AS DECIMAL(14,8)), 2) AS DOUBLE) FROM totals) AS average_risk_score FROM fx_findings""")
def agg_7(fx: Fixtures):
    return ops.dataset_totals(fx.findings, scoring.app_scores(fx.findings))


_IDS = [r[0] for r in FX_RULES] + ["MAN-002", "NET-005"]
_DISABLED = ["NET-008", "CRY-002"]


def _marked(app_id: str, location: str, text: str):
    if location == "key.pem":
        raise ValueError("cannot read " + location)
    if "setSeed" in text:
        yield {"evidence": "marker found"}


@query("agg_15", f"""SELECT r.rule_id, r.rule_id NOT IN ('NET-008', 'CRY-002') AS executed, r.rule_id IN ('NET-008', 'CRY-002') AS skipped,
    false AS errored, CASE WHEN r.rule_id IN ('NET-008', 'CRY-002') THEN 0 ELSE count(f.app_id) END AS findings
    FROM (VALUES {", ".join(f"('{i}')" for i in _IDS)}) r(rule_id) LEFT JOIN fx_findings f USING (rule_id) GROUP BY 1
    UNION ALL SELECT 'USR-003', true, false, count(*) FILTER (location = 'key.pem') > 0, count(*) FILTER (contains(text, 'setSeed')
        AND app_id NOT IN (SELECT app_id FROM fx_artifacts WHERE location = 'key.pem')) FROM fx_artifacts""")
def agg_15(fx: Fixtures):
    """The rules of the fixture and a user rule, evaluated here, that fails on some applications."""
    rules = registry.RuleRegistry(builtin=False)
    rules.register(registry.Rule("USR-003", "Marker", "OTHER", evaluate=_marked))
    inputs = registry.Inputs(artifacts=fx.artifacts())
    rows = rules.user_rows(inputs, work_dir(fx.spark))
    found = fx.findings.select("rule_id").unionByName(rules.run(inputs, user_rows=rows).select("rule_id"))
    return ops.rule_report(found, ops.rule_dimension(fx.spark, [*_IDS, "USR-003"], _DISABLED), rules.errors(rows))


@query("ord_3", f"""SELECT app_id, finding_seq, rule_id, severity, CAST(row_number() OVER (PARTITION BY app_id ORDER BY {_RANK}, finding_seq) AS INTEGER) AS position
    FROM fx_findings QUALIFY position <= 5""")
def ord_3(fx: Fixtures):
    return ops.top_findings(fx.findings).select("app_id", "finding_seq", "rule_id", "severity", "position")


@query("ord_4", f"""SELECT app_id, finding_seq, rule_id, severity, {_RANK} AS severity_rank FROM fx_findings ORDER BY app_id, {_RANK}, rule_id, finding_seq""")
def ord_4(fx: Fixtures):
    return ops.report_order(fx.findings).select(
        "app_id", "finding_seq", "rule_id", "severity", severity_rank(F.col("severity")).alias("severity_rank"))


@query("flt_1", f"""SELECT app_id, finding_seq, rule_id, title FROM fx_findings WHERE severity = 'HIGH' AND {_DISPLAY_OF} = 'Storage'
    AND contains(lower(concat_ws(' ', title, rule_id, evidence, coalesce(location, 'None'), 'Storage')), 'f1.java')""")
def flt_1(fx: Fixtures):
    return ops.filter_findings(fx.findings, "High", "Storage", " F1.java").select("app_id", "finding_seq", "rule_id", "title")


@query("flt_4", """SELECT app_id, rule_id, count(*) AS findings FROM fx_findings
    WHERE rule_id NOT IN ('NET-001') AND category NOT IN ('CRYPTO_FLAW', 'PERMISSION') GROUP BY 1, 2""")
def flt_4(fx: Fixtures):
    from ..operators.rules.registry import RuleRegistry

    registry = RuleRegistry()
    registry.disable("NET-001")
    kept = ops.enabled_findings(
        fx.findings.where(F.col("rule_id").isin([r.rule_id for r in registry.enabled()])), [], ["crypto", "permissions"])
    return kept.groupBy("app_id", "rule_id").agg(F.count("*").alias("findings"))


@query("ext_5", """SELECT rule_id, category, count(*) AS findings FROM fx_findings WHERE category IN
    ('MANIFEST_MISCONFIG', 'HARDCODED_SECRET', 'NETWORK_INDICATOR', 'STORAGE_INSECURITY', 'CRYPTO_FLAW', 'TRACKING_SDK') GROUP BY 1, 2""")
def ext_5(fx: Fixtures):
    from ..operators.rules.registry import RuleRegistry

    kept = fx.findings.where(F.col("rule_id").isin([r.rule_id for r in RuleRegistry().routed(by_stage=True)]))
    return kept.groupBy("rule_id", "category").agg(F.count("*").alias("findings"))


@query("set_4", """SELECT source, category, count(*) AS findings FROM (
    SELECT severity AS source, category FROM fx_findings UNION ALL
    SELECT 'scan', category FROM fx_scan_findings) GROUP BY 1, 2""")
def set_4(fx: Fixtures):
    """Six streams of findings, one for each stage of a scan."""
    tag = lambda df, s: df.select("category").withColumn("source", F.lit(s))
    parts = [tag(fx.findings.where(F.col("severity") == s), s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]
    parts.append(tag(fx.scan_findings, "scan"))
    return ops.concatenate(parts).groupBy("source", "category").agg(F.count("*").alias("findings"))

