"""Queries on history, evaluation and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogs import CANONICAL_CATEGORIES
from ..fixtures.views import Fixtures
from ..operators import comparison as cmp, evaluation as ev, findings as fnd, history as h
from ..sources.external import external_findings
from .base import query
from .functions import canonical_sql, name_sql, prf_sql

TEXT = lambda c: F.col(c).cast("string").alias(c)


# --- history --------------------------------------------------------------------------------------

HISTORY = """WITH hist AS (
    SELECT s.scan_id AS id, s.risk_score, s.risk_rating, s.duration, s.analyzer_version, CAST(s.created_at AS STRING) AS created_at,
        a.app_id AS application_id, a.sha256 AS file_hash, a.filename, a.package_name, coalesce(nullif(a.version_name, ''), a.version_code) AS version,
        CAST(a.analyzed_at AS STRING) AS analysis_timestamp, a.app_name,
        coalesce(f.n, 0) AS findings_count, coalesce(p.n, 0) AS permissions_count
    FROM fx_scans s JOIN fx_scan_apps a USING (app_id)
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM fx_scan_findings GROUP BY 1) f ON f.scan_id = s.scan_id
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM fx_scan_permissions GROUP BY 1) p ON p.scan_id = s.scan_id)
    """


def _history(fx: Fixtures):
    return h.history(fx.scans, fx.scan_apps, fx.scan_findings, fx.scan_permissions)


def _shown(df):
    return df.withColumn("created_at", F.col("created_at").cast("string")).withColumn(
        "analysis_timestamp", F.col("analysis_timestamp").cast("string"))


@query("j_8", HISTORY + "SELECT * FROM hist")
def j_8(fx: Fixtures):
    return _shown(_history(fx))


# Content hash of application 3, written out so that both sides filter on a literal.
_HASH_3 = "concat(md5('3'), md5('3s'))"


@query("j_9", HISTORY + f"SELECT * FROM hist WHERE file_hash = {_HASH_3}")
def j_9(fx: Fixtures):
    import hashlib

    digest = hashlib.md5(b"3").hexdigest() + hashlib.md5(b"3s").hexdigest()
    return _shown(h.find_by_hash(fx.scans, fx.scan_apps, fx.scan_findings, fx.scan_permissions, digest))


@query("agg_17", """SELECT s.scan_id, coalesce(f.n, 0) AS findings, coalesce(p.n, 0) AS permissions FROM fx_scans s
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM fx_scan_findings GROUP BY 1) f USING (scan_id)
    LEFT JOIN (SELECT scan_id, count(*) AS n FROM fx_scan_permissions GROUP BY 1) p USING (scan_id)""")
def agg_17(fx: Fixtures):
    out = fx.scans.select("scan_id").join(h.scan_counts(fx.scan_findings, "f"), "scan_id", "left").join(
        h.scan_counts(fx.scan_permissions, "p"), "scan_id", "left")
    return out.select("scan_id", F.coalesce("f", F.lit(0)).alias("findings"), F.coalesce("p", F.lit(0)).alias("permissions"))


@query("ord_1", HISTORY + "SELECT * FROM hist ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def ord_1(fx: Fixtures):
    return _shown(h.history_page(_history(fx), 50, 100))


for _name, _order, _sql in (
    ("ord_2_newest", "Newest First", "created_at DESC"), ("ord_2_oldest", "Oldest First", "created_at"),
    ("ord_2_highest", "Highest Risk", "risk_score DESC"), ("ord_2_lowest", "Lowest Risk", "risk_score"),
):
    query(_name, f"SELECT scan_id AS id, CAST(created_at AS STRING) AS created_at, risk_score FROM fx_scans ORDER BY {_sql}, id")(
        lambda fx, o=_order: h.order_history(fx.scans.select(F.col("scan_id").alias("id"), "created_at", "risk_score"), o)
        .withColumn("created_at", F.col("created_at").cast("string")))


@query("flt_3", HISTORY + """SELECT id, application_id FROM hist WHERE contains(lower(concat_ws(' ', coalesce(nullif(app_name, ''), nullif(filename, ''), ''),
    coalesce(package_name, ''))), 'client 12')""")
def flt_3(fx: Fixtures):
    return h.search_history(_history(fx), "Client 12 ").select("id", "application_id")


@query("w_7", """SELECT sha256, scan_id, app_id FROM fx_scans JOIN fx_scan_apps USING (app_id)
    QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY created_at DESC, scan_id) = 1""")
def w_7(fx: Fixtures):
    return h.newest_per_hash(fx.scans, fx.scan_apps).select("sha256", "scan_id", "app_id")


_GONE = "k % 4 <> 1"


@query("j_13", f"""SELECT 'scans' AS tbl, scan_id AS id, 1 AS n FROM fx_scans WHERE NOT ({_GONE})
    UNION ALL SELECT 'findings', scan_id, count(*) FROM fx_scan_findings WHERE scan_id NOT IN (SELECT scan_id FROM fx_scans WHERE {_GONE}) GROUP BY 2
    UNION ALL SELECT 'permissions', scan_id, count(*) FROM fx_scan_permissions WHERE scan_id NOT IN (SELECT scan_id FROM fx_scans WHERE {_GONE}) GROUP BY 2
    UNION ALL SELECT 'apps', app_id, 1 FROM fx_scan_apps WHERE app_id IN (SELECT app_id FROM fx_scans WHERE NOT ({_GONE}))
        OR app_id NOT IN (SELECT app_id FROM fx_scans)""")
def j_13(fx: Fixtures):
    tables = {"scans": fx.scans, "findings": fx.scan_findings, "permissions": fx.scan_permissions, "apps": fx.scan_apps}
    left = h.delete_scans(tables, fx.scans.where(_GONE).select("scan_id"))
    rows = lambda name, key: left[name].groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "id", "n")
    return fnd.concatenate([rows("scans", "scan_id"), rows("findings", "scan_id"), rows("permissions", "scan_id"), rows("apps", "app_id")])


@query("j_13_clear", "SELECT count(*) AS removed FROM fx_scans")
def j_13_clear(fx: Fixtures):
    return h.clear_history({"scans": fx.scans})[1]


@query("ord_6", "SELECT app_id, filename FROM fx_apps ORDER BY filename, app_id LIMIT 25")
def ord_6(fx: Fixtures):
    return ev.first_apps(fx.apps, 25).select("app_id", "filename")


# --- evaluation -----------------------------------------------------------------------------------

MATCHED = """WITH matched AS (
    SELECT a.app_id, coalesce(t1.gt_key, t2.gt_key, t3.gt_key) AS gt_key, coalesce(t1.expected_rules, t2.expected_rules, t3.expected_rules) AS expected_rules,
        CASE WHEN t1.gt_key IS NOT NULL THEN 0 WHEN t2.gt_key IS NOT NULL THEN 1 ELSE 2 END AS prio
    FROM fx_finding_apps a LEFT JOIN fx_truth t1 ON t1.gt_key = lower(trim(a.filename)) LEFT JOIN fx_truth t2 ON t2.gt_key = lower(trim(a.sha256))
    LEFT JOIN fx_truth t3 ON t3.gt_key = lower(trim(a.package_name)) WHERE coalesce(t1.gt_key, t2.gt_key, t3.gt_key) IS NOT NULL),
    expected AS (SELECT DISTINCT app_id, unnest(expected_rules) AS rule_id FROM matched),
    detected AS (SELECT DISTINCT app_id, rule_id FROM fx_findings WHERE app_id IN (SELECT app_id FROM matched)),
    flags AS (SELECT coalesce(e.app_id, d.app_id) AS app_id, coalesce(e.rule_id, d.rule_id) AS rule_id,
        CAST(e.rule_id IS NOT NULL AND d.rule_id IS NOT NULL AS INTEGER) AS tp, CAST(e.rule_id IS NULL AS INTEGER) AS fp, CAST(d.rule_id IS NULL AS INTEGER) AS fn
        FROM expected e FULL JOIN detected d ON e.app_id = d.app_id AND e.rule_id = d.rule_id)
    """
_COUNTS = "CAST(sum(tp) AS BIGINT) AS true_positives, CAST(sum(fp) AS BIGINT) AS false_positives, CAST(sum(fn) AS BIGINT) AS false_negatives"
_PRF = prf_sql("true_positives", "false_positives", "false_negatives")


def _matched(fx: Fixtures):
    return ev.match_truth(fx.finding_apps, fx.truth)


def _flags(fx: Fixtures):
    return ev.confusion(ev.outcomes(fx.findings, _matched(fx)))


@query("j_10", MATCHED + "SELECT app_id, gt_key, prio FROM matched")
def j_10(fx: Fixtures):
    return _matched(fx).select("app_id", "gt_key", "prio")


@query("j_11", MATCHED + "SELECT * FROM flags")
def j_11(fx: Fixtures):
    return _flags(fx)


APP_METRICS = f"SELECT *, {_PRF} FROM (SELECT app_id, {_COUNTS} FROM flags GROUP BY 1)"


@query("agg_8", MATCHED + APP_METRICS)
def agg_8(fx: Fixtures):
    m = _matched(fx)
    return ev.app_metrics(ev.outcomes(fx.findings, m))


@query("agg_9", MATCHED + f"SELECT *, {_PRF} FROM (SELECT rule_id, {_COUNTS} FROM flags GROUP BY 1)")
def agg_9(fx: Fixtures):
    return ev.rule_metrics(_flags(fx))


@query("agg_10", MATCHED + f"""SELECT true_positives AS total_true_positives, false_positives AS total_false_positives, false_negatives AS total_false_negatives,
    precision AS overall_precision, recall AS overall_recall, f1_score AS overall_f1_score FROM (SELECT *, {_PRF} FROM (SELECT {_COUNTS} FROM flags))""")
def agg_10(fx: Fixtures):
    return ev.overall_metrics(_flags(fx))


_D = "CAST(duration AS DECIMAL(18,6))"


@query("agg_6", f"""SELECT CAST(round_even(CAST(sum({_D}) / count(*) AS DECIMAL(22,10)), 4) AS DOUBLE) AS mean_analysis_time_seconds,
    CAST(round_even(CAST(median({_D}) AS DECIMAL(22,10)), 4) AS DOUBLE) AS median_analysis_time_seconds,
    CAST(min({_D}) AS DOUBLE) AS minimum_analysis_time_seconds, CAST(max({_D}) AS DOUBLE) AS maximum_analysis_time_seconds,
    CAST(sum({_D}) AS DOUBLE) AS total_analysis_time_seconds FROM fx_scans""")
def agg_6(fx: Fixtures):
    return ev.timing_statistics(fx.scans)


@query("agg_18", f"""SELECT stage, CAST(m AS DOUBLE) AS mean_seconds, CAST(round_even(CAST(CAST(m AS DOUBLE) / sum(CAST(m AS DOUBLE)) OVER () * 100 AS DECIMAL(18,10)), 1) AS DOUBLE) AS percent_of_total
    FROM (SELECT status AS stage, round_even(CAST(CAST(sum({_D}) AS DOUBLE) / count(*) AS DECIMAL(18,10)), 4) AS m FROM fx_scans GROUP BY 1)""")
def agg_18(fx: Fixtures):
    return ev.stage_timing(fx.scans, "status", "duration")


@query("agg_14", """SELECT count(*) AS total, count(*) FILTER (status = 'Waiting') AS waiting, count(*) FILTER (status = 'Analyzing') AS analyzing,
    count(*) FILTER (status = 'Complete') AS complete, count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Cancelled') AS cancelled FROM fx_batch""")
def agg_14(fx: Fixtures):
    states = ["Waiting", "Analyzing", "Complete", "Failed", "Cancelled"]
    return fx.batch.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in states])


# --- comparison -----------------------------------------------------------------------------------

SIDES = f"""WITH ours AS (SELECT lower(trim(apk_hash)) AS apk_hash, {canonical_sql('raw_category')} AS finding_category, {name_sql('finding_name')} AS normalized_name FROM fx_ours),
    theirs AS (SELECT lower(trim(apk_hash)) AS apk_hash, tool, {canonical_sql('finding_category')} AS finding_category, {name_sql('finding_name')} AS normalized_name FROM fx_external),
    so AS (SELECT DISTINCT apk_hash, finding_category, normalized_name FROM ours WHERE normalized_name <> ''),
    st AS (SELECT DISTINCT apk_hash, finding_category, normalized_name FROM theirs WHERE normalized_name <> ''),
    sig AS (SELECT coalesce(o.apk_hash, t.apk_hash) AS apk_hash, coalesce(o.finding_category, t.finding_category) AS finding_category,
        coalesce(o.normalized_name, t.normalized_name) AS normalized_name, o.apk_hash IS NOT NULL AS in_ours, t.apk_hash IS NOT NULL AS in_theirs
        FROM so o FULL JOIN st t ON o.apk_hash = t.apk_hash AND o.finding_category = t.finding_category AND o.normalized_name = t.normalized_name),
    hashes AS (SELECT apk_hash FROM ours UNION SELECT apk_hash FROM theirs),
    oc AS (SELECT apk_hash, count(*) AS n, list_sort(list(DISTINCT finding_category)) AS cats FROM ours GROUP BY 1),
    tc AS (SELECT apk_hash, count(*) AS n, list_sort(list(DISTINCT finding_category)) AS cats FROM theirs GROUP BY 1),
    per AS (SELECT h.apk_hash, coalesce(o.n, 0) AS our_n, coalesce(t.n, 0) AS ext_n, coalesce(o.cats, []) AS oc, coalesce(t.cats, []) AS tc
        FROM hashes h LEFT JOIN oc o USING (apk_hash) LEFT JOIN tc t USING (apk_hash))
    """


def sides(fx: Fixtures):
    return cmp.normalize(fx.ours, "apk_hash", "raw_category", "finding_name"), external_findings(fx.external)


@query("j_12", SIDES + "SELECT * FROM sig")
def j_12(fx: Fixtures):
    return cmp.matched_signatures(*sides(fx))


@query("set_1", SIDES + "SELECT * FROM so INTERSECT SELECT * FROM st")
def set_1(fx: Fixtures):
    return cmp.common_signatures(*sides(fx))


@query("set_2", SIDES + """SELECT 'ours' AS side, * FROM (SELECT * FROM so EXCEPT SELECT * FROM st)
    UNION ALL SELECT 'external', * FROM (SELECT * FROM st EXCEPT SELECT * FROM so)""")
def set_2(fx: Fixtures):
    return cmp.only_in_one(*sides(fx))


@query("set_3", SIDES + "SELECT apk_hash FROM hashes")
def set_3(fx: Fixtures):
    return cmp.all_hashes(*sides(fx))


_BOTH = "list_filter(oc, lambda x: list_contains(tc, x))"
_OURS = "list_filter(oc, lambda x: NOT list_contains(tc, x))"
_EXT = "list_filter(tc, lambda x: NOT list_contains(oc, x))"
_CATS = (f"array_to_string({_BOTH}, '; ') AS common_categories, array_to_string({_OURS}, '; ') AS unique_our_categories, "
         f"array_to_string({_EXT}, '; ') AS unique_external_categories")


@query("set_6", SIDES + f"SELECT apk_hash, {_CATS} FROM per")
def set_6(fx: Fixtures):
    s = cmp.category_sets(*sides(fx))
    names = ("common_categories", "unique_our_categories", "unique_external_categories")
    return s.select("apk_hash", *[F.array_join(c, "; ").alias(c) for c in names])


_JAC = lambda a, b, c: f"CASE WHEN {a} + {b} + {c} = 0 THEN 1.0 ELSE round_even({a}::DOUBLE / ({a} + {b} + {c}), 4) END"
COMPARE = f"""SELECT p.apk_hash, our_n AS our_findings_count, ext_n AS external_findings_count, coalesce(s.c, 0) AS common_findings_count,
    coalesce(s.o, 0) AS unique_our_tool_count, coalesce(s.t, 0) AS unique_external_tool_count,
    {_JAC("coalesce(s.c, 0)", "coalesce(s.o, 0)", "coalesce(s.t, 0)")} AS finding_jaccard_similarity,
    {_JAC(f"len({_BOTH})", f"len({_OURS})", f"len({_EXT})")} AS category_jaccard_similarity, {_CATS}
    FROM per p LEFT JOIN (SELECT apk_hash, count(*) FILTER (in_ours AND in_theirs) AS c, count(*) FILTER (in_ours AND NOT in_theirs) AS o,
        count(*) FILTER (NOT in_ours AND in_theirs) AS t FROM sig GROUP BY 1) s USING (apk_hash)"""


@query("agg_11", SIDES + COMPARE)
def agg_11(fx: Fixtures):
    return cmp.comparison_rows(*sides(fx))


@query("agg_11_samples", SIDES + """SELECT apk_hash, side, string_agg(label, '; ' ORDER BY label) AS sample FROM (
    SELECT apk_hash, CASE WHEN in_ours AND in_theirs THEN 'common' WHEN in_ours THEN 'ours' ELSE 'external' END AS side, finding_category || ':' || normalized_name AS label
    FROM sig QUALIFY row_number() OVER (PARTITION BY apk_hash, side ORDER BY label) <= 5) GROUP BY 1, 2""")
def agg_11_samples(fx: Fixtures):
    return cmp.comparison_samples(*sides(fx))


@query("agg_12", SIDES + f"""SELECT c.finding_category, count(*) FILTER (list_contains(oc, c.finding_category) AND list_contains(tc, c.finding_category)) AS both,
    count(*) FILTER (list_contains(oc, c.finding_category) AND NOT list_contains(tc, c.finding_category)) AS our_tool_only,
    count(*) FILTER (NOT list_contains(oc, c.finding_category) AND list_contains(tc, c.finding_category)) AS external_tool_only
    FROM (VALUES {", ".join(f"('{x}')" for x in CANONICAL_CATEGORIES)}) c(finding_category), per GROUP BY 1""")
def agg_12(fx: Fixtures):
    return cmp.category_overlap(*sides(fx))


@query("agg_13", SIDES + f"""SELECT count(*) AS total_apks_evaluated, CAST(sum(our_findings_count) AS BIGINT) AS our_tool_total_findings,
    CAST(sum(external_findings_count) AS BIGINT) AS external_tool_total_findings, CAST(sum(common_findings_count) AS BIGINT) AS overall_common_findings,
    CAST(sum(unique_our_tool_count) AS BIGINT) AS overall_unique_our_tool, CAST(sum(unique_external_tool_count) AS BIGINT) AS overall_unique_external_tool,
    (SELECT string_agg(DISTINCT tool, ', ' ORDER BY tool) FROM theirs) AS comparison_tool FROM ({COMPARE})""")
def agg_13(fx: Fixtures):
    return cmp.comparison_totals(*sides(fx))
