"""Golden scores, a literal loop as brute force, and skewed input."""

import random

import pytest
from pyspark.sql import functions as F

from fleetaudit.operators import findings as fnd, scoring
from fleetaudit.operators.ordinals import with_ordinal
from fleetaudit.schemas import FINDINGS


def rows(*items, app="a"):
    """(rule, severity, confidence, category[, evidence]) tuples to finding rows."""
    out = []
    for i, it in enumerate(items):
        rule, sev, conf, cat = it[:4]
        ev = it[4] if len(it) > 4 else f"e{i}"
        out.append((app, i, rule, "t " + rule, cat, sev, conf, ev, None))
    return out


def score(spark, data, **kw):
    r = scoring.app_scores(spark.createDataFrame(data, FINDINGS), **kw).collect()
    return r[0]["score"], r[0]["rating"]


@pytest.mark.parametrize("items, want", [
    ([("R1", "CRITICAL", "HIGH", "C1")], (25.0, "LOW")),
    ([("R1", "CRITICAL", "HIGH", "C1"), ("R2", "HIGH", "HIGH", "C2"), ("R3", "MEDIUM", "HIGH", "C3")], (48.0, "MEDIUM")),
    ([("R1", "CRITICAL", "MEDIUM", "C1")], (18.8, "MINIMAL")),
    ([("R1", "CRITICAL", "LOW", "C1")], (12.5, "MINIMAL")),
    ([(f"R{i}", "CRITICAL", "HIGH", f"C{i % 7}") for i in range(10)], (100.0, "CRITICAL")),
    ([("R1", "HIGH", "HIGH", "C1", "same")] * 5, (15.0, "MINIMAL")),
])
def test_golden(spark, items, want):
    assert score(spark, rows(*items)) == want


def test_many_low_findings_stay_minimal(spark):
    value, rating = score(spark, rows(*[(f"R{i}", "LOW", "HIGH", "C") for i in range(30)]))
    assert value <= 15.0 and rating == "MINIMAL"


def test_app_without_findings_scores_zero(spark):
    apps = spark.createDataFrame([("a",), ("z",)], "app_id string")
    out = {r["app_id"]: (r["score"], r["rating"]) for r in scoring.app_scores(
        spark.createDataFrame(rows(("R1", "HIGH", "HIGH", "C")), FINDINGS), apps).collect()}
    assert out == {"a": (15.0, "MINIMAL"), "z": (0.0, "MINIMAL")}


def test_duplicates_are_counted(spark):
    got = scoring.duplicate_counts(spark.createDataFrame(rows(*[("R1", "HIGH", "HIGH", "C", " same")] * 5), FINDINGS)).first()
    assert (got["findings_evaluated"], got["findings_deduplicated"]) == (5, 4)


def loop_score(items):
    """The scoring steps as a plain loop."""
    weight = {"CRITICAL": 25.0, "HIGH": 15.0, "MEDIUM": 8.0, "LOW": 3.0, "INFO": 0.0}
    factor = {"HIGH": 1.0, "MEDIUM": 0.75, "LOW": 0.5}
    seen, count, per_rule, kept = set(), {}, {}, []
    for _, _, rule, title, cat, sev, conf, ev, loc in items:
        key = (rule, title, ev.strip(), (loc or "").strip())
        if key in seen:
            continue
        seen.add(key)
        n = count.get(rule, 0)
        count[rule] = n + 1
        add = weight[sev] * factor[conf] * ((1.0, 0.5, 0.25)[n] if n < 3 else 0.0)
        add = min(add, max(0.0, 25.0 - per_rule.get(rule, 0.0)))
        per_rule[rule] = per_rule.get(rule, 0.0) + add
        kept.append([cat, sev, add])
    low = sum(k[2] for k in kept if k[1] == "LOW")
    if low > 15:
        for k in kept:
            if k[1] == "LOW":
                k[2] = round(k[2] * 15 / low, 2)
    cats = {}
    for cat, _, pts in kept:
        cats[cat] = cats.get(cat, 0.0) + pts
    total = sum(35.0 if v > 35 else round(v, 2) for v in cats.values())
    return min(100.0, max(0.0, round(total, 1)))


def test_against_the_loop(spark):
    rnd = random.Random(5)
    data, want = [], {}
    for a in range(60):
        items = [
            (f"app{a}", i, f"R{rnd.randrange(5)}", "t", f"C{rnd.randrange(3)}", rnd.choice(["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]),
             rnd.choice(["HIGH", "MEDIUM", "LOW"]), f"e{rnd.randrange(6)}", rnd.choice([None, "x", " x "]))
            for i in range(rnd.randrange(1, 40))
        ]
        data += items
        want[f"app{a}"] = loop_score(items)
    got = {r["app_id"]: r["score"] for r in scoring.app_scores(spark.createDataFrame(data, FINDINGS)).collect()}
    assert got.keys() == want.keys()
    for app in want:  # floats may sit on the other side of a rounding tie
        assert abs(got[app] - want[app]) <= 0.1 + 1e-9


def hot(spark, n=60_000):
    """One application holds a third of the rows, most of them of one rule."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 500)).alias("app_id"),
        F.col("id").alias("finding_seq"),
        F.when(F.col("id") % 30 == 0, "R2").otherwise("R1").alias("rule_id"),
        F.lit("t").alias("title"), F.lit("C").alias("category"), F.lit("HIGH").alias("severity"), F.lit("HIGH").alias("confidence"),
        F.concat(F.lit("e"), F.col("id")).alias("evidence"), F.lit(None).cast("string").alias("location"))


def test_hot_application_keeps_every_row_and_spreads(spark):
    df = hot(spark)
    ranked = with_ordinal(df, ["app_id"], "finding_seq", "n", parts=16)
    got = ranked.where("app_id = 'hot'").agg(
        F.count("*").alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.countDistinct("n").alias("d")).first()
    assert tuple(got) == (20_000, 1, 20_000, 20_000)
    check = ranked.where("app_id = 'hot'").selectExpr("n", "row_number() OVER (ORDER BY finding_seq) AS want")
    assert check.where("n <> want").count() == 0


def test_scored_rows_of_a_hot_application_are_bounded(spark):
    kept = scoring.scored_findings(hot(spark)).where("app_id = 'hot'").count()
    assert kept == 6  # two rules, three occurrences each


def test_group_limits_run_before_the_shuffle(spark):
    plan = scoring.app_scores(hot(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4


def test_breakdown_lists_every_unique_finding(spark):
    assert scoring.itemized_breakdown(hot(spark)).count() == 60_000


def test_report_numbers(spark):
    got = fnd.report_ordinals(hot(spark)).where("app_id = 'hot'").agg(F.max("finding_no"), F.countDistinct("finding_no")).first()
    assert tuple(got) == (20_000, 20_000)


def test_custom_model(spark):
    model = scoring.ScoreModel(severity_weights={"HIGH": 50.0}, rule_cap=60.0, category_cap=80.0)
    assert score(spark, rows(("R1", "HIGH", "HIGH", "C")), model=model)[0] == 50.0
