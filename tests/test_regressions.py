"""Inputs that once gave wrong results or ended an executor."""

import gzip
import time

import pytest
from pyspark.sql import Window, functions as F

from fleetaudit.catalogs import CATEGORY_PATTERNS
from fleetaudit.fixtures import views
from fleetaudit.functions.classify import _at_word, canonical_category
from fleetaudit.functions.text import normalize_name
from fleetaudit.operators import admission, comparison, evaluation, history, scoring
from fleetaudit.operators.ordinals import with_ordinal
from fleetaudit.operators.rules import patterns as P, registry as reg, text_scan
from fleetaudit.operators.rules.catalog import pack_seq
from fleetaudit.queries import QUERIES, streams, tables
from fleetaudit.session import FINE_PER_CORE
from fleetaudit.sinks import reports, tables as sink
from fleetaudit.sources import archives, external, targets
from fleetaudit.streaming import incremental as inc

ART = "app_id string, target_seq bigint, location string, text string"


@pytest.fixture
def no_broadcast(spark):
    """Joins as of large tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def scan(spark, rows, rules=None, **kw):
    return text_scan.text_findings(spark.createDataFrame(rows, ART), rules, **kw)


def test_two_domains_in_one_url_are_two_places(spark):
    found = scan(spark, [("a", 0, "F.java", "x https://adjust.com/mixpanel.com/p y https://graph.facebook.com/tr")], ["NET-007"])
    rows = found.collect()
    assert len(rows) >= 3 and len({r["finding_seq"] for r in rows}) == len(rows)
    assert scoring.itemized_breakdown(found).count() == len(rows)


def test_equal_findings_do_not_multiply(spark):
    rows = [("a", 7, "R", t, "C", "HIGH", "HIGH", t, "l") for t in ("x", "y", "z")]
    findings = spark.createDataFrame(
        rows, "app_id string, finding_seq bigint, rule_id string, title string, category string, severity string, "
        "confidence string, evidence string, location string")
    assert scoring.itemized_breakdown(findings).count() == 3


@pytest.mark.parametrize("n", [2, 10_001, 25_000])
@pytest.mark.parametrize("mark, hit, rule, expect", [
    ("EncryptedSharedPreferences", 'editor.putString("auth_token"', "STO-003", 0),
    ("net.sqlcipher", "CREATE TABLE u (id INT, password TEXT)", "STO-004", 0),
    ("SecureRandom", "x.setSeed(42)", "CRY-006", 1),
])
def test_a_pool_is_one_target_at_any_size(spark, n, mark, hit, rule, expect):
    strings = spark.range(n).select(
        F.lit("a").alias("app_id"), F.col("id").alias("string_seq"),
        F.when(F.col("id") == 0, mark).when(F.col("id") == n - 1, hit).otherwise(F.concat(F.lit("filler"), "id")).alias("string"))
    assert text_scan.text_findings(targets.pool_targets(strings), [rule]).count() == expect


def test_two_dex_files_are_one_pool(spark, tmp_path):
    import zipfile
    with zipfile.ZipFile(tmp_path / "a.apk", "w") as z:
        z.writestr("classes.dex", b"\0EncryptedSharedPreferences\0shared text\0")
        z.writestr("classes2.dex", b"\0editor.putString(\"auth_token\"\0shared text\0")
        z.writestr("res/a.txt", "plain")
    (tmp_path / "b.apk").write_bytes(b"no archive")
    files = archives.read_archives(spark, str(tmp_path))
    rows = archives.artifacts_from_archives(files).collect()
    pools = [r["text"].split("\n") for r in rows if r["location"] == targets.POOL_LOCATION]
    assert pools == [["EncryptedSharedPreferences", "shared text", 'editor.putString("auth_token"']]
    assert len({r["target_seq"] for r in rows}) == len(rows) == 2
    bad = archives.unreadable_entries(files).collect()
    assert [r["app_id"][-5:] for r in bad] == ["b.apk"] and bad[0]["error"]
    verdicts = {r["app_id"][-5:]: r["reason"] for r in admission.admission_verdicts(archives.archive_entries(files)).collect()}
    assert verdicts == {"a.apk": None, "b.apk": "not a valid archive"}


def test_skipped_entries_have_a_reason(spark):
    limits = admission.Limits(entries=3, scanned_file_bytes=10)
    entries = spark.createDataFrame(
        [("a", i, name, size) for i, (name, size) in enumerate([("a.txt", 5), ("b.txt", 11), ("c.dex", 101), ("d.txt", 1), ("e.png", 99)])],
        "app_id string, entry_seq bigint, entry_name string, file_size bigint")
    got = {(r["entry_name"], r["reason"]) for r in admission.skipped_entries(entries, limits=limits).collect()}
    assert got == {("b.txt", "entry too large"), ("c.dex", "entry too large"), ("d.txt", "too many entries"), ("e.png", "too many entries")}


@pytest.mark.parametrize("text", [
    "void checkServerTrusted(X c) {\n" + "  // nothing to see\n" * 100_000 + "}",
    "void checkServerTrusted(X c) {\n" + "  /* nothing */\n" * 100_000 + "}",
    ".method public checkServerTrusted(X)V\n" + "    .line 12\n" * 100_000 + "    return-void\n.end method",
])
def test_long_runs_of_comments_do_not_recurse(spark, text):
    assert scan(spark, [("a", 0, "F.java", text)], ["NET-003"]).count() == 1


@pytest.mark.parametrize("body, match", [
    ("{}", True), ("{ // note }", True), ("{\n // a\n // b\n}", True), ("{ /* a */ /* b */ }", True), ("{ // a }\n throw x; }", True),
    ("{ // a\n throw x; }", False), ("{ throw x; }", False), ("{ /* a */ // b\n /* c */\n }", True),
])
def test_empty_server_check(spark, body, match):
    got = spark.range(1).select(F.lit(f"void checkServerTrusted(A a, B b) {body}").rlike(P.EMPTY_SERVER_CHECK)).first()[0]
    assert got is match


def test_every_finding_has_a_number_of_its_own(spark):
    places = [(3, 2**24 + 5, 1, 7), (3, 2**24 + 6, 1, 7), (3, 2**24 + 6, 17, 7), (3, 2**24 + 6, 17, 2**24 + 9), (3, 2**24 + 6, 17, 2**24 + 10),
              (3, 2**56, 0, 0), (3, 2**62, 255, 2**40 - 1), (4, 0, 0, 0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "i int, r long, t long, part long, pos long")
    seq = pack_seq(F.col("r"), F.col("t"), F.col("part"), F.col("pos"))
    assert [r["i"] for r in rows.select("i", seq.alias("s")).orderBy("s").collect()] == list(range(len(places)))
    assert rows.select(seq.alias("s")).distinct().count() == len(places)


@pytest.mark.parametrize("keys", ["dense", "packed", "one target"])
def test_large_groups_are_cut(spark, keys):
    n = 120_000
    seq = {"dense": F.col("id"), "packed": F.shiftleft(F.col("id") % 900, 28) + F.floor(F.col("id") / 900),
           "one target": F.when(F.col("id") % 1000 == 0, F.col("id") * 2**28).otherwise(F.col("id"))}[keys]
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("a"), F.col("id") % 500)).alias("app_id"),
                               seq.cast("bigint").alias("seq"))
    ranked = with_ordinal(df, ["app_id"], "seq", "n", parts=16).cache()
    want = Window.partitionBy("app_id").orderBy("seq")
    assert ranked.count() == n
    assert ranked.withColumn("want", F.row_number().over(want)).where("n <> want").count() == 0
    # No partition of the sorted rows holds much more than its share, whatever the groups are.
    by = df.repartitionByRange(16, "app_id", "seq").groupBy(F.spark_partition_id()).count()
    assert by.agg(F.max("count")).first()[0] < n / 8
    ranked.unpersist()


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_text('﻿APK_Hash,tool,finding_category,finding_name,severity\nab,t,Network,"weak\nhash",high\ncd,t,c,"a ""b""",low\n')
    got = external.read_external_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [(r["apk_hash"], r["finding_name"], r["severity"]) for r in got] == [("ab", "weak\nhash", "HIGH"), ("cd", 'a "b"', "LOW")]


def test_own_results_in_every_form(spark, tmp_path):
    import json
    finding = {"rule_id": "R1", "title": "Weak hash", "category": "CRYPTO_FLAW", "severity": "high"}
    document = {"apks": [{"sha256": "AB", "findings": [finding]}, {"sha256": "CD", "detected_rules": ["R2"]}]}
    (tmp_path / "r.json").write_text(json.dumps(document, indent=2))
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(a) + "\n" for a in document["apks"]))
    (tmp_path / "r.csv").write_text("SHA256,title,category,severity\nAB,Weak hash,CRYPTO_FLAW,high\n,x,y,z\nCD,,,\n")
    want = [("ab", "Weak hash", "HIGH"), ("cd", "R2", "HIGH")]
    for name in ("r.json", "r.jsonl"):
        got = external.read_own_results(spark, str(tmp_path / name)).collect()
        assert sorted((r["apk_hash"], r["finding_name"], r["severity"]) for r in got) == want
    got = external.read_own_results(spark, str(tmp_path / "r.csv")).collect()
    assert sorted((r["apk_hash"], r["finding_name"], r["severity"]) for r in got) == [("ab", "Weak hash", "HIGH"), ("cd", "Finding", "MEDIUM")]


def test_first_wins_over_the_whole_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("a", k, f"F{k}.java", f"x http://ordinary.example.org/p y http://own{k}.example.org/")], ART).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"k={k}"))
    inc.incremental_scan(
        spark, str(tmp_path / "in" / "*"), str(tmp_path / "out"), str(tmp_path / "checkpoint"),
        lambda batch: text_scan.text_findings(batch, ["NET-001"], keep_key=True), files_per_batch=1,
        keys=["app_id", "rule_id", "dedupe_key"]).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.select("batch_id").distinct().count() == 3
    assert written.count() == 4 == written.select("dedupe_key").distinct().count()


def test_a_late_first_row_stays_and_a_repeated_batch_adds_nothing(spark, tmp_path):
    schema = "k string, at int"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        inc.append_batches(stream, lambda batch: batch, str(tmp_path / "out"), str(tmp_path / "checkpoint"), keys=["k"]).awaitTermination()
        return sorted((r["k"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("1", [("a", 5), ("b", 5)])
    assert run() == [("a", 5), ("b", 5)]
    # An earlier event that comes later loses against the row already written.
    put("2", [("a", 1), ("c", 1)])
    assert run() == [("a", 5), ("b", 5), ("c", 1)]
    # A batch handed over twice, as after a failure.
    batch = spark.createDataFrame([("c", 1), ("d", 9)], schema)
    for _ in range(2):
        inc._append_unseen(batch, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["k"])
    assert run() == [("a", 5), ("b", 5), ("c", 1), ("d", 9)]


def test_a_batch_reads_no_output_of_earlier_ones(spark, tmp_path):
    out, written = tmp_path / "out", []
    for name in "ab":
        spark.createDataFrame([(name,), ("x",)], "k string").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema("k string").parquet(str(tmp_path / "in" / "*"))
        inc.append_batches(stream, lambda batch: batch, str(out), str(tmp_path / "checkpoint"), keys=["k"]).awaitTermination()
        newest = max(out.iterdir(), key=lambda p: p.name)
        written.append(sorted(r["k"] for r in spark.read.parquet(str(newest)).collect()))
        # Unreadable from here on; a batch that looked at it would fail.
        for file in newest.glob("*.parquet"):
            file.write_bytes(b"no table")
    assert written == [["a", "x"], ["b"]]


def test_replaced_scans_touch_their_dates_only(spark, tmp_path):
    schema = "scan_id string, created_at string, risk_score double, created_date string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    frame([("s1", "1", 1.0, "2024-01-01"), ("s2", "1", 2.0, "2024-01-01"), ("s3", "1", 3.0, "2024-01-02"), ("s4", "1", 4.0, "2024-01-03"),
           ("s5", "1", 5.0, None)]).write.partitionBy("created_date").parquet(str(tmp_path / "scans"))
    files = lambda day: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "scans" / f"created_date={day}").glob("*.parquet"))
    before = {day: files(day) for day in ("2024-01-01", "2024-01-02", "2024-01-03", "__HIVE_DEFAULT_PARTITION__")}
    # s1 changes in place, s4 moves to a new date and leaves its old one empty.
    incoming = frame([("s1", "2", 9.0, "2024-01-01"), ("s4", "2", 8.0, "2024-01-09"), ("s6", "2", 6.0, "2024-01-09")])
    want = [("s1", 9.0, "2024-01-01"), ("s2", 2.0, "2024-01-01"), ("s3", 3.0, "2024-01-02"), ("s4", 8.0, "2024-01-09"),
            ("s5", 5.0, "None"), ("s6", 6.0, "2024-01-09")]
    for k in range(2):
        sink.replace_scans(spark, str(tmp_path), incoming, str(tmp_path / f"scratch{k}"))
        got = spark.read.parquet(str(tmp_path / "scans")).collect()
        assert sorted((r["scan_id"], r["risk_score"], str(r["created_date"])) for r in got) == want
        for day in ("2024-01-02", "__HIVE_DEFAULT_PARTITION__"):
            assert files(day) == before[day]
    assert files("2024-01-01") != before["2024-01-01"]
    # The row without a date is replaced as well.
    sink.replace_scans(spark, str(tmp_path), frame([("s5", "2", 7.0, None)]), str(tmp_path / "scratch2"))
    assert spark.read.parquet(str(tmp_path / "scans")).where("scan_id = 's5'").first()["risk_score"] == 7.0


def test_names_and_categories_as_by_plain_patterns(spark):
    """Faster forms of both normalisers against the patterns they stand for."""
    names = [None, "", " ", "A--b", "<>", "a<>b", "a><b", "x  <  >  y", "\x00Q\x7f\x1fz\t\n", "Tr\u00e4ger  KEY\u212a", "\u0130x", "a\u00a0b", "9" + " -" * 40 + "Z_",
             *("".join(chr(i) for i in range(k, k + 7)) + "w" for k in range(0, 130, 5))]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    slow = F.regexp_replace(F.lower("n"), r"[^a-zA-Z0-9\s]", " ")
    slow = F.coalesce(F.trim(F.regexp_replace(slow, r"\s+", " ")), F.lit(""))
    rows = df.select(slow.alias("a"), normalize_name(F.col("n")).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    words = ["hash", "hashed", "md5", "md5x", "xmd5", "Api-Key", "apikey", "api  key", "World Readable", "reworld readable", "\u00e9ssl", "SSLx", "none", "_sdk", "mis config"]
    df = spark.createDataFrame([(f"{a}{m}{b}",) for a in ("", "a ", "_", "\u00e9") for b in words for m in ("", ".")], "c string")
    got = df.select(canonical_category(F.col("c")).alias("got"), *[F.col("c").rlike(p).alias(n) for p, n in CATEGORY_PATTERNS]).collect()
    assert len({r["got"] for r in got}) >= 5
    assert all(r["got"] == next((n for _, n in CATEGORY_PATTERNS if r[n]), "OTHER") for r in got)
    # No letter is tried by itself: a boundary comes first, once.
    assert all(_at_word(p).count(r"\b") < p.count(r"\b") for p, _ in CATEGORY_PATTERNS)


def test_spark_forms_of_views_have_the_same_rows(spark, tmp_path):
    """Null and repeated keys included; the distinct rows move by their key alone."""
    schema = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int"
    spark.createDataFrame([(k, 1, 2, n) for k in [None, *range(40)] for n in (1, 1, 2)], schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    fx, plain = views.Fixtures(spark, str(tmp_path)), spark.read.parquet(str(tmp_path / "lineitem.parquet"))
    plain.createOrReplaceTempView("plain_lineitem")
    for name in ("fx_finding_apps", "fx_truth"):
        was = spark.sql(views.with_views(f"SELECT * FROM {name}", views.VIEWS).format(lineitem="plain_lineitem", array="array"))
        now = fx.view(name)
        assert now.dtypes == was.dtypes and sorted(map(str, now.collect())) == sorted(map(str, was.collect()))
        assert fx.view(name)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_evaluation_runs_its_records_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    schema = "app_id string, score double, rules array<string>, note string"
    records = spark.createDataFrame([("a", 1.5, ["R"], 'x, "y" z'), ("b", None, None, "")], schema).mapInArrow(seen, schema)
    sink.write_evaluation(records, spark.range(1), spark.range(1), str(tmp_path))
    assert runs.value == 2
    flat = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "apps_csv"))
    assert sorted((r["app_id"], r["score"], r["note"]) for r in flat.collect()) == [("a", "1.5", 'x, "y" z'), ("b", None, None)]


def test_signature_sets_take_one_grouping(spark):
    frame = lambda rows: spark.createDataFrame(rows, "apk_hash string, finding_category string, finding_name string, normalized_name string")
    a = frame([("h", "C", "N", "n"), ("h", "C", "N", "n"), (None, "C", "M", "m"), ("h", "C", "-", ""), ("g", "C", "N", "n")])
    b = frame([("h", "C", "n", "n"), (None, "C", "m", "m"), (None, "C", "m", "m"), ("k", "D", "N", "n")])
    assert {tuple(r) for r in comparison.common_signatures(a, b).collect()} == {("h", "C", "n"), (None, "C", "m")}
    assert [tuple(r) for r in comparison.only_in_first(a, b).collect()] == [("g", "C", "n")]
    assert [tuple(r) for r in comparison.only_in_first(b, a).collect()] == [("k", "D", "n")]
    for op in (comparison.common_signatures, comparison.only_in_first):
        assert op(a, b)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_signatures_of_both_single_sides_take_one_grouping_of_short_keys(spark, sf_dir):
    plan = QUERIES["set_2"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ENSURE_REQUIREMENTS") == 1
    hashes = ["0a1b", "0A1B", "abc", "0a1b\n", "", "é0", "zz", None]
    rows = [(h, "C", f"n{i % 2}", f"n{i % 2}") for i, h in enumerate(hashes * 2)]
    schema = "apk_hash string, finding_category string, finding_name string, normalized_name string"
    ours, theirs = spark.createDataFrame(rows, schema), spark.createDataFrame([("0a1b", "C", "n0", "n0"), (None, "C", "n1", "n1"), ("zz", "D", "n", "n")], schema)
    expect = [("ours", h, "C", f"n{i % 2}") for i, h in enumerate(hashes) if h not in ("0a1b", None)] + [("external", "zz", "D", "n")]
    assert sorted(map(tuple, comparison.only_in_one(ours, theirs).collect())) == sorted(expect)


def test_user_rules_run_once_and_fail_per_application(spark, tmp_path):
    runs = tmp_path / "runs"
    runs.mkdir()

    def check(app, location, text):
        (runs / f"{app}-{location}").open("a").write("x")
        if location == "bad":
            raise ValueError("broken")
        yield {"evidence": text}

    registry = reg.RuleRegistry(builtin=False)
    registry.register(reg.Rule("USR-1", "t", "OTHER", evaluate=check))
    inputs = reg.Inputs(artifacts=spark.createDataFrame([("a", 0, "ok", "1"), ("a", 1, "bad", "2"), ("b", 0, "ok", "3")], ART))
    rows = registry.user_rows(inputs, str(tmp_path / "rows"))
    assert [(r["app_id"], r["evidence"]) for r in registry.run(inputs, user_rows=rows).collect()] == [("b", "3")]
    assert [(r["app_id"], r["rule_id"]) for r in registry.errors(rows).collect()] == [("a", "USR-1")]
    assert {p.name: p.read_text() for p in runs.iterdir()} == {"a-ok": "x", "a-bad": "x", "b-ok": "x"}


def test_empty_truth_keys_match_nothing(spark):
    apps = spark.createDataFrame([("a", "", None, "p"), ("b", None, None, None)], "app_id string, filename string, sha256 string, package_name string")
    truth = spark.createDataFrame([("", ["R0"]), ("p", ["R1"])], "gt_key string, expected_rules array<string>")
    got = evaluation.match_truth(apps, truth).collect()
    assert [(r["app_id"], r["gt_key"], r["prio"]) for r in got] == [("a", "p", 2)]


def test_comparison_summary_reads_nothing_while_it_is_planned(spark):
    rows = spark.createDataFrame([tuple(str(i) for i in range(12))], ", ".join(f"{c} string" for c in sink.COMPARISON_COLUMNS))
    fail = spark.range(1).select(F.raise_error(F.lit("read")).cast("string").alias("tool"))
    assert sink.comparison_summary(rows, fail).columns == sink.COMPARISON_COLUMNS
    assert sink.comparison_summary(rows, spark.createDataFrame([("t1, t2",)], "tool string")).first()["comparison_tool"] == "t1, t2"


def test_folder_of_indented_documents_and_damaged_records(spark, tmp_path):
    import json
    finding = {"rule_id": "R1", "title": "Weak hash", "category": "CRYPTO_FLAW", "severity": "high"}
    folder = tmp_path / "results folder"
    folder.mkdir()
    (folder / "a b.json").write_text(json.dumps({"sha256": "AA", "findings": [finding]}, indent=2))
    (folder / "b.json").write_text("\n\n" + json.dumps({"apks": [{"sha256": "BB", "findings": [finding, finding]}]}, indent=4))
    (folder / "c.json").write_text(json.dumps({"sha256": "CC", "detected_rules": ["R2"]}))
    (folder / "d.jsonl").write_text('{"sha256": "DD", "findings": []}\n{"sha256": "EE", "detected_rules": ["R3"]}\nbroken {\n{"detected_rules": ["R4"]}\n')
    (folder / "e.json").write_text('{\n "sha256": "FF",\n')
    got = sorted((r["apk_hash"], r["finding_name"]) for r in external.read_own_results(spark, str(folder)).collect())
    assert got == [("aa", "Weak hash"), ("bb", "Weak hash"), ("bb", "Weak hash"), ("cc", "R2"), ("ee", "R3")]
    bad = sorted((r["file"].rsplit("/", 1)[1], r["reason"]) for r in external.own_result_problems(spark, str(folder)).collect())
    assert bad == [("d.jsonl", "malformed"), ("d.jsonl", "no hash"), ("e.json", "malformed")]


def test_ragged_rows_are_listed(spark, tmp_path):
    (tmp_path / "x.csv").write_text("APK_Hash,tool,finding_category,finding_name,severity\nab,t,Network,weak,high\ncd,t\nef,t,c,n,low,more\n,t,c,n,low\n")
    path = str(tmp_path / "x.csv")
    rows = {(r["apk_hash"], r["finding_name"], r["severity"]) for r in external.read_external_csv(spark, path).collect()}
    assert rows == {("ab", "weak", "HIGH"), ("cd", "", ""), ("ef", "n", "LOW")}
    problems = {(r["record"], r["reason"], r["kept"]) for r in external.external_csv_problems(spark, path).collect()}
    assert problems == {("cd,t", "ragged", True), ("ef,t,c,n,low,more", "ragged", True), (",t,c,n,low", "no hash", False)}


def test_report_rows_move_before_they_become_lines(spark, tmp_path, sf_dir):
    fx = views.Fixtures(spark, sf_dir)
    rows, path = tables._report(fx, reports.report_rows), str(tmp_path / "out")
    # Prose is put in after the rows are sorted, so none of it travels.
    assert not {"description", "impact", "remediation", "line"} & set(rows.columns)
    reports.write_reports(rows, path)
    written = spark.read.text(path).groupBy("value").count()
    lines = reports.lines_of(rows).select(F.concat_ws("\t", "app_id", "line").alias("value")).groupBy("value").count()
    assert written.exceptAll(lines).isEmpty() and lines.exceptAll(written).isEmpty()
    assert all(f.name.endswith(".gz") for f in (tmp_path / "out").glob("part-*"))
    # Files follow each other in report order.
    found = [line.split("\t")[0] for f in sorted((tmp_path / "out").glob("part-*")) for line in gzip.open(f, "rt").read().split("\n") if line]
    assert found == sorted(found)


def test_a_written_report_leaves_no_shuffle_files(spark, sf_dir):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        names = [found.apply(i).getName() for i in range(found.size())]
        return {n for n in names if n.startswith("shuffle_")}

    before = files()
    lines = QUERIES["snk_7_text"](spark, sf_dir)
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    whole = reports.lines_of(tables._report(views.Fixtures(spark, sf_dir), reports.report_rows))
    assert lines.count() == whole.count()


def lineitem_of(spark, folder, n):
    rows = spark.range(n).selectExpr(
        "id AS l_orderkey", "id % 40 AS l_partkey", "id % 30 AS l_suppkey", "id % 7 + 1 AS l_linenumber", "id % 50 AS l_quantity",
        "'A' AS l_returnflag", "'O' AS l_linestatus", "1.0D AS l_extendedprice")
    rows.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


@pytest.mark.parametrize("name, ending", [("src_12", ".csv.gz"), ("snk_8", ".zstd.parquet")])
def test_round_trips_write_compressed_files(spark, tmp_path, monkeypatch, name, ending):
    monkeypatch.setattr(tables, "work_dir", lambda _: str(tmp_path / "work"))
    assert QUERIES[name](spark, lineitem_of(spark, tmp_path, 100)).count() > 0
    files = [f.name for f in (tmp_path / "work").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(ending) for f in files)


def test_numbering_writes_small_files(spark, tmp_path):
    with_ordinal(spark.range(10).withColumn("k", F.lit(1)), ["k"], "id", folder=str(tmp_path / "placed"))
    assert list((tmp_path / "placed").glob("part-*.zstd.parquet"))


def test_result_files_are_told_apart_once(spark, tmp_path, monkeypatch):
    calls, whole = [], external.whole_documents
    monkeypatch.setattr(external, "whole_documents", lambda *a: calls.append(a) or whole(*a))
    folders = iter([str(tmp_path / "json"), str(tmp_path / "csv")])
    monkeypatch.setattr(tables, "work_dir", lambda _: next(folders))
    n = 5000
    counts = QUERIES["src_14_forms"](spark, lineitem_of(spark, tmp_path, n))
    assert counts.where("apk_hash <> 'problems'").agg(F.sum("n")).first()[0] == n
    # A document for 10,000 records, the records a line and the damaged document: three folders.
    assert len(calls) == 1 and len(list((tmp_path / "json").glob("bucket=*"))) == 3


def test_files_of_a_batch_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "work_dir", lambda _: str(tmp_path / "work"))
    text = 'String password = "Xk29sLq08Zpw"; '
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source"))
    docs.repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        QUERIES["str_1"](spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", old)
    assert len(list((tmp_path / "work" / "in").glob("part-*"))) == 7
    assert len(list((tmp_path / "work" / "checkpoint" / "commits").glob("[0-9]*"))) == 3


def fine_parts(spark):
    return FINE_PER_CORE * spark.sparkContext.defaultParallelism


def scan_tables(spark):
    scans = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b"), (None, "c")], "scan_id string, app_id string")
    rows = spark.createDataFrame([("1",), ("1",), ("2",), ("3",), (None,), ("9",)], "scan_id string")
    apps = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "app_id string")
    return {"scans": scans, "findings": rows, "permissions": rows, "apps": apps}


def test_tables_without_scans_stay_in_small_partitions(spark, no_broadcast):
    gone = spark.createDataFrame([("1",), ("3",), ("3",), (None,)], "scan_id string")
    left = history.delete_scans(scan_tables(spark), gone)
    rows = {name: sorted((tuple(r) for r in df.collect()), key=str) for name, df in left.items()}
    assert rows["scans"] == [("2", "a"), (None, "c")]
    assert rows["findings"] == rows["permissions"] == [("2",), ("9",), (None,)]
    assert rows["apps"] == [("a",), ("c",), ("d",), (None,)]
    assert left["findings"].groupBy("scan_id").count().rdd.getNumPartitions() >= fine_parts(spark)
    assert left["apps"].rdd.getNumPartitions() >= fine_parts(spark)


def test_dependants_of_a_hash_are_counted_in_small_partitions(spark, no_broadcast):
    t = scan_tables(spark)
    scans = t["scans"].selectExpr("*", *[f"'' AS {c}" for c in ("risk_score", "risk_rating", "duration", "analyzer_version", "created_at")])
    apps = t["apps"].selectExpr("*", "if(app_id = 'a', 'h', 'i') AS sha256", *[
        f"'' AS {c}" for c in ("filename", "package_name", "version_name", "version_code", "analyzed_at", "app_name")])
    found = history.find_by_hash(scans, apps, t["findings"], t["permissions"].where("scan_id = '2'"), " h ")
    assert sorted((r["id"], r["findings_count"], r["permissions_count"]) for r in found.collect()) == [("1", 2, 0), ("2", 1, 1)]
    assert found.rdd.getNumPartitions() >= fine_parts(spark)


def rule_findings(spark, n=6):
    rows = [(app, i, rule, f"t{i}", "C", "LOW", "HIGH", "e", "l") for app in ("a", None) for rule in ("R", "S", None) for i in range(n)]
    return spark.createDataFrame(
        rows, "app_id string, finding_seq bigint, rule_id string, title string, category string, severity string, "
        "confidence string, evidence string, location string")


def test_points_of_occurrences_are_not_looked_up_by_a_join(spark, no_broadcast):
    items = scoring.itemized_breakdown(rule_findings(spark))
    rows = {(r["app_id"], r["rule_id"], r["occurrence_index"]): r["adjusted_score"] for r in items.collect()}
    assert len(rows) == 2 * 3 * 6
    # Rows without a rule count for the low cap of their application (15 of 15.75) and get no points.
    assert [rows["a", "R", k] for k in range(1, 7)] == [2.86, 1.43, 0.71, 0.0, 0.0, 0.0]
    assert rows[None, "R", 1] == rows["a", None, 1] == 0.0
    assert "Join" not in items._jdf.queryExecution().optimizedPlan().toString()


def test_scores_of_applications_are_made_in_small_partitions(spark, no_broadcast):
    report = scoring.score_report(rule_findings(spark).where("rule_id IS NOT NULL"))
    assert {r["app_id"]: r["findings_evaluated"] for r in report.collect()} == {"a": 12}
    assert report.rdd.getNumPartitions() >= fine_parts(spark)
