"""Golden values of scalar functions, readers, admission and statistics."""

import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from fleetaudit import catalogs as C
from fleetaudit.functions import classify, metrics as M, paths, text as tx, urls
from fleetaudit.operators import admission as adm, evaluation as ev, history as h
from fleetaudit.schemas import ARCHIVE_ENTRIES
from fleetaudit.session import work_dir
from fleetaudit.sources import archives, catalogs, external


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("fn, value, want", [
    (classify.canonical_category, "Adware / Tracker SDK", "TRACKING_SDK"),
    (classify.canonical_category, "Broken Cryptography", "CRYPTO_FLAW"),
    (classify.canonical_category, None, "OTHER"),
    (classify.canonical_category, " permission ", "PERMISSION"),
    (tx.normalize_name, "Hardcoded_Google_API_Key (v2)", "hardcoded google api key v2"),
    (tx.redact_secret, "abcdef", "********"),
    (tx.redact_secret, "abcdefg", "ab********fg"),
    (tx.redact_secret, "abcdefghijkl", "abcdefgh********jkl"),
    (tx.redact_text, 'password = "hunter2x", token:abc', 'password="hu********2x", token:********'),
    (tx.redact_text, "nothing here", "nothing here"),
    (tx.redact_for_log, "password=abc next", "[REDACTED_SECRET] next"),
    (tx.escape_controls, "a\r\nb\x01\tc", "a\\r\\nb\\x01\tc"),
    (tx.neutralize_formula, "=1+1", "'=1+1"),
    (tx.is_placeholder, "abababab", True),
    (tx.is_placeholder, "short", True),
    (tx.is_placeholder, "aK9xQ2mZ7pL4", False),
    (paths.sanitize_filename, "../..\\x/CON.apk", "safe_CON.apk"),
    (paths.sanitize_filename, "...", "unnamed.apk"),
    (paths.is_safe_entry, "a/../b", False),
    (paths.is_safe_entry, "C:/x", False),
    (paths.is_safe_entry, "\\abs", False),
    (paths.is_safe_entry, "a/b..c", True),
    (paths.is_safe_entry, None, False),
    (paths.class_from_path, "jadx/com/a/B.java", "com.a.B"),
    (urls.url_host, "HTTPS://Api_X.Example.com:8080/p", "api_x.example.com"),
    (urls.url_path, "https://h/a;b/c;d?x#y", "/a;b/c"),
    (urls.clean_url, 'http://h.io/a.js);"', "http://h.io/a.js"),
    (M.tri_state, " TRUE ", True),
    (M.tri_state, "maybe", None),
])
def test_values(spark, fn, value, want):
    assert one(spark, value, fn) == want


@pytest.mark.parametrize("score, band", [(19.9, "MINIMAL"), (20, "LOW"), (40, "MEDIUM"), (60, "HIGH"), (80, "CRITICAL")])
def test_bands(spark, score, band):
    assert spark.range(1).select(classify.rating_band(F.lit(float(score)))).first()[0] == band


@pytest.mark.parametrize("counts, want", [((0, 0, 0), (1.0, 1.0, 1.0)), ((0, 5, 0), (0.0, 1.0, 0.0)), ((2, 1, 1), (0.6667, 0.6667, 0.6667))])
def test_confusion(spark, counts, want):
    tp, fp, fn = (F.lit(x) for x in counts)
    assert tuple(spark.range(1).select(M.precision(tp, fp), M.recall(tp, fn), M.f1_score(tp, fp, fn)).first()) == want


def test_jaccard(spark):
    empty, ab = F.array().cast("array<string>"), F.array(F.lit("a"), F.lit("b"))
    got = spark.range(1).select(M.jaccard(empty, empty), M.jaccard(ab, ab), M.jaccard(ab, empty)).first()
    assert tuple(got) == (1.0, 1.0, 0.0)


def test_entropy(spark):
    assert one(spark, "abcd", tx.shannon_entropy) == pytest.approx(2.0)
    assert one(spark, "", tx.shannon_entropy) == 0.0


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0], [3.0, 1.0, 2.0], [5.5] * 4 + [1.25], [0.1 * i for i in range(101)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "d double")
    got = ev.timing_statistics(df, "d").first()
    assert got["median_analysis_time_seconds"] == pytest.approx(statistics.median(values))
    assert got["mean_analysis_time_seconds"] == pytest.approx(statistics.mean(values), abs=1e-4)


def test_timing_of_nothing(spark):
    row = ev.timing_statistics(spark.createDataFrame([], "duration double")).first()
    assert row["mean_analysis_time_seconds"] is None and row["median_analysis_time_seconds"] is None
    assert row["total_analysis_time_seconds"] == 0.0


def test_overall_metrics_without_truth(spark):
    flags = spark.createDataFrame([], "app_id string, rule_id string, tp int, fp int, fn int")
    assert set(ev.overall_metrics(flags).first()) == {None}


def test_archives_on_disk(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.apk", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("AndroidManifest.xml", "<manifest/>")
        z.writestr("../evil.txt", "x" * 1000)
    (tmp_path / "b.apk").write_bytes(b"broken")
    files = archives.read_archives(spark, str(tmp_path))
    rows = archives.archive_entries(files).collect()
    assert len([r for r in rows if r["error"] is None]) == 2 and len([r for r in rows if r["error"]]) == 1
    entries = archives.archive_entries(files).where("error IS NULL")
    verdict = adm.admission_verdicts(entries).first()
    assert verdict["reason"] == "unsafe path: ../evil.txt" and not verdict["admitted"]
    assert files.where("filename = 'b.apk'").first()["sha256"] is not None


def test_archive_contents_to_findings(spark, tmp_path):
    from fleetaudit.operators.rules import text_scan

    with zipfile.ZipFile(tmp_path / "a.apk", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("assets/conf.json", '{"u": "http://api.real-host.io/x"}')
        z.writestr("classes.dex", b"\x00\x01Cipher.getInstance(\"DES\")\x00ab\x00Cipher.getInstance(\"DES\")\xff")
        z.writestr("res/icon.png", "http://api.hidden.io/x")
        z.writestr("../up.txt", "http://api.hidden.io/x")
        z.writestr("big.txt", "x" * 100)
    files = archives.read_archives(spark, str(tmp_path))
    art = archives.artifacts_from_archives(files, adm.Limits(scanned_file_bytes=90))
    assert {r["location"] for r in art.collect()} == {"DEX:StringPool", "assets/conf.json"}
    found = text_scan.text_findings(art, ["NET-001", "CRY-001"]).collect()
    assert {(r["rule_id"], r["location"]) for r in found} == {("NET-001", "assets/conf.json"), ("CRY-001", "DEX:StringPool")}
    pool = archives.string_pool(spark.createDataFrame([("a", bytearray(b"zzzz\x00aaaa\x00zzzz"))], "app_id string, content binary"))
    assert {(r["string"], r["string_seq"]) for r in pool.collect()} == {("zzzz", 0), ("aaaa", 1)}


def test_admission_order(spark):
    rows = [("a", i, f"f{i}", 1, 1) for i in range(5)] + [("b", 0, "x.dex", 400 * adm.MIB, 200 * adm.MIB), ("b", 1, "y", 200 * adm.MIB, 200 * adm.MIB)] + [
        ("c", 0, "classes.dex", 20 * adm.MIB, 1000)]
    got = {r["app_id"]: r["reason"] for r in adm.admission_verdicts(spark.createDataFrame(rows, ARCHIVE_ENTRIES)).collect()}
    assert got == {"a": "no manifest or dex", "b": "uncompressed size too large", "c": "compression bomb: classes.dex"}


def test_entry_cap_is_exact(spark):
    df = spark.range(25_000).selectExpr("'hot' AS app_id", "id AS entry_seq", "concat('f', id) AS entry_name", "id AS file_size", "id AS compress_size")
    kept = adm.first_entries(df)
    assert kept.count() == 10_000 and kept.agg(F.max("entry_seq")).first()[0] == 9_999


def test_external_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_bytes("\ufeffAPK_HASH,Tool,Finding_Category,finding_name,SEVERITY\nABC ,T, Weak crypto ,\"A, b\",high\n,T,x,y,low\n".encode())
    rows = external.read_external_csv(spark, str(f)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["apk_hash"], r["finding_category"], r["raw_finding_category"], r["normalized_name"], r["severity"]) == (
        "abc", "CRYPTO_FLAW", "Weak crypto", "a b", "HIGH")
    bad = tmp_path / "bad.csv"
    bad.write_text("apk_hash,tool\n1,2\n")
    with pytest.raises(ValueError, match="finding_category"):
        external.read_external_csv(spark, str(bad))


def test_own_results_documents(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"apks": [{"sha256": "AA", "findings": [{"rule_id": "R1", "finding_name": "Weak Hash", "finding_category": "CRYPTO_FLAW", "severity": "low"}]},'
        ' {"sha256": "N/A", "findings": []}, {"sha256": "bb", "detected_rules": ["NET-001"]}]}\n'
        '{"application": {"sha256": "CC"}, "findings": [{"rule_id": "R2", "title": "T", "category": "OTHER"}]}\n')
    rows = {(r["apk_hash"], r["finding_category"], r["normalized_name"], r["severity"]) for r in external.read_own_results(spark, str(tmp_path)).collect()}
    assert rows == {("aa", "CRYPTO_FLAW", "weak hash", "LOW"), ("bb", "OTHER", "net 001", "HIGH"), ("cc", "OTHER", "t", "MEDIUM")}


def test_catalog_files(spark, tmp_path):
    f = tmp_path / "c.json"
    f.write_text('{"permissions": {"p.A": {"family": "x", "protection_level": "normal", "risk_level": "LOW", "is_sensitive_user_data": true}}}')
    row = catalogs.read_catalog(spark, str(f), "permissions").first()
    assert (row["permission"], row["family"], row["is_sensitive_user_data"]) == ("p.A", "x", True)
    f.write_text('{"sdk_definitions": [{"id": "s", "name": "S", "category": "social", "package_pattern": "com.s", "sensitive_families": ["x"]}]}')
    assert catalogs.as_literals(catalogs.read_catalog(spark, str(f), "sdks"))[0][3] == "com.s"
    with pytest.raises(ValueError):
        catalogs.as_literals(spark.range(10), limit=5)


def test_catalog_sizes():
    assert (len(C.PERMISSIONS), len(C.SDKS), len(C.TRACKING_DOMAINS), len(C.PERMISSION_TO_FAMILY)) == (38, 18, 32, 26)


def test_delete_removes_orphans(spark):
    scans = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s3", "b")], "scan_id string, app_id string")
    dep = spark.createDataFrame([("s1",), ("s3",)], "scan_id string")
    apps = spark.createDataFrame([("a",), ("b",), ("c",)], "app_id string")
    left = h.delete_scans({"scans": scans, "findings": dep, "permissions": dep, "apps": apps}, scans.where("scan_id = 's3'"))
    assert {r[0] for r in left["apps"].collect()} == {"a", "c"}
    assert {r[0] for r in left["findings"].collect()} == {"s1"} and left["scans"].count() == 2


class NamedFolder:
    """Stand-in for a session of a cluster that names a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: "hdfs:///shared" if key == "spark.checkpoint.dir" else default)


def test_work_dir_uses_the_shared_folder(spark):
    assert work_dir(NamedFolder).startswith("hdfs:///shared/fleetaudit-")
    assert work_dir(spark) != work_dir(spark)
