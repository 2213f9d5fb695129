"""Queries of sources, admission and sinks, with round trips through files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..catalogs import PERMISSIONS
from ..fixtures.views import Fixtures
from ..functions import metrics as M, paths
from ..operators import admission as adm, comparison as cmp, evaluation as ev, findings as fnd
from ..operators import permissions as prm, scoring
from ..session import step, work_dir
from ..sinks import reports, tables as sink
from ..sources import archives, catalogs, external, manifest as mf, targets
from .base import query, quote
from .findings import _RANK, SCORE
from .functions import canonical_sql, name_sql
from .history import _COUNTS, _PRF, APP_METRICS, COMPARE, MATCHED, SIDES, _matched, sides
from .rules import CLASSIFIED, _LEVEL

c = F.col

# --- sources --------------------------------------------------------------------------------------


def _zip_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Test data: one stored archive per document."""
    for pdf in batches:
        out = []
        for doc, text in zip(pdf["doc_id"], pdf["text"]):
            buf = io.BytesIO()
            if doc % 10 == 9:
                out.append((str(doc), b"not an archive"))
                continue
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_STORED) as z:
                z.writestr("AndroidManifest.xml", "<manifest/>")
                z.writestr(f"assets/doc{doc}.txt", text)
            out.append((str(doc), buf.getvalue()))
        yield pd.DataFrame(out, columns=["app_id", "content"])


@query("src_1", """SELECT CAST(doc_id AS STRING) AS app_id, CAST(i AS BIGINT) AS entry_seq, CASE WHEN i = 0 THEN 'AndroidManifest.xml' ELSE 'assets/doc' || doc_id || '.txt' END AS entry_name,
    CASE WHEN i = 0 THEN 11 ELSE strlen(text) END AS file_size, CASE WHEN i = 0 THEN 11 ELSE strlen(text) END AS compress_size, false AS failed
    FROM documents, (VALUES (0), (1)) v(i) WHERE doc_id % 10 <> 9
    UNION ALL SELECT CAST(doc_id AS STRING), NULL, NULL, NULL, NULL, true FROM documents WHERE doc_id % 10 = 9""")
def src_1(fx: Fixtures):
    zips = fx.table("documents").select("doc_id", "text").mapInPandas(_zip_documents, "app_id string, content binary")
    return archives.archive_entries(zips).select(
        "app_id", "entry_seq", "entry_name", "file_size", "compress_size", c("error").isNotNull().alias("failed"))


@query("src_2", """SELECT DISTINCT CAST(doc_id AS STRING) AS app_id, md5(unnest(regexp_extract_all(text, '[\\x20-\\x7E]{4,}'))) AS string FROM documents""")
def src_2(fx: Fixtures):
    bin_docs = fx.table("documents").select(c("doc_id").cast("string").alias("app_id"), F.encode("text", "UTF-8").alias("content"))
    return archives.string_pool(bin_docs).select("app_id", F.md5("string").alias("string"))


@query("src_3", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def src_3(fx: Fixtures):
    return fx.table("documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def _manifests(fx: Fixtures):
    """Manifest XML written from the application table."""
    attr = lambda name, col: F.when(col.isNotNull(), F.concat(F.lit(f' android:{name}="'), col, F.lit('"'))).otherwise("")
    flag = lambda name, col: attr(name, F.when(c(col), "true").when(~c(col), "0"))
    filters = ('<intent-filter><action android:name="android.intent.action.MAIN"/>'
               '<category android:name="android.intent.category.LAUNCHER"/></intent-filter>')
    key = c("app_id").cast("bigint")
    xml = F.concat(
        F.lit('<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="'), "package_name",
        F.lit('" android:versionCode="'), "version_code", F.lit('" android:versionName="'), "version_name",
        F.lit('"><uses-sdk android:minSdkVersion="'), "min_sdk", F.lit('"'), attr("targetSdkVersion", c("target_sdk")),
        F.lit('/><uses-permission android:name="android.permission.INTERNET"/><uses-permission android:name="android.permission.CAMERA"/>'
              '<uses-feature android:name="android.hardware.camera"/><application'),
        flag("allowBackup", "allow_backup"), flag("debuggable", "debuggable"), flag("usesCleartextTraffic", "uses_cleartext_traffic"),
        attr("networkSecurityConfig", c("network_security_config")), F.lit('><uses-library android:name="org.lib.http"/>'),
        F.lit('<activity android:name=".Main">' + filters + '</activity><activity android:name=".Second"'),
        F.when(key % 2 == 0, ' android:exported="true"').otherwise(""),
        F.lit('/><service android:name=".Sync" android:permission="p.GUARD"><intent-filter><action android:name="sync.NOW"/><action android:name="sync.LATER"/></intent-filter></service>'
              '<provider android:name=".Data"/></application></manifest>'),
    )
    return fx.apps.select("app_id", xml.alias("manifest_xml"))


@query("src_4", """SELECT app_id, package_name, nullif(version_name, '') AS version_name, version_code, min_sdk, trim(target_sdk) AS target_sdk, allow_backup, debuggable,
    uses_cleartext_traffic, network_security_config, 'android.permission.INTERNET;android.permission.CAMERA' AS permissions,
    'android.hardware.camera' AS features, 'org.lib.http' AS libraries FROM fx_apps""")
def src_4(fx: Fixtures):
    p = mf.parse_manifests(_manifests(fx))
    lists = [F.array_join(x, ";").alias(x) for x in ("permissions", "features", "libraries")]
    return p.select("app_id", "package_name", F.nullif("version_name", F.lit("")).alias("version_name"), "version_code", "min_sdk",
                    F.trim("target_sdk").alias("target_sdk"), "allow_backup", "debuggable", "uses_cleartext_traffic",
                    "network_security_config", *lists)


@query("src_4_components", f"""SELECT app_id, comp_seq, ctype AS component_type, name,
    CASE comp_seq WHEN 0 THEN true WHEN 1 THEN CAST(app_id AS BIGINT) % 2 = 0 WHEN 2 THEN true ELSE coalesce(({_LEVEL}) < 17, false) END AS exported,
    CASE WHEN comp_seq = 2 THEN 'p.GUARD' END AS permission, comp_seq IN (0, 2) AS has_intent_filter, comp_seq = 0 AS is_main_launcher, actions
    FROM fx_apps, (VALUES (0::BIGINT, 'activity', '.Main', 'android.intent.action.MAIN'), (1, 'activity', '.Second', ''),
        (2, 'service', '.Sync', 'sync.NOW;sync.LATER'), (3, 'provider', '.Data', '')) v(comp_seq, ctype, name, actions)""")
def src_4_components(fx: Fixtures):
    rows = mf.component_rows(mf.parse_manifests(_manifests(fx)))
    return rows.select("app_id", "comp_seq", "component_type", "name", "exported", "permission", "has_intent_filter",
                       "is_main_launcher", F.array_join("actions", ";").alias("actions"))


@query("src_5", f"""SELECT c.app_id, comp_seq, CASE WHEN exported_attr IS NOT NULL THEN lower(trim(exported_attr)) IN ('true', '1')
    WHEN component_type = 'provider' THEN coalesce(({_LEVEL}) < 17, false) ELSE has_intent_filter END AS exported
    FROM fx_components c JOIN fx_apps a USING (app_id)""")
def src_5(fx: Fixtures):
    levels = fx.apps.select("app_id", M.sdk_level(c("target_sdk")).alias("level"))
    return fx.components.join(levels, "app_id").select("app_id", "comp_seq", mf.default_exported(
        c("exported_attr"), c("component_type"), c("level"), c("has_intent_filter")).alias("exported"))


@query("src_6", "SELECT app_id, comp_seq, (k % 2 = 0 AND k % 3 = 0) OR (k % 5 = 0 AND k % 7 = 0) AS launcher FROM fx_components")
def src_6(fx: Fixtures):
    one = lambda a, b: F.struct(
        F.array(F.when(c("k") % a == 0, "android.intent.action.MAIN").otherwise("x.VIEW")).alias("actions"),
        F.array(F.lit("y"), F.when(c("k") % b == 0, "android.intent.category.LAUNCHER").otherwise("z")).alias("categories"))
    return fx.components.select("app_id", "comp_seq", mf.is_launcher(F.array(one(2, 3), one(5, 7))).alias("launcher"))


_TRI = "CASE p_partkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '1' WHEN 3 THEN 'False' WHEN 4 THEN '0' WHEN 5 THEN 'yes' END"


@query("src_7", f"SELECT p_partkey, CASE WHEN lower(trim(v)) IN ('true', '1') THEN true WHEN lower(trim(v)) IN ('false', '0') THEN false END AS flag FROM (SELECT p_partkey, {_TRI} AS v FROM part)")
def src_7(fx: Fixtures):
    return fx.table("part").select("p_partkey", M.tri_state(F.expr(_TRI)).alias("flag"))


@query("src_8", f"""SELECT CAST(conv_id AS STRING) AS app_id, 0 AS target_seq, 'DEX:StringPool' AS location, md5(string_agg(text, chr(10) ORDER BY turn)) AS text FROM conversations GROUP BY conv_id
    UNION ALL SELECT app_id, target_seq + 1, location, md5(text) FROM fx_artifacts
    UNION ALL SELECT app_id, {targets.MANIFEST_BLOCK}, 'AndroidManifest.xml', md5('<manifest package="' || package_name || '"/>') FROM fx_apps""")
def src_8(fx: Fixtures):
    strings = fx.table("conversations").select(c("conv_id").cast("string").alias("app_id"), c("turn").alias("string_seq"), c("text").alias("string"))
    files = fx.artifacts().withColumnRenamed("target_seq", "file_seq")
    apps = fx.apps.withColumn("manifest_xml", F.concat(F.lit('<manifest package="'), "package_name", F.lit('"/>')))
    return targets.text_targets(files, targets.pool_targets(strings), apps).withColumn("text", F.md5("text"))


@query("src_9", "SELECT app_id, cand_seq, kind, md5(text) AS text FROM fx_candidates")
def src_9(fx: Fixtures):
    return fx.candidates().withColumn("text", F.md5("text"))


_SRC = "CASE WHEN doc_id % 3 = 0 THEN 'jadx/' WHEN doc_id % 3 = 1 THEN 'apktool/' ELSE '' END || 'com/' || source || '/C' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN '.java' ELSE '.kt' END"


@query("src_10", f"""SELECT app_id, class_name, CASE WHEN contains(class_name, '.') THEN regexp_replace(class_name, '\\.[^.]*$', '') END AS package_name FROM (
    SELECT DISTINCT lang AS app_id, replace(regexp_replace(regexp_replace(regexp_replace({_SRC}, '^jadx/', ''), '^apktool/', ''), '\\.[^.]*$', ''), '/', '.') AS class_name FROM documents)""")
def src_10(fx: Fixtures):
    files = fx.table("documents").select(c("lang").alias("app_id"), F.expr(_SRC).alias("location"))
    none = files.select("app_id", F.lit(None).cast("string").alias("name")).limit(0)
    classes = targets.class_names(files, none)
    return classes.withColumn("package_name", paths.package_from_class(c("class_name")))


_PERM_VALUES = ", ".join(f"({quote(p[0])}, '{p[3]}')" for p in PERMISSIONS)


@query("src_11", f"""SELECT v.permission, v.risk_level, count(f.app_id) AS apps FROM (VALUES {_PERM_VALUES}) v(permission, risk_level)
    LEFT JOIN fx_permissions f USING (permission) GROUP BY 1, 2""")
def src_11(fx: Fixtures):
    used = fx.permissions.groupBy("permission").agg(F.count("*").alias("n"))
    cat = catalogs.built_in(fx.spark, "permissions")
    return cat.join(used, "permission", "left").select("permission", "risk_level", F.coalesce("n", F.lit(0)).alias("apps"))


@query("src_12", f"""SELECT lower(apk_hash) AS apk_hash, tool, {canonical_sql('finding_category')} AS finding_category, finding_category AS raw_finding_category,
    finding_name, {name_sql('finding_name')} AS normalized_name, upper(trim(severity)) AS severity, count(*) AS n
    FROM fx_external GROUP BY 1, 2, 3, 4, 5, 6, 7""")
def src_12(fx: Fixtures):
    path = work_dir(fx.spark)
    raw = fx.external.select(c("apk_hash").alias("APK_Hash "), c("tool").alias("Tool"), c("finding_category").alias("Finding_Category"),
                             c("finding_name").alias("FINDING_NAME"), c("severity").alias("severity"))
    raw.write.option("header", "true").option("compression", "gzip").csv(path)
    rows = external.read_external_csv(fx.spark, path)
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))


@query("src_13", "SELECT gt_key, array_to_string(expected_rules, ';') AS expected_rules FROM fx_truth")
def src_13(fx: Fixtures):
    t = fx.truth
    part = F.pmod(F.xxhash64("gt_key"), F.lit(3))
    entry = F.create_map(F.concat(F.lit(" "), F.upper("gt_key")), F.struct("expected_rules"))
    docs = t.where(part == 0).select(F.to_json(entry).alias("doc")).union(
        t.where(part == 1).select(F.to_json(F.create_map(F.lit("apks"), entry))))
    records = t.where(part == 2).select(F.lit("").alias("filename"), c("gt_key").alias("package"), "expected_rules")
    both = external.truth_from_documents(docs).unionByName(external.truth_from_records(records))
    return both.withColumn("expected_rules", F.array_join("expected_rules", ";"))


@query("src_14", f"""SELECT apk_hash, {canonical_sql('cat')} AS finding_category, {name_sql('nm')} AS normalized_name, sev AS severity, count(*) AS n FROM (
    SELECT apk_hash, CASE WHEN short THEN raw_category ELSE raw_category END AS cat, CASE WHEN short THEN raw_category ELSE finding_name END AS nm,
        CASE WHEN short THEN 'HIGH' ELSE 'MEDIUM' END AS sev FROM (SELECT *, finding_name LIKE 'Hardcoded%' AS short FROM fx_ours)) GROUP BY 1, 2, 3, 4""")
def src_14(fx: Fixtures):
    path = work_dir(fx.spark)
    short = c("finding_name").like("Hardcoded%")
    record = fx.ours.select(
        F.upper("apk_hash").alias("sha256"),
        F.when(~short, F.array(F.struct(c("finding_name").alias("title"), c("raw_category").alias("category"), F.lit("medium").alias("severity")))).alias("findings"),
        F.when(short, F.array("raw_category")).alias("detected_rules"))
    record.write.json(path)
    rows = external.read_own_results(fx.spark, path)
    return rows.groupBy("apk_hash", "finding_category", "normalized_name", "severity").agg(F.count("*").alias("n"))


@query("src_12_problems", """SELECT CASE WHEN h < '2' THEN 'no hash' ELSE 'ragged' END AS reason, h >= '2' AS kept, count(*) AS n
    FROM (SELECT substr(lower(apk_hash), 1, 1) AS h FROM fx_external) WHERE h < '6' GROUP BY 1, 2""")
def src_12_problems(fx: Fixtures):
    """Rows with a hash from 0 lose it, those from 2 lose their last cells, those from 4 get one cell more."""
    path = work_dir(fx.spark)
    h = F.substring(F.lower("apk_hash"), 1, 1)
    cell = lambda name: F.concat(F.lit('"'), F.replace(F.col(name), F.lit('"'), F.lit('""')), F.lit('"'))
    cells = [F.when(h >= "2", cell("apk_hash")).otherwise(""), cell("tool"), cell("finding_category"), cell("finding_name"), cell("severity")]
    line = F.when((h >= "2") & (h < "4"), F.concat_ws(",", *cells[:3])).when((h >= "4") & (h < "6"), F.concat_ws(",", *cells, F.lit("more"))).otherwise(
        F.concat_ws(",", *cells))
    # One column whose name is the header line, written as it stands.
    head = "apk_hash,tool,finding_category,finding_name,severity"
    fx.external.select(line.alias(head)).write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return external.external_csv_problems(fx.spark, path).groupBy("reason", "kept").agg(F.count("*").alias("n"))


@query("src_14_forms", f"""SELECT apk_hash, {canonical_sql('cat')} AS finding_category, {name_sql('nm')} AS normalized_name, sev AS severity, count(*) AS n FROM (
    SELECT apk_hash, raw_category AS cat, CASE WHEN short THEN raw_category ELSE finding_name END AS nm,
        CASE WHEN short THEN 'HIGH' ELSE 'MEDIUM' END AS sev FROM (SELECT *, finding_name LIKE 'Hardcoded%' AS short FROM fx_ours)) GROUP BY 1, 2, 3, 4
    UNION ALL SELECT 'problems', 'malformed', '', '', 1""")
def src_14_forms(fx: Fixtures):
    """A third each as indented documents, as records a line in the same folder, and as CSV; one document is damaged."""
    path, tables = work_dir(fx.spark), work_dir(fx.spark)
    short, h = c("finding_name").like("Hardcoded%"), F.substring("apk_hash", 1, 1)
    record = F.struct(
        F.upper("apk_hash").alias("sha256"),
        F.when(~short, F.array(F.struct(c("finding_name").alias("title"), c("raw_category").alias("category"), F.lit("medium").alias("severity")))).alias("findings"),
        F.when(short, F.array("raw_category")).alias("detected_rules"))
    first = fx.ours.where(h < "5")
    documents = first.count() // 10_000 + 1
    (first.groupBy(F.pmod(F.xxhash64("apk_hash"), F.lit(documents)).alias("bucket")).agg(F.collect_list(record).alias("apks"))
     .select("bucket", F.to_json(F.struct("apks"), {"pretty": "true"}).alias("value"))
     .write.partitionBy("bucket").text(path))
    fx.spark.createDataFrame([("{\n  cut",)], "value string").withColumn("bucket", F.lit(-1)).write.mode("append").partitionBy("bucket").text(path)
    fx.ours.where((h >= "5") & (h < "a")).select(F.to_json(record).alias("value"), F.lit(-2).alias("bucket")).write.mode("append").partitionBy("bucket").text(path)
    fx.ours.where(h >= "a").select(
        F.upper("apk_hash").alias("SHA256"), F.when(short, c("raw_category")).otherwise(c("finding_name")).alias("title"),
        c("raw_category").alias("category"), F.when(short, "high").otherwise("medium").alias("severity")).write.option("header", True).csv(tables)
    # The files are told apart once for both readers.
    records = external.own_records(fx.spark, path)
    rows = external.read_own_results(fx.spark, path, records=records).unionByName(external.read_own_results(fx.spark, tables, "csv"))
    counts = rows.groupBy("apk_hash", "finding_category", "normalized_name", "severity").agg(F.count("*").alias("n"))
    bad = external.own_result_problems(fx.spark, path, records).groupBy("reason").agg(F.count("*").alias("n"))
    return counts.unionByName(bad.select(F.lit("problems").alias("apk_hash"), c("reason").alias("finding_category"),
                                         F.lit("").alias("normalized_name"), F.lit("").alias("severity"), "n"))


# --- admission ------------------------------------------------------------------------------------

_P = "replace(entry_name, chr(92), '/')"
_SAFE = f"(length({_P}) > 0 AND NOT starts_with({_P}, '/') AND substr({_P}, 2, 1) <> ':' AND NOT list_contains(string_split({_P}, '/'), '..'))"
_BOMB = "(compress_size > 0 AND file_size > 10485760 AND file_size::DOUBLE / nullif(compress_size, 0) > 200)"


@query("adm_1", f"SELECT entry_name, {_SAFE} AS safe, count(*) AS n FROM fx_entries GROUP BY 1, 2")
def adm_1(fx: Fixtures):
    return fx.entries.groupBy("entry_name", paths.is_safe_entry(c("entry_name")).alias("safe")).agg(F.count("*").alias("n"))


@query("adm_2", f"SELECT app_id, entry_seq, entry_name, file_size, compress_size FROM fx_entries WHERE {_BOMB}")
def adm_2(fx: Fixtures):
    return fx.entries.where(adm.is_compression_bomb(c("file_size"), c("compress_size")))


def _verdict_sql(max_entries: int, max_total: int) -> str:
    return f"""SELECT app_id, reason IS NULL AS admitted, reason FROM (SELECT app_id, CASE WHEN count(*) > {max_entries} THEN 'too many entries'
        WHEN min(bad_seq) IS NOT NULL THEN arg_min(why || ': ' || entry_name, bad_seq) WHEN sum(file_size) > {max_total} THEN 'uncompressed size too large'
        WHEN NOT bool_or(entry_name = 'AndroidManifest.xml' OR ends_with(entry_name, '.dex')) THEN 'no manifest or dex' END AS reason FROM (
        SELECT *, CASE WHEN why IS NOT NULL THEN entry_seq END AS bad_seq FROM (
            SELECT *, CASE WHEN NOT {_SAFE} THEN 'unsafe path' WHEN {_BOMB} THEN 'compression bomb' END AS why FROM fx_entries)) GROUP BY app_id)"""


@query("adm_3", _verdict_sql(10000, 524288000))
def adm_3(fx: Fixtures):
    return adm.admission_verdicts(fx.entries)


@query("adm_3_limits", _verdict_sql(6, 104857600))
def adm_3_limits(fx: Fixtures):
    return adm.admission_verdicts(fx.entries, limits=adm.Limits(entries=6, total_bytes=100 * adm.MIB))


_BIN = "(?:" + "|".join(s.replace(".", "\\.") for s in adm.BINARY_SUFFIXES) + ")$"


@query("adm_4", f"""SELECT 'archive' AS origin, app_id, entry_seq, entry_name FROM fx_entries WHERE {_SAFE} AND NOT regexp_matches(lower(entry_name), '{_BIN}')
        AND ((ends_with(entry_name, '.dex') AND file_size <= 52428800) OR (regexp_matches(entry_name, '\\.(json|properties|txt)$') AND file_size <= 5242880))
    UNION ALL SELECT 'source', app_id, entry_seq, entry_name FROM fx_entries WHERE regexp_matches(entry_name, '\\.(java|kt)$') AND file_size <= 5242880
    UNION ALL SELECT 'resource', app_id, entry_seq, entry_name FROM fx_entries WHERE regexp_matches(entry_name, '\\.(xml|json|properties|txt)$') AND file_size <= 5242880""")
def adm_4(fx: Fixtures):
    keep = lambda o: adm.harvestable(fx.entries, o).select(F.lit(o).alias("origin"), "app_id", "entry_seq", "entry_name")
    return fnd.concatenate([keep("archive"), keep("source"), keep("resource")])


@query("adm_5", "SELECT app_id, entry_seq, entry_name FROM fx_entries QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY entry_seq) <= 3")
def adm_5(fx: Fixtures):
    return adm.first_entries(fx.entries, 3).select("app_id", "entry_seq", "entry_name")


_RAW = """SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN '  ' ELSE filename END AS filename, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE package_name END AS package_name,
    CASE WHEN p_partkey % 23 = 0 THEN -1 ELSE file_size END AS file_size, CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 31 = 0 THEN 'xyz' ELSE sha256 END AS sha256
    FROM (SELECT *, CAST(app_id AS BIGINT) AS p_partkey FROM {0}) t"""


@query("dq_1", f"""SELECT k, CASE WHEN trim(coalesce(filename, '')) = '' THEN 'empty filename' WHEN trim(coalesce(package_name, '')) = '' THEN 'empty package_name'
    WHEN file_size < 0 THEN 'negative file_size' WHEN coalesce(sha256, '') = '' THEN 'empty sha256' WHEN NOT regexp_full_match(trim(sha256), '[0-9a-fA-F]{{64}}') THEN 'invalid sha256' END AS reject_reason
    FROM ({_RAW.format('fx_apps')})""")
def dq_1(fx: Fixtures):
    raw = fx.apps.withColumn("k", c("app_id").cast("bigint")).select(
        "k",
        F.when(c("k") % 17 == 0, "  ").otherwise(c("filename")).alias("filename"),
        F.when(c("k") % 19 != 0, c("package_name")).alias("package_name"),
        F.when(c("k") % 23 == 0, -1).otherwise(c("file_size")).alias("file_size"),
        F.when(c("k") % 29 == 0, "").when(c("k") % 31 == 0, "xyz").otherwise(c("sha256")).alias("sha256"))
    return adm.validate(raw, adm.app_reject_reason()).select("k", "reject_reason")


@query("dq_1_scans", """SELECT scan_id, CASE WHEN NOT (risk_score + (CASE WHEN k % 41 = 0 THEN 100.5 ELSE 0 END)) BETWEEN 0 AND 100 THEN 'score out of range'
    WHEN k % 43 = 0 THEN 'negative duration' WHEN k % 47 = 0 THEN 'completed before started' END AS reject_reason FROM fx_scans""")
def dq_1_scans(fx: Fixtures):
    raw = fx.scans.select(
        "scan_id", (c("risk_score") + F.when(c("k") % 41 == 0, 100.5).otherwise(0.0)).alias("risk_score"),
        F.when(c("k") % 43 == 0, -1.0).otherwise(c("duration")).alias("duration"),
        c("created_at").alias("started_at"),
        F.when(c("k") % 47 == 0, F.expr("created_at - INTERVAL 1 DAY")).otherwise(c("created_at")).alias("completed_at"))
    return adm.validate(raw, adm.scan_reject_reason()).select("scan_id", "reject_reason")


# --- sinks ----------------------------------------------------------------------------------------

_DAY = "concat(CAST(year(created_at) AS STRING), '-01-01')"


# What a stored row holds, as the same text in Spark and DuckDB.
_STORED = {
    "scans": "concat_ws('|', scan_id, app_id, CAST(risk_score AS STRING), risk_rating, status)",
    "findings": "concat_ws('|', scan_id, CAST(finding_seq AS STRING), rule_id, title, severity, evidence, location)",
    "permissions": "concat_ws('|', scan_id, permission)",
    "apps": "concat_ws('|', app_id, filename, sha256, package_name, app_name, version_name)",
}
_SUM_DUCK = "CAST(sum(CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)) AS BIGINT)"


@query("snk_1", f"""SELECT 'scans' AS tbl, {_DAY} AS created_date, count(*) AS n, {_SUM_DUCK.format(_STORED['scans'])} AS contents FROM fx_scans GROUP BY 2
    UNION ALL SELECT 'findings', {_DAY}, count(*), {_SUM_DUCK.format(_STORED['findings'].replace('scan_id', 'f.scan_id'))} FROM fx_scan_findings f JOIN fx_scans s ON f.scan_id = s.scan_id GROUP BY 2
    UNION ALL SELECT 'permissions', {_DAY}, count(*), {_SUM_DUCK.format(_STORED['permissions'].replace('scan_id', 'p.scan_id'))} FROM fx_scan_permissions p JOIN fx_scans s ON p.scan_id = s.scan_id GROUP BY 2
    UNION ALL SELECT 'apps', '2024-01-01', count(*), {_SUM_DUCK.format(_STORED['apps'])} FROM fx_scan_apps""")
def snk_1(fx: Fixtures):
    base = work_dir(fx.spark)
    day = F.expr(_DAY).alias("created_date")
    days = fx.scans.select("scan_id", day)
    sink.append_scan(base, {
        "apps": fx.scan_apps.withColumn("created_date", F.lit("2024-01-01")),
        "scans": fx.scans.withColumn("created_date", day),
        "permissions": fx.scan_permissions.join(days, "scan_id"),
        "findings": fx.scan_findings.join(days, "scan_id"),
    })
    stored = sink.read_scan_tables(fx.spark, base)
    contents = lambda n: F.sum(F.conv(F.substring(F.md5(F.expr(_STORED[n])), 1, 8), 16, 10).cast("bigint")).alias("contents")
    count = lambda n: stored[n].groupBy(c("created_date").cast("string").alias("created_date")).agg(
        F.count("*").alias("n"), contents(n)).select(F.lit(n).alias("tbl"), "created_date", "n", "contents")
    return fnd.concatenate([count(n) for n in ("scans", "findings", "permissions", "apps")])


@query("snk_2", "SELECT scan_id, CASE WHEN k % 3 = 0 THEN risk_score / 2 ELSE risk_score END AS risk_score FROM fx_scans")
def snk_2(fx: Fixtures):
    base = work_dir(fx.spark)
    day = F.expr(_DAY)
    fx.scans.withColumn("created_date", day).write.partitionBy("created_date").parquet(f"{base}/scans")
    changed = fx.scans.where("k % 3 = 0").withColumn("risk_score", c("risk_score") / 2).withColumn("created_date", day)
    sink.replace_scans(fx.spark, base, changed, work_dir(fx.spark))
    return fx.spark.read.parquet(f"{base}/scans").select("scan_id", "risk_score")


_CNT = lambda s: f"CASE WHEN ok THEN CAST(count(*) FILTER (f.severity = '{s}') AS VARCHAR) ELSE '' END"


@query("snk_3", f"""SELECT filename, package_name AS package, sha256 AS "SHA-256", replace(CAST(created_at AS VARCHAR), ' ', 'T') || '+00:00' AS "analysis timestamp",
    CASE WHEN ok THEN printf('%.1f', risk_score) ELSE '' END AS "risk score", CASE WHEN ok THEN risk_rating ELSE '' END AS "risk rating",
    {_CNT('CRITICAL')} AS "critical count", {_CNT('HIGH')} AS "high count", {_CNT('MEDIUM')} AS "medium count", {_CNT('LOW')} AS "low count",
    CASE WHEN ok OR duration > 0 THEN printf('%.2fs', duration) ELSE '' END AS "analysis duration"
    FROM (SELECT *, status = 'SUCCESS' AS ok FROM fx_scans) s JOIN fx_scan_apps a USING (app_id) LEFT JOIN fx_scan_findings f USING (scan_id)
    GROUP BY s.scan_id, filename, package_name, sha256, created_at, ok, risk_score, risk_rating, duration""")
def snk_3(fx: Fixtures):
    ok = c("status") == "SUCCESS"
    counts = fnd.severity_counts(fx.scan_findings.withColumnRenamed("scan_id", "app_id")).withColumnRenamed("app_id", "scan_id")
    items = fx.scans.join(fx.scan_apps.select("app_id", "filename", "package_name", "sha256"), "app_id").join(counts, "scan_id", "left").select(
        "filename", "package_name", "sha256", c("created_at").cast("timestamp").alias("completed_at"), F.when(ok, c("risk_score")).alias("risk_score"),
        F.when(ok, c("risk_rating")).alias("risk_rating"), "critical", "high", "medium", "low", "duration")
    path = work_dir(fx.spark)
    sink.write_csv(sink.batch_summary(items), path)
    back = fx.spark.read.option("header", "true").csv(path)
    return back.select(*[F.coalesce(c(f"`{n}`"), F.lit("")).alias(n) for n in back.columns])


def _stored_outcomes(fx: Fixtures):
    """Expected and found rules of each application, written once: records, totals and rule metrics all read them."""
    path = work_dir(fx.spark)
    ev.outcomes(fx.findings, _matched(fx)).write.parquet(path)
    return fx.spark.read.parquet(path)


@query("snk_5", MATCHED + SCORE.replace("WITH ", ", ", 1) + f"""SELECT a.app_id, coalesce(t.score, 0.0) AS risk_score, coalesce(d.rules, '') AS detected_rules,
    CAST(coalesce(p.n, 0) AS BIGINT) AS number_of_permissions, m.true_positives, m.false_positives, m.false_negatives, m.precision, m.recall, m.f1_score
    FROM fx_finding_apps a LEFT JOIN (SELECT app_id, count(*) AS n FROM fx_permissions GROUP BY 1) p USING (app_id) LEFT JOIN totals t USING (app_id) LEFT JOIN (SELECT app_id, string_agg(DISTINCT rule_id, ';' ORDER BY rule_id) AS rules FROM fx_findings GROUP BY 1) d USING (app_id)
    LEFT JOIN ({APP_METRICS}) m USING (app_id)""")
def snk_5(fx: Fixtures):
    base = work_dir(fx.spark)
    sets = _stored_outcomes(fx)
    flags = ev.confusion(sets)
    scores = scoring.app_scores(fx.findings, fx.finding_apps).select("app_id", c("score").alias("risk_score"), c("rating").alias("risk_rating"))
    perms = fx.permissions.groupBy("app_id").agg(F.count("*").alias("number_of_permissions"))
    records = ev.evaluation_records(scores, fnd.detected_sets(fx.findings), fnd.severity_counts(fx.findings), perms, ev.app_metrics(sets))
    sink.write_evaluation(records, ev.overall_metrics(flags), ev.rule_metrics(flags), base)
    schema = ("app_id string, risk_score double, detected_rules array<string>, number_of_permissions bigint, true_positives bigint, false_positives bigint, "
              "false_negatives bigint, precision double, recall double, f1_score double")
    back = fx.spark.read.schema(schema).json(f"{base}/apps")
    return back.withColumn("detected_rules", F.array_join("detected_rules", ";")).withColumn(
        "number_of_permissions", F.coalesce("number_of_permissions", F.lit(0)))


@query("snk_5_rules", MATCHED + f"""SELECT rule_id, true_positives, false_positives, false_negatives, precision, recall, f1_score FROM (
        SELECT *, {_PRF} FROM (SELECT rule_id, {_COUNTS} FROM flags GROUP BY 1))
    UNION ALL SELECT '', true_positives, false_positives, false_negatives, precision, recall, f1_score FROM (SELECT *, {_PRF} FROM (SELECT {_COUNTS} FROM flags))""")
def snk_5_rules(fx: Fixtures):
    """Metrics of each rule and, under an empty rule id, of the whole run, read back from the sink."""
    base = work_dir(fx.spark)
    sets = _stored_outcomes(fx)
    flags = ev.confusion(sets)
    sink.write_evaluation(sets.select("app_id"), ev.overall_metrics(flags), ev.rule_metrics(flags), base)
    metrics = ["true_positives", "false_positives", "false_negatives", "precision", "recall", "f1_score"]
    kinds = ["bigint"] * 3 + ["double"] * 3
    stored = lambda name, columns: fx.spark.read.schema(", ".join(columns)).json(f"{base}/{name}")
    rules = stored("rules", ["rule_id string", *(f"{m} {k}" for m, k in zip(metrics, kinds))])
    named = [("total_" if k == "bigint" else "overall_") + m for m, k in zip(metrics, kinds)]
    totals = stored("totals", [f"{n} {k}" for n, k in zip(named, kinds)])
    return rules.union(totals.select(F.lit("").alias("rule_id"), *named))


@query("snk_6", SIDES + f"SELECT *, 'ToolA, ToolB' AS comparison_tool FROM ({COMPARE})")
def snk_6(fx: Fixtures):
    ours, theirs = sides(fx)
    path = work_dir(fx.spark)
    sink.write_csv(sink.comparison_summary(cmp.comparison_rows(ours, theirs), cmp.tool_names(theirs)), path)
    ints = [n for n in sink.COMPARISON_COLUMNS if n.endswith("_count")]
    back = fx.spark.read.option("header", "true").csv(path)
    typed = {**{n: "bigint" for n in ints}, "finding_jaccard_similarity": "double", "category_jaccard_similarity": "double"}
    return back.select(*[F.coalesce(c(n), F.lit("")).cast(typed.get(n, "string")).alias(n) for n in back.columns])


def _report_scans(fx: Fixtures):
    scores = scoring.app_scores(fx.findings, fx.apps)
    return fx.apps.join(scores, "app_id").select(
        "*", F.concat(F.lit("scan-"), "app_id").alias("scan_id"), c("score").alias("risk_score"), c("rating").alias("risk_rating"),
        F.lit(1.5).alias("duration"), F.lit("0.1.0").alias("analyzer_version"), F.lit("2024-01-01").cast("timestamp").alias("completed_at"))


def _report(fx: Fixtures, make=reports.report_lines):
    classified = prm.classify_permissions(fx.permissions)
    return make(_report_scans(fx), fx.findings, fnd.severity_counts(fx.findings), classified, prm.permission_summary(classified))


def _report_steps(fx: Fixtures):
    """Report rows whose scores, counts and permissions are written first, a step each, so that their shuffles end before the rows move."""
    classified = step(prm.classify_permissions(fx.permissions))
    return reports.report_rows(step(_report_scans(fx)), fx.findings, step(fnd.severity_counts(fx.findings)), classified, step(prm.permission_summary(classified)))


_FIND_LINES = f"""SELECT app_id, 2 AS section, ordinal, unnest(ls) AS line FROM (SELECT app_id, ordinal, [
    '[' || severity || '] Finding #' || ordinal || ': ' || title, '  Rule ID:           ' || rule_id,
    '  Category:          ' || category, '  Confidence:        ' || confidence, CASE WHEN location IS NOT NULL THEN '  Location:          ' || location END,
    '  Evidence:          ' || evidence, ''] AS ls FROM (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY {_RANK}, rule_id, finding_seq) AS ordinal FROM fx_findings))"""
_PERM_LINES = """SELECT app_id, 4 AS section, perm_seq AS ordinal, unnest(['  * ' || permission || ' (' || protection_level || ', Risk: ' || risk_level || ')'
    || CASE WHEN family IS NOT NULL THEN ' [Family: ' || family || ']' ELSE '' END || CASE WHEN is_sensitive_user_data THEN ' [Accesses Sensitive User Data]' ELSE '' END,
    '    Description: ' || description]) AS line FROM full_cls"""


@query("snk_7", CLASSIFIED + f"SELECT * FROM ({_FIND_LINES}) WHERE line IS NOT NULL UNION ALL {_PERM_LINES}")
def snk_7(fx: Fixtures):
    prose = c("line").rlike("^  (Description|OWASP Reference|Potential Impact|Remediation): ")
    return _report(fx).where(c("section").isin(2, 4) & ~prose).select("app_id", "section", "ordinal", "line")


@query("snk_7_text")
def snk_7_text(fx: Fixtures):
    """The written report files, read back as lines."""
    path = work_dir(fx.spark)
    reports.write_reports(_report_steps(fx), path)
    return fx.spark.read.text(path).select(F.substring_index("value", "\t", 1).alias("app_id"), F.expr("substr(value, instr(value, chr(9)) + 1)").alias("line"))


@query("snk_8", "SELECT scan_id, finding_seq, rule_id, title, category, severity, confidence, evidence, location FROM fx_scan_findings")
def snk_8(fx: Fixtures):
    docs = reports.result_documents(fx.scan_findings, part_size=2)
    damaged = docs.withColumn("doc", F.when(F.pmod(F.xxhash64("scan_id"), F.lit(7)) != 0, c("doc")))
    path = work_dir(fx.spark)
    damaged.write.option("compression", "zstd").parquet(path)
    found = reports.findings_from_documents(fx.spark.read.parquet(path), fx.scan_findings)
    return found.withColumn("finding_seq", c("finding_seq").cast("bigint"))
