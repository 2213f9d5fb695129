"""Audit tables derived from the driver's tables.

Each view is one SQL text that both Spark and DuckDB read, so a query and its
check start from the same rows.  Sequence columns are arithmetic, never a
window, and every view is a projection (or a distinct) of one table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..catalogs import PERMISSIONS
from ..session import spread
from .snippets import SNIPPETS

# id, title, category of the rules that occur in the finding fixtures.
FX_RULES = [
    ("MAN-001", "Application Marked Debuggable", "MANIFEST_MISCONFIG"),
    ("MAN-005", "Exported Activity Unprotected: Home", "MANIFEST_MISCONFIG"),
    ("MAN-008", "Exported Content Provider Unprotected: Data", "MANIFEST_MISCONFIG"),
    ("NET-001", "Hardcoded Cleartext HTTP URL", "NETWORK_INDICATOR"),
    ("NET-008", "Embedded Third-Party Endpoint", "NETWORK_INDICATOR"),
    ("STO-001", "World-Readable or World-Writable Storage Mode", "STORAGE_INSECURITY"),
    ("STO-005", "Sensitive Data Logged to System Logs", "STORAGE_INSECURITY"),
    ("CRY-001", "Broken / Deprecated Cipher: DES", "CRYPTO_FLAW"),
    ("CRY-002", "Insecure ECB Cipher Mode", "CRYPTO_FLAW"),
    ("SEC-001", "Hardcoded Google API Key", "HARDCODED_SECRET"),
    ("SDK-001", "Third-Party SDK Detected: AppsFlyer (analytics)", "TRACKING_SDK"),
    ("PERM-CAMERA", "Sensitive Permission Declared: CAMERA", "PERMISSION"),
]
EXTRA_PERMISSIONS = ["android.permission.FOREGROUND_SERVICE", "com.vendor.permission.C2D_MESSAGE", "  "]
FX_PERMISSIONS = [p[0] for p in PERMISSIONS] + EXTRA_PERMISSIONS
FREE_CATEGORIES = [
    "Manifest Analysis", "Exported components", "misconfig", "Cleartext HTTP", "network security",
    "Insecure Storage", "world readable files", "Weak Crypto", "ECB mode", "Api Key leak", "Tracker", "Code quality",
]


def case(expr: str, values: list) -> str:
    body = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v + "'")
        for i, v in enumerate(values)
    )
    return f"CASE {expr} {body} END"


def _rule(expr: str, field: int) -> str:
    return case(expr, [r[field] for r in FX_RULES])


_HASH = "concat(md5({0}), md5(concat({0}, 's')))"
_APP = "CAST(l_orderkey - l_orderkey % 3 AS STRING)"
_QTY = "CAST(l_quantity AS BIGINT)"

VIEWS: dict[str, str] = {
    "fx_apps": f"""
        SELECT CAST(p_partkey AS STRING) AS app_id,
            concat('app', CAST(p_partkey AS STRING), '.apk') AS filename,
            {_HASH.format("CAST(p_partkey AS STRING)")} AS sha256,
            CAST(p_size AS BIGINT) * 1000 AS file_size,
            concat('com.', lower(replace(p_brand, '#', '')), '.app', CAST(p_partkey AS STRING)) AS package_name,
            CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_name END AS app_name,
            CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('1.', CAST(p_size AS STRING)) END AS version_name,
            CAST(p_partkey * 10 AS STRING) AS version_code,
            '16' AS min_sdk,
            CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'preview'
                 ELSE concat(CAST(16 + p_size % 20 AS STRING), ' ') END AS target_sdk,
            CASE p_partkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS allow_backup,
            CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS debuggable,
            CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS uses_cleartext_traffic,
            CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE '@xml/net' END AS network_security_config
        FROM {{part}}""",
    "fx_permissions": f"""
        SELECT DISTINCT CAST(l_partkey AS STRING) AS app_id,
            (l_suppkey + l_linenumber) % {len(FX_PERMISSIONS)} AS perm_seq,
            {case(f"(l_suppkey + l_linenumber) % {len(FX_PERMISSIONS)}", FX_PERMISSIONS)} AS permission
        FROM {{lineitem}}""",
    "fx_components": f"""
        SELECT CAST(l_partkey AS STRING) AS app_id,
            l_orderkey * 8 + l_linenumber AS comp_seq,
            {case("l_linenumber % 4", ["activity", "service", "receiver", "provider"])} AS component_type,
            concat('com.', CASE WHEN l_suppkey % 17 = 0 THEN 'facebook.ads.Ad' WHEN l_suppkey % 19 = 0
                THEN 'onesignal.Push' ELSE 'shop.ui.Part' END, CAST(l_suppkey % 50 AS STRING)) AS name,
            {case("l_orderkey % 5", ["true", "false", "1", None, " TRUE "])} AS exported_attr,
            l_suppkey % 2 = 0 AS has_intent_filter,
            CASE WHEN l_orderkey % 5 = 3 THEN l_suppkey % 2 = 0 ELSE l_orderkey % 5 <> 1 END AS exported,
            {case("l_suppkey % 3", [None, "", "com.shop.permission.GUARD"])} AS permission,
            CASE WHEN l_orderkey % 7 = 0 THEN 'com.shop.permission.READ' END AS read_permission,
            CASE WHEN l_orderkey % 11 = 0 THEN 'com.shop.permission.WRITE' END AS write_permission,
            l_linenumber % 4 = 0 AND l_suppkey % 10 = 0 AS is_main_launcher,
            CASE l_suppkey % 6 WHEN 0 THEN {{array}}('android.intent.action.MAIN')
                WHEN 1 THEN {{array}}('com.shop.action.LOGIN', 'android.intent.action.VIEW', 'com.shop.SYNC_NOW')
                WHEN 2 THEN {{array}}('com.shop.EXPORT', 'com.shop.UPLOAD', 'com.shop.backup', 'com.shop.RESET')
                ELSE {{array}}('android.intent.action.VIEW') END AS actions,
            l_suppkey AS k
        FROM {{lineitem}}""",
    "fx_entries": f"""
        SELECT CAST(l_orderkey AS STRING) AS app_id,
            l_linenumber * 100000000000 + l_partkey * 10000 + l_suppkey % 10000 AS entry_seq,
            {case("l_partkey % 90", [
                "../x", "C:/x", "", "a/../b.txt"] + [
                ["AndroidManifest.xml", "classes.dex", "assets/data.json", "res/icon.png", "lib/libx.so",
                 "conf/app.properties", "docs/readme.txt", "src/Main.java", "a\\b/notes.TXT".replace("\\", "/")][i % 9]
                for i in range(86)])} AS entry_name,
            CAST(floor(l_extendedprice * 600) AS BIGINT) AS file_size,
            CAST(floor(l_extendedprice * 600 / (1 + l_quantity * 4.2)) AS BIGINT) AS compress_size
        FROM {{lineitem}}""",
    "fx_findings": f"""
        SELECT {_APP} AS app_id,
            ((l_orderkey % 3) * 8 + l_linenumber) * 288230376151711744 + (l_partkey % 268435456) * 1073741824
                + (l_suppkey % 16777216) * 64 + {_QTY} AS finding_seq,
            {_rule("l_partkey % 12", 0)} AS rule_id,
            {_rule("l_partkey % 12", 1)} AS title,
            {_rule("l_partkey % 12", 2)} AS category,
            {case(f"{_QTY} % 5", ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"])} AS severity,
            CASE l_returnflag WHEN 'A' THEN 'HIGH' WHEN 'N' THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
            concat('e', CAST(l_suppkey % 3 AS STRING), CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '' END) AS evidence,
            CASE WHEN l_linestatus = 'O' THEN NULL ELSE concat('src/F', CAST(l_partkey % 2 AS STRING), '.java') END AS location
        FROM {{lineitem}}""",
    "fx_finding_apps": f"""
        SELECT DISTINCT {_APP} AS app_id,
            l_orderkey - l_orderkey % 3 AS k,
            concat('App', {_APP}, '.APK ') AS filename,
            {_HASH.format(_APP)} AS sha256,
            concat('com.corp.app', {_APP}) AS package_name
        FROM {{lineitem}}""",
    "fx_truth": f"""
        SELECT gt_key, {{array}}({_rule("k % 12", 0)}, {_rule("(k + 5) % 12", 0)}, {_rule("(k + 10) % 12", 0)}) AS expected_rules
        FROM (
            SELECT lower(trim(filename)) AS gt_key, k FROM fx_finding_apps WHERE k % 5 IN (0, 3)
            UNION ALL SELECT sha256, k + 1 FROM fx_finding_apps WHERE k % 5 IN (1, 3)
            UNION ALL SELECT package_name, k + 2 FROM fx_finding_apps WHERE k % 5 IN (2, 3)
        ) t""",
    "fx_ours": f"""
        SELECT {_HASH.format(_APP)} AS apk_hash, {_rule("l_partkey % 12", 2)} AS raw_category,
            {_rule("l_partkey % 12", 1)} AS finding_name, 'HIGH' AS severity
        FROM {{lineitem}}""",
    "fx_external": f"""
        SELECT CASE WHEN l_suppkey % 2 = 0 THEN upper({_HASH.format(_APP)}) ELSE {_HASH.format(_APP)} END AS apk_hash,
            {case("l_suppkey % 2", ["ToolA", "ToolB"])} AS tool,
            {case("l_partkey % 12", FREE_CATEGORIES)} AS finding_category,
            CASE WHEN l_suppkey % 3 = 0 THEN upper(replace({_rule("l_partkey % 12", 1)}, ' ', '_'))
                 WHEN l_suppkey % 3 = 1 THEN {_rule("l_partkey % 12", 1)} ELSE concat('Other issue ', CAST(l_linenumber AS STRING)) END AS finding_name,
            {case("l_linenumber % 3", ["high", "", "Low "])} AS severity
        FROM {{lineitem}}""",
    "fx_scans": """
        SELECT CAST(o_orderkey AS STRING) AS scan_id, CAST(o_custkey AS STRING) AS app_id,
            CAST(o_orderkey * 37 % 1001 AS DOUBLE) / 10 AS risk_score,
            CASE WHEN o_orderkey * 37 % 1001 >= 800 THEN 'CRITICAL' WHEN o_orderkey * 37 % 1001 >= 600 THEN 'HIGH'
                WHEN o_orderkey * 37 % 1001 >= 400 THEN 'MEDIUM' WHEN o_orderkey * 37 % 1001 >= 200 THEN 'LOW'
                ELSE 'MINIMAL' END AS risk_rating,
            CAST(o_orderkey % 977 AS DOUBLE) / 100 AS duration,
            '0.1.0' AS analyzer_version,
            o_orderdate AS created_at,
            CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status,
            o_orderkey AS k
        FROM {orders}""",
    "fx_scan_apps": f"""
        SELECT CAST(c_custkey AS STRING) AS app_id, concat(lower(replace(c_name, '#', '-')), '.apk') AS filename,
            {_HASH.format("CAST(c_custkey - c_custkey % 3 AS STRING)")} AS sha256,
            concat('com.', lower(c_mktsegment), '.c', CAST(c_custkey AS STRING)) AS package_name,
            CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('Client ', CAST(c_custkey AS STRING)) END AS app_name,
            CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '2.0' END AS version_name,
            CAST(c_custkey AS STRING) AS version_code,
            CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS analyzed_at
        FROM {{customer}}""",
    "fx_scan_findings": f"""
        SELECT CAST(l_orderkey AS STRING) AS scan_id,
            l_linenumber * 288230376151711744 + (l_partkey % 268435456) * 1073741824
                + (l_suppkey % 16777216) * 64 + {_QTY} AS finding_seq,
            {_rule("l_partkey % 12", 0)} AS rule_id,
            {_rule("l_partkey % 12", 1)} AS title,
            {_rule("l_partkey % 12", 2)} AS category,
            {case(f"{_QTY} % 5", ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"])} AS severity,
            'HIGH' AS confidence, concat('e', CAST(l_suppkey AS STRING)) AS evidence,
            CASE WHEN l_linestatus = 'O' THEN NULL ELSE 'src/A.java' END AS location
        FROM {{lineitem}}""",
    "fx_scan_permissions": f"""
        SELECT CAST(l_orderkey AS STRING) AS scan_id, {case(f"l_partkey % {len(FX_PERMISSIONS)}", FX_PERMISSIONS)} AS permission
        FROM {{lineitem}}""",
    "fx_names": """
        SELECT p_partkey AS k, CASE p_partkey % 12
            WHEN 0 THEN concat('..', chr(92), 'dir/', p_name, '.apk') WHEN 1 THEN concat('/abs/', p_name)
            WHEN 2 THEN 'CON.apk' WHEN 3 THEN concat('a..b...', p_name, '. ') WHEN 4 THEN concat(chr(7), p_name, chr(9), 'x', chr(10))
            WHEN 5 THEN '..' WHEN 6 THEN concat('lpt1.', CAST(p_partkey AS STRING)) WHEN 7 THEN ''
            WHEN 8 THEN concat('C:', chr(92), p_name, '.apk') WHEN 9 THEN NULL
            WHEN 10 THEN concat('dir/', p_name, chr(127), '.tar.gz') ELSE concat(p_name, '.apk') END AS name
        FROM {part}""",
    "fx_values": """
        SELECT p_partkey AS k, CASE p_partkey % 9
            WHEN 0 THEN md5(p_name) WHEN 1 THEN concat('your_api_key_', md5(p_name)) WHEN 2 THEN 'aaaaaaaaaaaa'
            WHEN 3 THEN 'abababababab' WHEN 4 THEN substr(md5(p_name), 1, 5) WHEN 5 THEN concat(' ', substr(md5(p_name), 1, 11), chr(10))
            WHEN 6 THEN concat('Test-Key', p_name) WHEN 7 THEN 'x' ELSE p_name END AS v
        FROM {part}""",
    "fx_kv": """
        SELECT p_partkey AS k, CASE p_partkey % 6
            WHEN 0 THEN concat('user=x password = "', p_name, '", token:ab;')
            WHEN 1 THEN concat('client_secret=', md5(p_name), ' and api_key: ', chr(39), 'k12', chr(39))
            WHEN 2 THEN concat('AKIA', upper(substr(md5(p_name), 1, 16)), ' secret=abcde')
            WHEN 3 THEN concat('ghp_', md5(p_name), substr(md5(p_type), 1, 8), ', xoxb-', md5(p_type))
            WHEN 4 THEN concat('AIza', md5(p_name), ' TOKEN =', chr(10), ' abcd,Password:1234')
            ELSE concat(p_name, ' has no secrets') END AS txt
        FROM {part}""",
    "fx_batch": f"""
        SELECT CAST(event_id AS STRING) AS item_id, CAST(user_id AS STRING) AS app_id, ts AS event_time,
            CASE event_type WHEN 'view' THEN 'Waiting' WHEN 'click' THEN 'Analyzing' WHEN 'purchase' THEN 'Complete'
                WHEN 'error' THEN 'Failed' ELSE 'Cancelled' END AS status,
            {_HASH.format("CAST(user_id AS STRING)")} AS sha256, event_id AS k, user_id, value, props
        FROM {{events}}""",
}

# Forms of views for Spark alone, with the rows of `VIEWS`: what follows from the key is made after the rows are distinct,
# so that the key moves alone, and three unions over one table are one pass over it.
SPARK_VIEWS = {
    **VIEWS,
    "fx_finding_apps": VIEWS["fx_finding_apps"].replace("SELECT DISTINCT", "SELECT").replace("{lineitem}", "(SELECT DISTINCT l_orderkey - l_orderkey % 3 AS k FROM {lineitem}) d").replace(
        "l_orderkey - l_orderkey % 3 AS k,", "k,", 1).replace(_APP, "CAST(k AS STRING)"),
    "fx_truth": f"""
        SELECT e.gt_key, array({_rule("e.k % 12", 0)}, {_rule("(e.k + 5) % 12", 0)}, {_rule("(e.k + 10) % 12", 0)}) AS expected_rules
        FROM (
            SELECT explode(filter(array(
                CASE WHEN k % 5 IN (0, 3) THEN named_struct('gt_key', lower(trim(filename)), 'k', k) END,
                CASE WHEN k % 5 IN (1, 3) THEN named_struct('gt_key', sha256, 'k', k + 1) END,
                CASE WHEN k % 5 IN (2, 3) THEN named_struct('gt_key', package_name, 'k', k + 2) END), x -> x IS NOT NULL)) AS e
            FROM fx_finding_apps) t""",
}

# Row identity of the tables whose scans do real work per row.
ROW_KEYS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    "documents": ["doc_id"],
}

_DOC_APP = "CAST(doc_id - doc_id % 4 AS STRING)"
_DOC_SNIPPET = f"CAST((doc_id - doc_id % 2) / 2 AS BIGINT) % {len(SNIPPETS)}"
_NAME = re.compile(r"\bfx_\w+")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _duckdb_artifacts() -> str:
    rows = ",\n".join(f"({i}, {_quote(l)}, {_quote(s)})" for i, (l, s) in enumerate(SNIPPETS))
    return f"""
        SELECT {_DOC_APP} AS app_id, doc_id % 4 AS target_seq, s.location, d.text || chr(10) || s.snippet AS text
        FROM documents d JOIN (VALUES {rows}) s(i, location, snippet) ON s.i = {_DOC_SNIPPET}"""


_KIND = 2**40
_COMP_KINDS = "CASE component_type WHEN 'activity' THEN {0} WHEN 'service' THEN {1} WHEN 'receiver' THEN {2} ELSE {3} END"


def _duckdb_candidates() -> str:
    seq = _COMP_KINDS.format(*[n * _KIND for n in (2, 3, 4, 5)])
    kind = _COMP_KINDS.format("'Activities'", "'Services'", "'Receivers'", "'Providers'")
    return f"""
        SELECT app_id, {seq} + comp_seq AS cand_seq, {kind} AS kind, name AS text FROM fx_components
        UNION ALL SELECT app_id, {8 * _KIND} + target_seq * 2, 'FilePath', location FROM fx_artifacts
        UNION ALL SELECT app_id, {8 * _KIND} + target_seq * 2 + 1, location, text FROM fx_artifacts"""


def duckdb_views() -> dict[str, str]:
    class Names(dict):
        def __missing__(self, key: str) -> str:
            return key

    out = {n: sql.format_map(Names(array="list_value")) for n, sql in VIEWS.items()}
    out["fx_artifacts"] = _duckdb_artifacts()
    out["fx_candidates"] = _duckdb_candidates()
    return out


def with_views(body: str, views: dict[str, str] | None = None) -> str:
    """Prefix a DuckDB query with the fixture views it names, in dependency order."""
    views = views or duckdb_views()
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in views and name not in needed:
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed)
    stripped = body.strip()
    return head + (",\n" + stripped[5:] if stripped[:5].upper() == "WITH " else "\n" + stripped)


class Fixtures:
    """The same views as Spark DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        path = f"{self.sf_dir}/{name}.parquet"
        df = self.spark.read.parquet(path)
        return spread(df, *ROW_KEYS[name]) if name in ROW_KEYS else df

    def view(self, name: str) -> DataFrame:
        spark, fixtures = self.spark, self

        class Paths(dict):
            def __missing__(self, key: str) -> str:
                name = f"source_{key}_{abs(hash(fixtures.sf_dir))}"
                fixtures.table(key).createOrReplaceTempView(name)
                return name

        needed = with_views(f"SELECT * FROM {name}", SPARK_VIEWS)
        return spark.sql(needed.format_map(Paths(array="array")))

    def artifacts(self) -> DataFrame:
        docs = self.table("documents")
        index = F.expr(f"CAST({_DOC_SNIPPET} AS INT)") + 1
        pick = lambda field: F.element_at(F.array(*[F.lit(s[field]) for s in SNIPPETS]), index)
        return docs.select(
            F.expr(_DOC_APP).alias("app_id"),
            F.expr("doc_id % 4").alias("target_seq"),
            pick(0).alias("location"),
            F.concat("text", F.lit("\n"), pick(1)).alias("text"),
        )

    def candidates(self) -> DataFrame:
        from ..sources.targets import sdk_candidates

        return sdk_candidates(components=self.view("fx_components"), artifacts=self.artifacts())

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.view(f"fx_{name}")
