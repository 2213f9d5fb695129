"""Queries of the detection rules: manifest, permissions, text rules, SDKs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogs import (
    CATEGORY_DEFAULT_FAMILIES, PERMISSION_TO_FAMILY, PERMISSIONS, TRACKING_DOMAINS, TRACKING_INDICATORS,
)
from ..fixtures.views import Fixtures
from ..functions import text as tx, urls
from ..functions.urls import GENERIC_LABELS, PLATFORM_DOMAINS, SCHEMA_DOMAINS, SCHEMA_PATHS, TEST_HOSTS, TEST_SUFFIXES
from ..operators import permissions as prm
from ..operators.rules import manifest, patterns as P, sdk, text_scan
from ..operators.rules.catalog import INFO
from ..operators.rules.registry import Inputs, RuleRegistry
from .base import WS, query, quote

COLUMNS = ["app_id", "rule_id", "title", "category", "severity", "confidence", "evidence", "location"]


def shown(df):
    return df.select(*COLUMNS)


def _meta(rule_id: str, severity: str | None = None, confidence: str | None = None) -> str:
    info = INFO[rule_id]
    return (f"'{rule_id}' AS rule_id, '{info.category}' AS category, '{severity or info.severity}' AS severity, "
            f"'{confidence or info.confidence}' AS confidence")


# --- manifest rules -------------------------------------------------------------------------------

_LEVEL = "CASE WHEN regexp_full_match(trim(target_sdk), '[+-]?[0-9]+') THEN CAST(trim(target_sdk) AS INTEGER) END"
_APP_LOC = "'AndroidManifest.xml:<application>' AS location"


def _man(rule_id: str) -> str:
    return f"{_meta(rule_id)}, {quote(INFO[rule_id].title)} AS title, {_APP_LOC}"


_MAN_SQL = {
    "MAN-001": f"""SELECT app_id, {_man("MAN-001")}, 'android:debuggable="true" in <application>' AS evidence FROM fx_apps WHERE debuggable""",
    "MAN-002": f"""SELECT app_id, {_man("MAN-002")}, CASE WHEN allow_backup THEN 'android:allowBackup="true"'
        ELSE 'android:allowBackup not specified (defaults to true)' END || ' in <application>' AS evidence
        FROM fx_apps WHERE allow_backup IS NULL OR allow_backup""",
    "MAN-003": f"""SELECT app_id, {_meta("MAN-003")}, 'Cleartext Traffic Explicitly Permitted' AS title, {_APP_LOC},
        'android:usesCleartextTraffic="true" in <application>' AS evidence FROM fx_apps WHERE uses_cleartext_traffic
        UNION ALL SELECT app_id, {_meta("MAN-003", "MEDIUM", "MEDIUM")}, 'Cleartext Traffic Allowed by Default (Legacy Target SDK)', {_APP_LOC},
        'targetSdkVersion=' || ({_LEVEL}) || ' with unconfigured usesCleartextTraffic' FROM fx_apps
        WHERE uses_cleartext_traffic IS NULL AND ({_LEVEL}) < 28""",
    "MAN-004": f"""SELECT app_id, {_man("MAN-004")}, 'Missing ''android:networkSecurityConfig'' attribute in <application>' AS evidence
        FROM fx_apps WHERE ({_LEVEL}) >= 24 AND coalesce(network_security_config, '') = ''""",
}


def _exported(rule_id: str, tag: str, label: str, extra: str, note: str = "no permission") -> str:
    return f"""SELECT app_id, {_meta(rule_id)}, 'Exported {label} Unprotected: ' || regexp_extract(name, '[^.]*$') AS title,
        '{tag} android:name="' || name || '" android:exported="true" ({note})' AS evidence,
        'AndroidManifest.xml:<{tag} name="' || name || '">' AS location
        FROM fx_components WHERE component_type = '{tag}' AND exported AND coalesce(permission, '') = '' {extra}"""


_ACTION_WORDS = "|".join(manifest.SENSITIVE_ACTIONS)
_MATCHED = f"list_filter(actions, lambda a: regexp_matches(lower(a), '{_ACTION_WORDS}'))"
_COMP_SQL = {
    "MAN-005": _exported("MAN-005", "activity", "Activity", "AND NOT is_main_launcher"),
    "MAN-006": _exported("MAN-006", "service", "Service", ""),
    "MAN-007": _exported("MAN-007", "receiver", "Receiver", ""),
    "MAN-008": _exported("MAN-008", "provider", "Content Provider",
                         "AND coalesce(read_permission, '') = '' AND coalesce(write_permission, '') = ''", "unprotected"),
    "MAN-009": f"""SELECT app_id, {_meta("MAN-009")}, 'Sensitive Action Exposed: ' || regexp_extract(name, '[^.]*$') AS title,
        'Action(s): ' || array_to_string(list_slice({_MATCHED}, 1, 3), ', ') || ' on exported component ''' || name || '''' AS evidence,
        'AndroidManifest.xml:<' || component_type || ' name="' || name || '">' AS location
        FROM fx_components WHERE exported AND coalesce(permission, '') = '' AND len({_MATCHED}) > 0""",
}
_GROUPS = ", ".join(f"({quote(p)}, {i}, {quote(t)})" for i, (g, t) in enumerate(manifest.SENSITIVE_GROUPS) for p in g)
_PAIR_SQL = f"""SELECT app_id, {_meta("MAN-010")}, label || ': ' || regexp_extract(names, '[^.]*$') AS title,
    'INTERNET + ' || names AS evidence, 'AndroidManifest.xml:<uses-permission>' AS location FROM (
        SELECT p.app_id, g.label, string_agg(DISTINCT p.permission, ', ' ORDER BY p.permission) AS names
        FROM fx_permissions p JOIN (VALUES {_GROUPS}) g(permission, gid, label) USING (permission)
        WHERE p.app_id IN (SELECT app_id FROM fx_permissions WHERE permission = '{manifest.INTERNET}') GROUP BY 1, 2)"""

for _id, _sql in _MAN_SQL.items():
    query(_id.lower().replace("-", "_"), _sql)(
        lambda fx, r=_id: shown(manifest.manifest_findings(apps=fx.apps, rules=[r])))
for _id, _sql in _COMP_SQL.items():
    query(_id.lower().replace("-", "_"), _sql)(
        lambda fx, r=_id: shown(manifest.manifest_findings(components=fx.components, rules=[r])))
query("man_010", _PAIR_SQL)(lambda fx: shown(manifest.permission_combinations(fx.permissions)))


@query("j_7", f"SELECT app_id, count(*) AS components FROM fx_components WHERE app_id IN (SELECT app_id FROM fx_apps WHERE target_sdk IS NOT NULL) GROUP BY 1")
def j_7(fx: Fixtures):
    with_manifest = fx.apps.where("target_sdk IS NOT NULL")
    return manifest.with_manifest_only(fx.components, with_manifest).groupBy("app_id").agg(F.count("*").alias("components"))


# --- permissions ----------------------------------------------------------------------------------

_CAT = ", ".join(
    "(" + ", ".join(("true" if v else "false") if isinstance(v, bool) else quote(v) for v in row) + ")" for row in PERMISSIONS)
CLASSIFIED = f"""WITH cat AS (SELECT * FROM (VALUES {_CAT}) c(permission, family, protection_level, risk_level, description, user_desc, sensitive, leak)),
    cls AS (
        SELECT p.app_id, p.perm_seq, trim(p.permission) AS permission,
            c.permission IS NOT NULL AS known, starts_with(p.permission, 'android.permission.') AS platform,
            replace(p.permission, 'android.permission.', '') AS short,
            CASE WHEN c.permission IS NOT NULL THEN c.protection_level WHEN starts_with(p.permission, 'android.permission.') THEN 'normal' ELSE 'custom/unknown' END AS protection_level,
            coalesce(c.risk_level, 'INFO') AS risk_level, c.description AS cat_description, c.user_desc, c.leak, c.family,
            coalesce(c.sensitive, false) AS is_sensitive_user_data
        FROM fx_permissions p LEFT JOIN cat c ON c.permission = trim(p.permission) WHERE trim(p.permission) <> ''),
    full_cls AS (
        SELECT *, risk_level IN ('CRITICAL', 'HIGH') AS high,
            CASE WHEN known THEN cat_description WHEN platform THEN 'Standard Android platform permission (' || short || ').'
                ELSE 'Custom or proprietary permission defined outside standard Android specifications.' END AS description,
            CASE WHEN known AND risk_level IN ('CRITICAL', 'HIGH') THEN 'Heuristic indicator: Application requests high-privilege capability (' || cat_description || '). Static audit flags this permission for functional justification review.'
                WHEN known THEN CASE WHEN leak = '' THEN cat_description ELSE leak END
                WHEN platform THEN 'Standard Android operating system capability not catalogued as high-risk.'
                ELSE 'Heuristic assessment: Application defines or requests a proprietary non-standard permission.' END AS reason
        FROM cls)
    """


@query("prm_1", CLASSIFIED + """SELECT app_id, perm_seq, permission, protection_level, risk_level, description, reason, 'manifest' AS source,
    CASE WHEN known THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
    CASE WHEN NOT known THEN CASE WHEN platform THEN 'Standard operational permission' ELSE 'Custom/unknown permission' END
        WHEN is_sensitive_user_data THEN 'Permission associated with sensitive user data' WHEN high THEN 'Potentially excessive permission'
        WHEN contains(lower(protection_level), 'signature') THEN 'Sensitive permission'
        WHEN protection_level = 'normal' THEN 'Standard operational permission' ELSE 'Sensitive permission' END AS classification,
    CASE WHEN known THEN user_desc WHEN platform THEN 'Standard system feature permission: ' || short || '.'
        ELSE 'Custom permission (' || permission || '). Defined by app developers or device manufacturers.' END AS user_friendly_description,
    family, is_sensitive_user_data, CASE WHEN known THEN high ELSE NOT platform END AS is_heuristic_warning FROM full_cls""")
def prm_1(fx: Fixtures):
    return prm.classify_permissions(fx.permissions)


@query("prm_2", CLASSIFIED + """SELECT app_id, 'PERM-' || regexp_extract(permission, '[^.]*$') AS rule_id,
    'Sensitive Permission Declared: ' || regexp_extract(permission, '[^.]*$') AS title, 'PERMISSION' AS category, risk_level AS severity,
    CASE WHEN known THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, permission AS evidence, CAST(NULL AS VARCHAR) AS location FROM full_cls WHERE high""")
def prm_2(fx: Fixtures):
    return shown(prm.permission_findings(prm.classify_permissions(fx.permissions)))


@query("prm_3", CLASSIFIED + "SELECT app_id, permission, risk_level FROM full_cls WHERE high OR is_sensitive_user_data")
def prm_3(fx: Fixtures):
    return prm.dangerous_permissions(prm.classify_permissions(fx.permissions)).select("app_id", "permission", "risk_level")


@query("flt_2", CLASSIFIED + """SELECT app_id, permission FROM full_cls WHERE contains(
    lower(concat_ws(' ', permission, protection_level, risk_level, description, reason)), 'location')""")
def flt_2(fx: Fixtures):
    return prm.search_permissions(prm.classify_permissions(fx.permissions), " Location").select("app_id", "permission")


@query("ord_5", CLASSIFIED + """SELECT app_id, perm_seq, permission, risk_level FROM full_cls ORDER BY app_id,
    CASE risk_level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END, perm_seq""")
def ord_5(fx: Fixtures):
    return prm.order_by_risk(prm.classify_permissions(fx.permissions)).select("app_id", "perm_seq", "permission", "risk_level")


@query("agg_3", CLASSIFIED + """SELECT app_id, count(*) AS total_permissions,
    count(*) FILTER (contains(lower(protection_level), 'dangerous')) AS dangerous_permissions,
    count(*) FILTER (NOT contains(lower(protection_level), 'dangerous') AND contains(lower(protection_level), 'signature')) AS signature_permissions,
    count(*) FILTER (lower(protection_level) = 'normal') AS normal_permissions,
    count(*) FILTER (protection_level = 'custom/unknown') AS unknown_custom_permissions,
    count(*) FILTER (is_sensitive_user_data) AS sensitive_user_data_permissions,
    coalesce(string_agg(DISTINCT family, ';' ORDER BY family), '') AS sensitive_families FROM full_cls GROUP BY app_id""")
def agg_3(fx: Fixtures):
    s = prm.permission_summary(prm.classify_permissions(fx.permissions))
    return s.withColumn("sensitive_families", F.array_join("sensitive_families", ";"))


@query("j_1", CLASSIFIED + "SELECT app_id, permission, known, family FROM cls")
def j_1(fx: Fixtures):
    cat = F.broadcast(prm.permission_catalog(fx.spark)).select("permission", "family").withColumn("k", F.lit(True))
    declared = fx.permissions.select("app_id", tx.strip(F.col("permission")).alias("permission")).where("permission <> ''")
    return declared.join(cat, "permission", "left").select(
        "app_id", "permission", F.coalesce("k", F.lit(False)).alias("known"), "family")


_FAM = ", ".join(f"({quote(p)}, {quote(f)})" for p, f in PERMISSION_TO_FAMILY.items())
_FAM_ROWS = f"(SELECT p.app_id, f.family, p.permission FROM fx_permissions p JOIN (VALUES {_FAM}) f(permission, family) ON trim(p.permission) = f.permission)"


@query("j_2", f"SELECT app_id, family, permission FROM {_FAM_ROWS}")
def j_2(fx: Fixtures):
    return sdk.permission_families(fx.permissions).select("app_id", "family", "permission")


@query("agg_4", f"SELECT app_id, family, string_agg(permission, ', ' ORDER BY permission) AS permissions FROM {_FAM_ROWS} GROUP BY 1, 2")
def agg_4(fx: Fixtures):
    return sdk.family_map(fx.permissions).withColumn("permissions", F.array_join("permissions", ", "))


# --- text rules -----------------------------------------------------------------------------------


def _all(pattern: str, where: str = "true", group: int = 0) -> str:
    """Rows of all matches: app_id, target_seq, location, m, pos."""
    return f"""(SELECT app_id, target_seq, location, unnest(ms) AS m, generate_subscripts(ms, 1) AS pos FROM (
        SELECT app_id, target_seq, location, regexp_extract_all(text, {quote(pattern)}, {group}) AS ms FROM fx_artifacts WHERE {where}))"""


def _first(pattern: str, where: str = "true") -> str:
    return f"""(SELECT app_id, target_seq, location, regexp_extract(text, {quote(pattern)}) AS m, 1 AS pos FROM fx_artifacts
        WHERE regexp_matches(text, {quote(pattern)}) AND {where})"""


_SNIP = f"trim(m, {WS})"


# NET-003 as plain patterns; the operator's forms do not give comment lines back.
_EMPTY_SERVER_CHECK = r"void\s+checkServerTrusted\s*\([^)]*\)\s*\{\s*(?://[^\n]*\s*|/\*[^\n]*?\*/\s*)*\}"
_SMALI_SERVER_CHECK = (r"\.method\s+[^\n]*checkServerTrusted[^\n]*\n(?:\s*\.[a-zA-Z0-9_-]+[^\n]*\n)*"
                       r"\s*return-void\s*\n\s*\.end\s+method")


def _part(rule_id: str, part: int, source: str, title: str | None = None, evidence: str = _SNIP, key: str = _SNIP,
          confidence: str | None = None, where: str = "true", location: str = "location") -> str:
    t = quote(title if title is not None else INFO[rule_id].title)
    return f"""SELECT app_id, target_seq, {part} AS part, pos, location || ':' || {key} AS dkey, {_meta(rule_id, None, confidence)},
        {t} AS title, {evidence} AS evidence, {location} AS location FROM {source} WHERE {where}"""


def _dedupe(*parts: str) -> str:
    return f"""SELECT {", ".join(COLUMNS)} FROM ({" UNION ALL ".join(parts)})
        QUALIFY row_number() OVER (PARTITION BY app_id, dkey ORDER BY target_seq, part, pos) = 1"""


_RX = lambda g, p, s="m": f"regexp_extract({s}, {quote(p)}, {g})"


def _not_any(marks: list[str]) -> str:
    return " AND ".join(f"NOT contains(text, {quote(m)})" for m in marks)


_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _line_source(pattern: str, k: int) -> str:
    return f"""(SELECT app_id, target_seq, location, pos, m, array_to_string(list_slice(ls, greatest(pos - {k}, 1), pos + {k}), ' ') AS ctx FROM (
        SELECT app_id, target_seq, location, ls, unnest(ls) AS m, generate_subscripts(ls, 1) AS pos FROM (
            SELECT app_id, target_seq, location, string_split_regex(text, {quote(_LINES)}) AS ls FROM fx_artifacts WHERE regexp_matches(text, {quote(pattern)})))
        WHERE regexp_matches(m, {quote(pattern)}))"""


_WORD = _RX(0, P.SENSITIVE_WORD, "ctx")


def _near(rule_id: str, pattern: str) -> str:
    return _dedupe(_part(rule_id, 0, _line_source(pattern, 3), None, f"{_SNIP} || ' (keyword: ' || {_WORD} || ')'",
                         f"{_SNIP} || ':' || {_WORD}", None, f"{_WORD} <> ''", "location || ':line ' || pos"))


_CTX_WORD = "coalesce(" + ", ".join(f"CASE WHEN contains(lower(ctx), '{w}') THEN '{w}' END" for w in P.HASH_CONTEXT_WORDS) + ")"
_ALGO = f"upper({_RX(1, P.HASH_CALL)})"
_WEAK_HASH = f"""SELECT {", ".join(COLUMNS)} FROM (
    SELECT app_id, target_seq, pos, location || ':' || {_ALGO} || ':' || {_CTX_WORD} AS dkey, {_meta("CRY-005")},
        'Obsolete Hash Algorithm in Security Context: ' || {_ALGO} AS title,
        {_SNIP} || ' (context: ''' || {_CTX_WORD} || ''')' AS evidence, location || ':line ' || pos AS location
    FROM {_line_source(P.HASH_CALL, 5)} WHERE {_CTX_WORD} IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY app_id, dkey ORDER BY target_seq, pos) = 1"""


def _redact(v: str, p: int, s: int) -> str:
    return f"""CASE WHEN length({v}) <= {p + s} THEN CASE WHEN length({v}) <= 6 THEN '********' ELSE left({v}, 2) || '********' || right({v}, 2) END
        ELSE left({v}, {p}) || '********' || right({v}, {s}) END"""


def placeholder_sql(v: str) -> str:
    c = f"lower(trim({v}, {WS}))"
    subs = " OR ".join(f"contains({c}, '{x}')" for x in tx.PLACEHOLDER_SUBSTRINGS)
    return (f"(length({c}) < 8 OR {subs} OR regexp_matches({c}, {quote('|'.join(tx.PLACEHOLDER_PATTERNS))}) "
            f"OR len(list_distinct(string_split({c}, ''))) <= 2)")


def entropy_sql(v: str) -> str:
    return (f"(CASE WHEN length({v}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({v}, '')), lambda ch: "
            f"-((length({v}) - length(replace({v}, ch, '')))::DOUBLE / length({v})) * log2((length({v}) - length(replace({v}, ch, '')))::DOUBLE / length({v})))) END)")


def _secret(rule_id: str, part: int, label: str, pattern: str, keep: tuple[int, int], group: int = 0, entropy: bool = False) -> str:
    where = f"NOT {placeholder_sql('m')}" + (f" AND {entropy_sql('m')} > 2.8" if entropy else "")
    return _part(rule_id, part, _all(pattern, group=group), None, f"'{label}: ' || {_redact('m', *keep)}", "m", None, where)


_KEY_RED = f"CASE WHEN {_RX(1, P.KEY_SPEC)} <> '' THEN {_redact(_RX(1, P.KEY_SPEC), 2, 2)} ELSE '[STATIC_BYTE_ARRAY]' END"
_KEY_EV = f"""CASE WHEN {_RX(1, P.KEY_SPEC)} <> '' THEN 'new SecretKeySpec("' || {_KEY_RED} || '".getBytes(), "' || {_RX(3, P.KEY_SPEC)} || '")'
    ELSE 'new SecretKeySpec(new byte[] {{ ' || {_KEY_RED} || ' }}, "' || {_RX(3, P.KEY_SPEC)} || '")' END"""
# The check engine has no back-references: capture both names and compare them.
_ZERO_IV_2 = P.ZERO_IV.replace(r"\1", r"([a-zA-Z0-9_]+)")
_TABLE_WORD = _RX(0, P.SENSITIVE_WORD, _RX(1, P.CREATE_TABLE))

_HOST = "lower(regexp_extract(url, '(?i)^https?://([^/:?#]*)', 1))"
_PATH = "regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
URLS = f"""(SELECT *, {_HOST} AS host, {_PATH} AS path FROM (
    SELECT app_id, target_seq, location, pos, rtrim(m, {quote(urls.URL_TRAILING)}) AS url FROM {_all(urls.URL_PATTERN)}))"""


def domains_sql(host: str, domains: list[str]) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in domains) + ")"


SCHEMA_SQL = "(" + domains_sql("host", SCHEMA_DOMAINS) + " OR " + " OR ".join(f"contains(lower(url), '{s}')" for s in SCHEMA_PATHS) + ")"
TEST_SQL = ("(host IN (" + ", ".join(f"'{h}'" for h in TEST_HOSTS) + ") OR "
            + " OR ".join(f"ends_with(host, '{s}')" for s in TEST_SUFFIXES) + ")")
PLATFORM_SQL = domains_sql("host", PLATFORM_DOMAINS)
_DOMAINS = [d[0].lower() for d in TRACKING_DOMAINS]
_DOM_ROWS = "(VALUES " + ", ".join(f"('{d}')" for d in _DOMAINS) + ") t(domain)"
TOKENS_SQL = ("list_filter(string_split(lower(coalesce(package_name, '')), '.'), lambda p: length(p) >= 4 AND p NOT IN ("
              + ", ".join(f"'{g}'" for g in GENERIC_LABELS) + "))")

_NET_001 = f"""SELECT app_id, {_meta("NET-001")}, {quote(INFO["NET-001"].title)} AS title, 'Static URL: ' || url AS evidence, location
    FROM {URLS} WHERE starts_with(lower(url), 'http://') AND NOT {SCHEMA_SQL} AND NOT {TEST_SQL}
    QUALIFY row_number() OVER (PARTITION BY app_id, url ORDER BY target_seq, pos) = 1"""
_NET_002 = f"""SELECT app_id, {_meta("NET-002")}, 'Cleartext Traffic Permitted in Network Security Config' AS title,
    'cleartextTrafficPermitted="true"' AS evidence, location FROM fx_artifacts
    WHERE (contains(lower(location), 'network_security_config') OR contains(lower(location), 'res/xml')) AND regexp_matches(text, {quote(P.CLEARTEXT_CONFIG)})
    UNION ALL SELECT app_id, {_meta("NET-002")}, 'Cleartext Traffic Permitted in Manifest', 'android:usesCleartextTraffic="true" in <application>', {_APP_LOC}
    FROM fx_apps WHERE uses_cleartext_traffic"""
# Word test per domain: literal pattern, so it is a UNION over the catalog.
_WORDS = " UNION ALL ".join(
    f"SELECT app_id, target_seq, location, '{d}' AS domain FROM fx_artifacts WHERE contains(lower(text), '{d}') AND regexp_matches(text, '(?i)\\b"
    + d.replace(".", "\\.") + "\\b')" for d in _DOMAINS)
_NET_007 = f"""SELECT app_id, {_meta("NET-007")}, {quote(INFO["NET-007"].title)} AS title, evidence, location FROM (
    SELECT app_id, domain, target_seq, 0 AS part, pos, location, 'Static evidence: URL: ' || url || ' (matches ' || domain || ')' AS evidence
    FROM {URLS} JOIN {_DOM_ROWS} ON contains(host || path, domain)
    UNION ALL SELECT app_id, domain, target_seq, 1, 0, location, 'Static evidence: Domain string: ' || domain FROM ({_WORDS}))
    QUALIFY row_number() OVER (PARTITION BY app_id, domain ORDER BY target_seq, part, pos) = 1"""
_NET_008 = f"""SELECT app_id, {_meta("NET-008")}, {quote(INFO["NET-008"].title)} AS title, 'Static endpoint reference: ' || url AS evidence, location
    FROM {URLS} u LEFT JOIN (SELECT app_id, package_name FROM fx_apps) USING (app_id)
    WHERE host <> '' AND NOT {SCHEMA_SQL} AND NOT {TEST_SQL} AND NOT {PLATFORM_SQL} AND NOT {domains_sql("host", _DOMAINS)}
        AND NOT coalesce(list_bool_or(list_transform({TOKENS_SQL}, lambda t: contains(host, t))), false)
    QUALIFY row_number() OVER (PARTITION BY app_id, host ORDER BY target_seq, pos) = 1"""

_TEXT_SQL = {
    "NET-001": _NET_001,
    "NET-003": _dedupe(
        _part("NET-003", 0, _all(_EMPTY_SERVER_CHECK)),
        _part("NET-003", 1, _all(_SMALI_SERVER_CHECK), None, "'Smali return-void in checkServerTrusted'"),
        _part("NET-003", 2, _all(P.TRUST_ALL_CLASS), "Trust-All Certificate Manager Reference", "'Class reference: ' || m")),
    "NET-004": _dedupe(
        _part("NET-004", 0, _all(P.VERIFIER_CONSTANT), None, "'Verifier identifier: ' || m"),
        _part("NET-004", 1, _first(P.VERIFY_TRUE)), _part("NET-004", 2, _first(P.LAMBDA_TRUE))),
    "NET-005": _dedupe(
        _part("NET-005", 0, _first(P.SSL_PROCEED), "WebView SSL Error Bypass (handler.proceed)"),
        _part("NET-005", 1, _first(P.SSL_CONTEXT), "SSLContext Custom TrustManager Initialization")),
    "NET-006": _dedupe(*[_part("NET-006", i, _first(p), f"Insecure WebView Setting: {t}") for i, (t, _, p) in enumerate(P.WEBVIEW_SETTINGS)]),
    "NET-007": _NET_007,
    "STO-001": _dedupe(_part("STO-001", 0, _all(P.WORLD_MODE)), _part("STO-001", 1, _all(P.WORLD_MODE_NUMBER))),
    "STO-002": _near("STO-002", P.EXTERNAL_STORAGE),
    "STO-003": _dedupe(
        _part("STO-003", 0, _all(P.PREFERENCE_PUT, _not_any(P.ENCRYPTED_PREFERENCE_MARKS)),
              where=f"regexp_matches({_RX(1, P.PREFERENCE_PUT)}, {quote(P.SENSITIVE_WORD)})"),
        _part("STO-003", 1, _all(P.PREFERENCE_FILE, _not_any(P.ENCRYPTED_PREFERENCE_MARKS)), confidence="MEDIUM")),
    "STO-004": _dedupe(_part(
        "STO-004", 0, _all(P.CREATE_TABLE, _not_any(P.CIPHER_DATABASE_MARKS)), None,
        f"'Schema with ''' || {_TABLE_WORD} || ''': ' || {_SNIP}", _TABLE_WORD, None, f"{_TABLE_WORD} <> ''")),
    "STO-005": _dedupe(_part("STO-005", 0, _all(P.LOG_CALL), where=f"regexp_matches({_RX(1, P.LOG_CALL)}, {quote(P.SENSITIVE_WORD)})")),
    "STO-006": _near("STO-006", P.CACHE_STORAGE),
    "CRY-001": _dedupe(*[_part("CRY-001", i, _all(p), f"Broken / Deprecated Cipher: {n}") for i, (n, p) in enumerate(P.BROKEN_CIPHERS)]),
    "CRY-002": _dedupe(
        _part("CRY-002", 0, _all(P.EXPLICIT_ECB)),
        _part("CRY-002", 1, _all(P.BARE_AES), "Insecure Cipher Mode: Unspecified Mode Defaults to ECB")),
    "CRY-003": _dedupe(
        _part("CRY-003", 0, _all(P.INLINE_IV)),
        _part("CRY-003", 1, _all(_ZERO_IV_2), "Zero-Initialized Static IV Pattern",
              where=f"{_RX(1, _ZERO_IV_2)} = {_RX(2, _ZERO_IV_2)}")),
    "CRY-004": _dedupe(_part("CRY-004", 0, _all(P.KEY_SPEC), None, _KEY_EV, f"{_RX(3, P.KEY_SPEC)} || ':' || {_KEY_RED}")),
    "CRY-005": _WEAK_HASH,
    "CRY-006": _dedupe(
        _part("CRY-006", 0, _all(P.SET_SEED, "contains(text, 'SecureRandom')"), "Static Seed Configured on SecureRandom"),
        _part("CRY-006", 1, _all(P.UTIL_RANDOM), "Insecure java.util.Random Used in Security Context")),
    "SEC-001": _dedupe(_secret("SEC-001", 0, "Google API key", P.GOOGLE_KEY, (8, 3))),
    "SEC-002": _dedupe(_secret("SEC-002", 0, "AWS access key", P.AWS_KEY, (6, 2))),
    "SEC-003": _dedupe(_secret("SEC-003", 0, "GitHub token", P.GITHUB_TOKEN, (6, 3)), _secret("SEC-003", 1, "Slack token", P.SLACK_TOKEN, (6, 3))),
    "SEC-004": _dedupe(_secret("SEC-004", 0, "Token", P.TOKEN_ASSIGNMENT, (4, 3), 1, True)),
    "SEC-005": _dedupe(_secret("SEC-005", 0, "Password", P.PASSWORD_ASSIGNMENT, (2, 2), 1)),
    "SEC-006": _dedupe(_secret("SEC-006", 0, "Client secret", P.CLIENT_SECRET, (4, 3), 1)),
    "SEC-007": _dedupe(_secret("SEC-007", 0, "Connection password", P.CONNECTION_STRING, (2, 2), 1)),
    "SEC-008": _dedupe(_part("SEC-008", 0, _all(P.PRIVATE_KEY), None, "m", "m")),
}
for _id, _sql in _TEXT_SQL.items():
    query(_id.lower().replace("-", "_"), _sql)(lambda fx, r=_id: shown(text_scan.text_findings(fx.artifacts(), [r])))


@query("net_002", _NET_002)
def net_002(fx: Fixtures):
    return shown(text_scan.text_findings(fx.artifacts(), ["NET-002"]).unionByName(manifest.manifest_cleartext(fx.apps)))


@query("net_008", _NET_008)
def net_008(fx: Fixtures):
    return shown(text_scan.text_findings(fx.artifacts(), ["NET-008"], fx.apps))


@query("net_009", " UNION ALL ".join(
    f"""SELECT app_id, '{i}' AS indicator_id, {quote(n)} AS name, '{s}' AS severity, location FROM (
        SELECT * FROM fx_artifacts WHERE regexp_matches(text, {quote(p)})
        QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY target_seq) = 1)""" for i, n, p, s, _ in TRACKING_INDICATORS))
def net_009(fx: Fixtures):
    return text_scan.indicator_hits(fx.artifacts(), TRACKING_INDICATORS).drop("evidence")


@query("j_4", f"SELECT app_id, domain, count(DISTINCT url) AS urls FROM {URLS} JOIN {_DOM_ROWS} ON contains(host || path, domain) GROUP BY 1, 2")
def j_4(fx: Fixtures):
    url = urls.clean_url(F.col("raw"))
    distinct = fx.artifacts().select("app_id", F.explode(urls.extract_urls(F.col("text"))).alias("raw")).select(
        "app_id", url.alias("url")).distinct()
    spec = F.concat(urls.url_host(F.col("url")), urls.url_path(F.col("url")))
    hit = F.filter(F.array(*[F.lit(d) for d in _DOMAINS]), lambda d: F.contains(spec, d))
    return distinct.select("app_id", "url", F.explode(hit).alias("domain")).groupBy("app_id", "domain").agg(F.count("*").alias("urls"))


@query("j_6", f"""SELECT DISTINCT app_id, host FROM {URLS} WHERE host <> '' AND NOT {domains_sql("host", _DOMAINS)} AND NOT {PLATFORM_SQL}""")
def j_6(fx: Fixtures):
    url = urls.clean_url(F.col("raw"))
    hosts = fx.artifacts().select("app_id", F.explode(urls.extract_urls(F.col("text"))).alias("raw")).select(
        "app_id", urls.url_host(url).alias("host")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    # Every suffix of the host; equality with a listed domain is then a plain anti join.
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = fx.spark.createDataFrame([(d,) for d in [*_DOMAINS, *PLATFORM_DOMAINS]], "suffix string")
    known = (hosts.select("host").distinct().select("host", F.explode(suffixes).alias("suffix"))
             .join(F.broadcast(listed), "suffix", "left_semi").select("host"))
    return hosts.join(known, "host", "left_anti").select("app_id", "host")


@query("w_5", f"SELECT app_id, url, location FROM {URLS} QUALIFY row_number() OVER (PARTITION BY app_id, url ORDER BY target_seq, pos) = 1")
def w_5(fx: Fixtures):
    hits = fx.artifacts().select("app_id", "target_seq", "location", F.posexplode(urls.extract_urls(F.col("text"))).alias("pos", "raw"))
    first = F.min(F.struct("target_seq", "pos", "location")).alias("f")
    return hits.groupBy("app_id", urls.clean_url(F.col("raw")).alias("url")).agg(first).select("app_id", "url", "f.location")


@query("w_1", f"""SELECT doc_id, pos AS line_no, md5(array_to_string(list_slice(ls, greatest(pos - 3, 1), pos + 3), ' ')) AS context FROM (
    SELECT doc_id, ls, unnest(ls) AS m, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, {quote(_LINES)}) AS ls FROM documents))
    WHERE regexp_matches(m, '(?i)token|licen')""")
def w_1(fx: Fixtures):
    hits = text_scan.line_hits(F.col("text"), "(?i)token|licen", 3)
    return fx.table("documents").select("doc_id", F.explode(hits).alias("h")).select(
        "doc_id", F.col("h.line_no").cast("bigint").alias("line_no"), F.md5("h.context").alias("context"))


# --- SDKs -----------------------------------------------------------------------------------------

_SDK_ROWS = sdk.unique_sdks()
_DETECTED = "(" + " UNION ALL ".join(
    f"""SELECT app_id, {i} AS sdk_seq, {quote(r[1])} AS name, {quote(r[2])} AS category, kind, regexp_extract(text, {quote('(?i)' + r[3])}) AS matched
    FROM fx_candidates WHERE regexp_matches(text, {quote('(?i)' + r[3])}) QUALIFY row_number() OVER (PARTITION BY app_id ORDER BY cand_seq) = 1"""
    for i, r in enumerate(_SDK_ROWS)) + ")"
_SDK_FAM = ", ".join(f"({i}, '{f}')" for i, r in enumerate(_SDK_ROWS)
                     for f in dict.fromkeys(r[5] or CATEGORY_DEFAULT_FAMILIES.get(r[2], [])))


@query("sdk_001", f"""SELECT app_id, 'SDK-001' AS rule_id, 'TRACKING_SDK' AS category, 'INFO' AS severity, 'HIGH' AS confidence,
    'Third-Party SDK Detected: ' || name || ' (' || category || ')' AS title,
    'SDK: ' || name || ' (Category: ' || category || ', Matched: ' || matched || ' in ' || kind || ')' AS evidence, kind AS location FROM {_DETECTED}""")
def sdk_001(fx: Fixtures):
    return shown(sdk.sdk_findings(sdk.detected_sdks(fx.candidates())))


@query("j_5", f"SELECT app_id, name AS sdk_name, kind, matched FROM {_DETECTED}")
def j_5(fx: Fixtures):
    return sdk.detected_sdks(fx.candidates()).select("app_id", sdk._sdk_field(1, None).alias("sdk_name"), "kind", "matched")


_EXPOSED = f"""{_DETECTED} d JOIN (VALUES {_SDK_FAM}) sf(sdk_seq, family) USING (sdk_seq)
    JOIN (SELECT app_id, family, string_agg(permission, ', ' ORDER BY permission) AS perms FROM {_FAM_ROWS} GROUP BY 1, 2) p USING (app_id, family)"""
_TITLE_FAM = """array_to_string(list_transform(string_split(replace(family, '_', ' '), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"""


@query("sdk_002", f"""SELECT app_id, 'SDK-002' AS rule_id, 'SDK Permission Exposure: ' || name || ' with ' || {_TITLE_FAM} || ' Access' AS title,
    'TRACKING_SDK' AS category, 'MEDIUM' AS severity, 'MEDIUM' AS confidence,
    'SDK ''' || name || ''' (' || d.category || ') detected in ' || kind || ' + Host permissions: [' || perms || ']' AS evidence,
    kind || ':<uses-permission>' AS location FROM {_EXPOSED}""")
def sdk_002(fx: Fixtures):
    return shown(sdk.exposure_findings(sdk.detected_sdks(fx.candidates()), fx.permissions))


@query("j_3", f"SELECT app_id, name AS sdk_name, family, perms AS permissions FROM {_EXPOSED}")
def j_3(fx: Fixtures):
    d = sdk.sdk_families(sdk.detected_sdks(fx.candidates()))
    return d.join(sdk.family_map(fx.permissions), ["app_id", "family"]).select(
        "app_id", sdk._sdk_field(1, None).alias("sdk_name"), "family", F.array_join("permissions", ", ").alias("permissions"))


# --- registry and the whole audit -----------------------------------------------------------------


def fleet_inputs(fx: Fixtures) -> Inputs:
    return Inputs(fx.apps, fx.components, fx.permissions, fx.artifacts(), fx.candidates())


# What findings say, as one number that Spark and DuckDB agree on.
ROW_TEXT = "concat_ws('|', app_id, title, evidence, location)"
CONTENTS_DUCK = f"CAST(sum(CAST('0x' || substr(md5({ROW_TEXT}), 1, 8) AS BIGINT)) AS BIGINT) AS contents"


def contents():
    return F.sum(F.conv(F.substring(F.md5(F.expr(ROW_TEXT)), 1, 8), 16, 10).cast("bigint")).alias("contents")


@query("ext_2", f"SELECT rule_id, count(*) AS findings, {CONTENTS_DUCK} FROM (" + " UNION ALL ".join(
    f"SELECT app_id, rule_id, title, evidence, location FROM ({s})" for s in [_MAN_SQL["MAN-001"], _COMP_SQL["MAN-008"], _TEXT_SQL["CRY-002"], _TEXT_SQL["SEC-004"]]) + ") GROUP BY 1")
def ext_2(fx: Fixtures):
    registry = RuleRegistry()
    for rule in registry.all():
        rule.enabled = rule.rule_id in ("MAN-001", "MAN-008", "CRY-002", "SEC-004")
    return registry.run(fleet_inputs(fx)).groupBy("rule_id").agg(F.count("*").alias("findings"), contents())


@query("all_text_rules", f"SELECT rule_id, count(*) AS findings, count(DISTINCT app_id) AS apps, {CONTENTS_DUCK} FROM (" + " UNION ALL ".join(
    f"SELECT app_id, rule_id, title, evidence, location FROM ({s})" for s in [*_TEXT_SQL.values(), _NET_008, _NET_002.split("UNION ALL")[0]]) + ") GROUP BY 1")
def all_text_rules(fx: Fixtures):
    found = text_scan.text_findings(fx.artifacts(), None, fx.apps)
    per_app = found.groupBy("rule_id", "app_id").agg(F.count("*").alias("n"), contents())
    return per_app.groupBy("rule_id").agg(
        F.sum("n").alias("findings"), F.count("*").alias("apps"), F.sum("contents").alias("contents"))
