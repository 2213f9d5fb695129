"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalogs import CANONICAL_CATEGORIES, CATEGORY_PATTERNS
from ..fixtures.views import Fixtures
from ..functions import classify, metrics as M, paths, text as tx, urls
from ..functions.paths import RESERVED_STEMS
from .base import WS, query, quote
from .findings import _BAND, _DISPLAY_OF, _RANK
from .rules import PLATFORM_SQL, SCHEMA_SQL, TEST_SQL, TOKENS_SQL, URLS, _LEVEL, _redact, entropy_sql, placeholder_sql

c = F.col
_RESERVED = ", ".join(f"'{r}'" for r in RESERVED_STEMS)


def _stem(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '.+\\.[^.]+') THEN regexp_replace({x}, '\\.[^.]*$', '') ELSE {x} END"


_CLEAN = f"regexp_replace(trim(trim(list_extract(string_split(replace(regexp_replace(name, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g'), chr(92), '/'), '/'), -1), {WS}), '. '), '\\.\\.+', '', 'g')"


@query("fn_1", f"""SELECT k, CASE WHEN coalesce(cl, '') = '' THEN 'unnamed.apk' WHEN upper({_stem("cl")}) IN ({_RESERVED}) THEN 'safe_' || cl ELSE cl END AS safe_name
    FROM (SELECT k, {_CLEAN} AS cl FROM fx_names)""")
def fn_1(fx: Fixtures):
    return fx.names.select("k", paths.sanitize_filename(c("name")).alias("safe_name"))


@query("fn_2", "SELECT k, regexp_replace(name, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g') AS name FROM fx_names")
def fn_2(fx: Fixtures):
    return fx.names.select("k", tx.strip_controls(c("name")).alias("name"))


_ESCAPED = "replace(replace(text, chr(13), '\\r'), chr(10), '\\n')"
for _i in [*range(1, 9), *range(0x0B, 0x20), 0x7F]:
    _ESCAPED = f"replace({_ESCAPED}, chr({_i}), '\\x{_i:02x}')"


@query("fn_3", f"SELECT doc_id, md5({_ESCAPED}) AS escaped FROM (SELECT doc_id, text || chr(1) || chr(27) || chr(9) AS text FROM documents)")
def fn_3(fx: Fixtures):
    text = F.concat("text", F.lit("\x01\x1b\t"))
    return fx.table("documents").select("doc_id", F.md5(tx.escape_controls(text)).alias("escaped"))


@query("fn_4", f"""SELECT app_id, target_seq, m AS url, pos FROM (SELECT app_id, target_seq, unnest(ms) AS m, generate_subscripts(ms, 1) - 1 AS pos
    FROM (SELECT app_id, target_seq, regexp_extract_all(text, {quote(urls.URL_PATTERN)}) AS ms FROM fx_artifacts))""")
def fn_4(fx: Fixtures):
    return fx.artifacts().select("app_id", "target_seq", F.posexplode(urls.extract_urls(c("text"))).alias("pos", "url")).select(
        "app_id", "target_seq", "url", c("pos").cast("bigint").alias("pos"))


def _urls(fx: Fixtures):
    rows = fx.artifacts().select("app_id", F.explode(urls.extract_urls(c("text"))).alias("raw"))
    url = urls.clean_url(c("raw"))
    return rows.select("app_id", url.alias("url"), urls.url_host(url).alias("host"), urls.url_path(url).alias("path")).distinct()


@query("fn_5", f"SELECT DISTINCT app_id, url FROM {URLS}")
def fn_5(fx: Fixtures):
    return _urls(fx).select("app_id", "url").distinct()


@query("fn_6", "SELECT page_id, lower(regexp_extract(url, '(?i)^https?://([^/:?#]*)', 1)) AS host, "
       "regexp_replace(regexp_extract(url, '(?i)^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path FROM pages")
def fn_6(fx: Fixtures):
    return fx.table("pages").select("page_id", urls.url_host(c("url")).alias("host"), urls.url_path(c("url")).alias("path"))


for _name, _sql, _fn in (
    ("fn_7", SCHEMA_SQL, lambda: urls.is_schema_url(c("url"), c("host"))),
    ("fn_8", TEST_SQL, lambda: urls.is_test_host(c("host"))),
    ("fn_9", PLATFORM_SQL, lambda: urls.is_platform_host(c("host"))),
):
    query(_name, f"SELECT DISTINCT app_id, url, {_sql} AS flag FROM {URLS}")(
        lambda fx, f=_fn: _urls(fx).select("app_id", "url", f().alias("flag")))


@query("fn_10", f"""SELECT app_id, array_to_string(list_sort(list_distinct({TOKENS_SQL})), ' ') AS tokens,
    coalesce(list_bool_or(list_transform({TOKENS_SQL}, lambda t: contains(lower('cdn.' || package_name || '.net'), t))), false) AS own FROM fx_apps""")
def fn_10(fx: Fixtures):
    host = F.lower(F.concat(F.lit("cdn."), "package_name", F.lit(".net")))
    tokens = F.array_join(F.array_sort(urls.first_party_tokens(c("package_name"))), " ")
    return fx.apps.select("app_id", tokens.alias("tokens"), urls.is_first_party(host, c("package_name")).alias("own"))


@query("fn_11", f"SELECT k, round({entropy_sql('v')}, 6) AS entropy FROM fx_values")
def fn_11(fx: Fixtures):
    return fx.view("fx_values").select("k", F.round(tx.shannon_entropy(c("v")), 6).alias("entropy"))


@query("fn_12", f"SELECT k, {placeholder_sql('v')} AS placeholder FROM fx_values")
def fn_12(fx: Fixtures):
    return fx.view("fx_values").select("k", tx.is_placeholder(c("v")).alias("placeholder"))


@query("fn_13", f"SELECT k, {_redact('t', 8, 3)} AS wide, {_redact('t', 2, 2)} AS narrow FROM (SELECT k, trim(v, {WS}) AS t FROM fx_values)")
def fn_13(fx: Fixtures):
    return fx.view("fx_values").select("k", tx.redact_secret(c("v")).alias("wide"), tx.redact_secret(c("v"), 2, 2).alias("narrow"))


_RED = "txt"
for _p in tx.TOKEN_MASKS:
    _RED = f"regexp_replace({_RED}, {quote(_p)}, '\\1********\\2', 'g')"
_V = "[^\"'\\s,;]"
_RED = f"regexp_replace({_RED}, {quote(tx.KEY_VALUE_HEAD + f'({_V}{{2}}){_V}+({_V}{{2}})')}, '\\1\\2\\3\\4********\\5', 'g')"
# No look-ahead in the check engine: take the delimiter along and put it back.
_DELIM = "([\"'\\s,;]|$)"
_RED = f"regexp_replace({_RED}, {quote(tx.KEY_VALUE_HEAD + f'{_V}{{1,4}}' + _DELIM)}, '\\1\\2\\3********\\4', 'g')"


@query("fn_14", f"""SELECT 'kv' AS src, k, {_RED} AS masked FROM fx_kv
    UNION ALL SELECT 'doc', doc_id, md5({_RED}) FROM (SELECT doc_id, text AS txt FROM documents)""")
def fn_14(fx: Fixtures):
    kv = fx.view("fx_kv").select(F.lit("kv").alias("src"), "k", tx.redact_text(c("txt")).alias("masked"))
    docs = fx.table("documents").select(F.lit("doc"), "doc_id", F.md5(tx.redact_text(c("text"))))
    return kv.union(docs)


_LOGRED = "txt"
for _p in tx.LOG_PATTERNS:
    _LOGRED = f"regexp_replace({_LOGRED}, {quote(_p)}, '[REDACTED_SECRET]', 'g')"


@query("fn_15", f"""SELECT 'kv' AS src, k, {_LOGRED} AS masked FROM fx_kv
    UNION ALL SELECT 'doc', doc_id, md5({_LOGRED}) FROM (SELECT doc_id, text AS txt FROM documents)""")
def fn_15(fx: Fixtures):
    kv = fx.view("fx_kv").select(F.lit("kv").alias("src"), "k", tx.redact_for_log(c("txt")).alias("masked"))
    docs = fx.table("documents").select(F.lit("doc"), "doc_id", F.md5(tx.redact_for_log(c("text"))))
    return kv.union(docs)


@query("fn_16", f"SELECT app_id, finding_seq, {_RANK} AS severity_rank FROM fx_findings")
def fn_16(fx: Fixtures):
    return fx.findings.select("app_id", "finding_seq", classify.severity_rank(c("severity")).alias("severity_rank"))


@query("fn_17", f"SELECT scan_id, {_BAND.format('risk_score')} AS rating FROM fx_scans")
def fn_17(fx: Fixtures):
    return fx.scans.select("scan_id", classify.rating_band(c("risk_score")).alias("rating"))


@query("fn_18", "SELECT scan_id, CASE risk_rating WHEN 'MINIMAL' THEN 'INFO' ELSE risk_rating END AS level FROM fx_scans")
def fn_18(fx: Fixtures):
    return fx.scans.select("scan_id", classify.rating_level(c("risk_rating")).alias("level"))


@query("fn_19", f"SELECT category, {_DISPLAY_OF} AS shown, count(*) AS n FROM fx_findings GROUP BY 1, 2")
def fn_19(fx: Fixtures):
    return fx.findings.groupBy("category", classify.display_category(c("category")).alias("shown")).agg(F.count("*").alias("n"))


CANON = ", ".join(f"'{x}'" for x in CANONICAL_CATEGORIES)


def canonical_sql(x: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({x}, {quote(p)}) THEN '{n}'" for p, n in CATEGORY_PATTERNS)
    up = f"upper(trim({x}, {WS}))"
    return f"CASE WHEN coalesce({up}, '') = '' THEN 'OTHER' WHEN {up} IN ({CANON}) THEN {up} {whens} ELSE 'OTHER' END"


def name_sql(x: str) -> str:
    return f"coalesce(trim(regexp_replace(regexp_replace(lower({x}), '[^a-zA-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"


@query("fn_20", f"""SELECT raw, {canonical_sql('raw')} AS category, count(*) AS n FROM (
    SELECT finding_category AS raw FROM fx_external UNION ALL SELECT category FROM fx_findings UNION ALL SELECT lower(category) || ' ' FROM fx_findings) GROUP BY 1, 2""")
def fn_20(fx: Fixtures):
    raw = fx.external.select(c("finding_category").alias("raw")).union(fx.findings.select("category")).union(
        fx.findings.select(F.concat(F.lower("category"), F.lit(" "))))
    return raw.groupBy("raw", classify.canonical_category(c("raw")).alias("category")).agg(F.count("*").alias("n"))


@query("fn_21", f"SELECT finding_name, {name_sql('finding_name')} AS normalized, count(*) AS n FROM fx_external GROUP BY 1, 2")
def fn_21(fx: Fixtures):
    return fx.external.groupBy("finding_name", tx.normalize_name(c("finding_name")).alias("normalized")).agg(F.count("*").alias("n"))


_SETS = "list_distinct([k % 3, k % 5, k % 7]) AS a, CASE WHEN k % 11 = 0 THEN [] ELSE list_distinct([k % 2, k % 4]) END AS b"


@query("fn_22", f"""SELECT k, CASE WHEN u = 0 THEN 1.0 ELSE round_even(len(list_intersect(a, b))::DOUBLE / u, 4) END AS jaccard FROM (
    SELECT k, a, b, len(list_distinct(list_concat(a, b))) AS u FROM (SELECT k, CASE WHEN k % 13 = 0 THEN [] ELSE a END AS a, b FROM (SELECT k, {_SETS} FROM fx_scans)))""")
def fn_22(fx: Fixtures):
    empty = F.array().cast("array<bigint>")
    a = F.when(c("k") % 13 == 0, empty).otherwise(F.array(c("k") % 3, c("k") % 5, c("k") % 7))
    b = F.when(c("k") % 11 == 0, empty).otherwise(F.array(c("k") % 2, c("k") % 4))
    return fx.scans.select("k", M.jaccard(F.array_distinct(a), F.array_distinct(b)).alias("jaccard"))


def prf_sql(tp: str, fp: str, fn: str) -> str:
    p = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp}::DOUBLE / ({tp} + {fp}) ELSE 1.0 END)"
    r = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp}::DOUBLE / ({tp} + {fn}) ELSE 1.0 END)"
    return (f"round_even({p}, 4) AS precision, round_even({r}, 4) AS recall, "
            f"CASE WHEN {p} + {r} > 0 THEN round_even(2 * {p} * {r} / ({p} + {r}), 4) ELSE 0.0 END AS f1_score")


@query("fn_23", f"SELECT k, {prf_sql('tp', 'fp', 'fn')} FROM (SELECT k, k % 5 AS tp, k % 7 AS fp, k % 3 AS fn FROM fx_scans)")
def fn_23(fx: Fixtures):
    tp, fp, fn = c("k") % 5, c("k") % 7, c("k") % 3
    return fx.scans.select("k", M.precision(tp, fp).alias("precision"), M.recall(tp, fn).alias("recall"), M.f1_score(tp, fp, fn).alias("f1_score"))


@query("fn_24", f"SELECT app_id, coalesce({_LEVEL}, CAST(min_sdk AS INTEGER)) AS level FROM fx_apps")
def fn_24(fx: Fixtures):
    return fx.apps.select("app_id", M.sdk_level(c("target_sdk"), c("min_sdk")).alias("level"))


@query("fn_25", "SELECT app_id, coalesce(nullif(version_name, ''), version_code) AS version FROM fx_apps")
def fn_25(fx: Fixtures):
    return fx.apps.select("app_id", M.version_label(c("version_name"), c("version_code")).alias("version"))


_ISO = "replace(CAST(event_time AS STRING), ' ', 'T')"


@query("fn_26", """SELECT k, epoch_us(t) AS micros, strftime(t, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN epoch_us(t) % 1000000 = 0 THEN '' ELSE '.' || strftime(t, '%f') END || '+00:00' AS iso
    FROM (SELECT k, CASE WHEN k % 3 = 2 THEN event_time - INTERVAL 2 HOUR ELSE event_time END AS t FROM fx_batch)""")
def fn_26(fx: Fixtures):
    zone = F.when(c("k") % 3 == 0, "Z").when(c("k") % 3 == 1, "").otherwise("+02:00")
    ts = M.parse_iso(F.concat(F.expr(_ISO), zone))
    return fx.batch.select("k", ts.alias("t")).select("k", F.unix_micros("t").alias("micros"), M.format_iso(c("t")).alias("iso"))


_BREAKS = tx.LINE_BREAK


@query("fn_27", f"""SELECT doc_id, pos AS line_no, md5(m) AS line FROM (SELECT doc_id, len(ls) AS n, unnest(ls) AS m, generate_subscripts(ls, 1) AS pos
    FROM (SELECT doc_id, string_split_regex(text, {quote(_BREAKS)}) AS ls FROM documents)) WHERE NOT (pos = n AND m = '')""")
def fn_27(fx: Fixtures):
    rows = fx.table("documents").select("doc_id", F.posexplode(tx.numbered_lines(c("text"))).alias("i", "l"))
    return rows.select("doc_id", (c("i") + 1).cast("bigint").alias("line_no"), F.md5("l").alias("line"))


@query("fn_28", "SELECT DISTINCT name, regexp_extract(name, '[^.]*$') AS simple FROM fx_components")
def fn_28(fx: Fixtures):
    return fx.components.select("name", tx.simple_name(c("name")).alias("simple")).distinct()


_LAST = "list_extract(string_split(regexp_replace(name, '/+$', ''), '/'), -1)"


@query("fn_29", f"SELECT k, coalesce(upper({_stem('b')}) NOT IN ({_RESERVED}), false) AS valid FROM (SELECT k, {_LAST} AS b FROM fx_names)")
def fn_29(fx: Fixtures):
    return fx.names.select("k", paths.is_valid_output_path(c("name")).alias("valid"))


@query("fn_30", "SELECT k, greatest(0.001::DOUBLE, CAST(round_even((k % 5000)::DECIMAL(20, 6) * 137 / 1000000, 3) AS DOUBLE)) AS seconds FROM fx_batch")
def fn_30(fx: Fixtures):
    start = c("event_time").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + (c("k") % 5000) * 137)
    return fx.batch.select("k", M.duration_seconds(start, end).alias("seconds"))


@query("snk_4", """SELECT event_id, CASE WHEN left(v, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN '''' || v ELSE v END AS cell FROM (
    SELECT event_id, CASE event_id % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) ELSE '' END || props AS v FROM events)""")
def snk_4(fx: Fixtures):
    first = F.expr("CASE event_id % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) ELSE '' END")
    return fx.table("events").select("event_id", tx.neutralize_formula(F.concat(first, "props")).alias("cell"))
