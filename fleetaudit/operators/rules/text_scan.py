"""One pass over the artifact text for all network, storage, crypto and secret rules.

Plan: scan -> one projection that holds an array with one entry per pattern
(each pattern behind a substring gate) -> explode the few non-empty entries ->
one CASE that turns hits into findings -> first hit per dedupe key.

The text column is dropped by the first explode, so only short hit rows reach
the shuffle.  "First hit per key" is `row_number() = 1`, which Spark turns into
a map-side group limit: every task sends at most one row per key, however many
hits one application or one URL has.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...catalogs import TRACKING_DOMAINS
from ...functions import text as tx, urls
from ...functions.classify import literal_case, sql_literal
from . import patterns as P
from .catalog import INFO, pack_seq, rule_column


# How a hit becomes a finding; see `_evidence_and_key`.
SNIPPET, GUARDED, SECRET, PEM, NEAR, TABLE, KEY, HASH, CONFIG = range(9)


@dataclass(frozen=True)
class Spec:
    """One pattern of a rule: when it is tried and how its matches are reported."""

    rule_id: str
    part: int
    pattern: str
    gate: list[str]
    kind: int = SNIPPET
    gate_lower: bool = False
    first_only: bool = False
    unless: list[str] = field(default_factory=list)
    requires: str | None = None
    context_lines: int | None = None
    title: str | None = None
    prefix: str = ""
    fixed: str | None = None
    confidence: str | None = None
    keep: tuple[int, int] = (0, 0)
    min_entropy: float = -1.0
    grouped: bool = False


def specs() -> list[Spec]:
    """Every text pattern except URLs and tracking domains."""
    return [
        Spec("SEC-001", 0, P.GOOGLE_KEY, ["AIza"], SECRET, prefix="Google API key: ", keep=(8, 3)),
        Spec("SEC-002", 0, P.AWS_KEY, ["AKIA"], SECRET, prefix="AWS access key: ", keep=(6, 2)),
        Spec("SEC-003", 0, P.GITHUB_TOKEN, ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], SECRET,
             prefix="GitHub token: ", keep=(6, 3)),
        Spec("SEC-003", 1, P.SLACK_TOKEN, ["xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"], SECRET,
             prefix="Slack token: ", keep=(6, 3)),
        Spec("SEC-004", 0, P.TOKEN_ASSIGNMENT, ["key", "token", "secret"], SECRET, True,
             prefix="Token: ", keep=(4, 3), min_entropy=2.8, grouped=True),
        Spec("SEC-005", 0, P.PASSWORD_ASSIGNMENT, ["passw", "pwd"], SECRET, True,
             prefix="Password: ", keep=(2, 2), grouped=True),
        Spec("SEC-006", 0, P.CLIENT_SECRET, ["client"], SECRET, True,
             prefix="Client secret: ", keep=(4, 3), grouped=True),
        Spec("SEC-007", 0, P.CONNECTION_STRING, ["://"], SECRET,
             prefix="Connection password: ", keep=(2, 2), grouped=True),
        Spec("SEC-008", 0, P.PRIVATE_KEY, ["PRIVATE KEY-----"], PEM),
        Spec("NET-002", 1, P.CLEARTEXT_CONFIG, ["cleartexttrafficpermitted"], CONFIG, True, first_only=True,
             title="Cleartext Traffic Permitted in Network Security Config", fixed='cleartextTrafficPermitted="true"'),
        Spec("NET-003", 0, P.EMPTY_SERVER_CHECK, ["checkServerTrusted"]),
        Spec("NET-003", 1, P.SMALI_SERVER_CHECK, ["checkServerTrusted"], fixed="Smali return-void in checkServerTrusted"),
        Spec("NET-003", 2, P.TRUST_ALL_CLASS, ["Trust"], title="Trust-All Certificate Manager Reference",
             prefix="Class reference: "),
        Spec("NET-004", 0, P.VERIFIER_CONSTANT, ["HOSTNAME_VERIFIER", "HostnameVerifier"], prefix="Verifier identifier: "),
        Spec("NET-004", 1, P.VERIFY_TRUE, ["verify"], first_only=True),
        Spec("NET-004", 2, P.LAMBDA_TRUE, ["->"], first_only=True),
        Spec("NET-005", 0, P.SSL_PROCEED, ["onReceivedSslError"], first_only=True,
             title="WebView SSL Error Bypass (handler.proceed)"),
        Spec("NET-005", 1, P.SSL_CONTEXT, ["TrustManager[]"], first_only=True,
             title="SSLContext Custom TrustManager Initialization"),
        *[Spec("NET-006", i, pattern, [gate], first_only=True, title=f"Insecure WebView Setting: {title}")
          for i, (title, gate, pattern) in enumerate(P.WEBVIEW_SETTINGS)],
        Spec("STO-001", 0, P.WORLD_MODE, ["MODE_WORLD_"]),
        Spec("STO-001", 1, P.WORLD_MODE_NUMBER, ["openFileOutput", "getSharedPreferences", "openOrCreateDatabase"]),
        Spec("STO-002", 0, P.EXTERNAL_STORAGE, P.EXTERNAL_STORAGE_GATES, NEAR, context_lines=3),
        Spec("STO-003", 0, P.PREFERENCE_PUT, [".put"], GUARDED, True, unless=P.ENCRYPTED_PREFERENCE_MARKS, grouped=True),
        Spec("STO-003", 1, P.PREFERENCE_FILE, ["getsharedpreferences"], SNIPPET, True,
             unless=P.ENCRYPTED_PREFERENCE_MARKS, confidence="MEDIUM"),
        Spec("STO-004", 0, P.CREATE_TABLE, ["create"], TABLE, True, unless=P.CIPHER_DATABASE_MARKS, grouped=True),
        Spec("STO-005", 0, P.LOG_CALL, ["log.", "system."], GUARDED, True, grouped=True),
        Spec("STO-006", 0, P.CACHE_STORAGE, P.CACHE_STORAGE_GATES, NEAR, context_lines=3),
        *[Spec("CRY-001", i, pattern, ["cipher.getinstance"], SNIPPET, True, title=f"Broken / Deprecated Cipher: {name}")
          for i, (name, pattern) in enumerate(P.BROKEN_CIPHERS)],
        Spec("CRY-002", 0, P.EXPLICIT_ECB, ["cipher.getinstance"], SNIPPET, True),
        Spec("CRY-002", 1, P.BARE_AES, ["Cipher.getInstance"],
             title="Insecure Cipher Mode: Unspecified Mode Defaults to ECB"),
        Spec("CRY-003", 0, P.INLINE_IV, ["IvParameterSpec"]),
        Spec("CRY-003", 1, P.ZERO_IV, ["IvParameterSpec"], title="Zero-Initialized Static IV Pattern"),
        Spec("CRY-004", 0, P.KEY_SPEC, ["SecretKeySpec"], KEY),
        Spec("CRY-005", 0, P.HASH_CALL, ["messagedigest.getinstance"], HASH, True, context_lines=5, grouped=True),
        Spec("CRY-006", 0, P.SET_SEED, [".setSeed"], requires="SecureRandom",
             title="Static Seed Configured on SecureRandom"),
        Spec("CRY-006", 1, P.UTIL_RANDOM, ["random"], SNIPPET, True,
             title="Insecure java.util.Random Used in Security Context"),
    ]


def line_hits(text: Column, pattern: str, k: int) -> Column:
    """Lines that match, each with its number and the text of the lines around it.

    The split array is bound once by the outer `transform`; the windows are
    array slices, so no line ever becomes a row unless it matched.
    """

    def search(ls: Column) -> Column:
        numbered = F.transform(ls, lambda l, i: F.struct(l.alias("m"), i.alias("i")))
        hits = F.filter(numbered, lambda x: x.m.rlike(pattern))

        def around(x: Column) -> Column:
            start = F.greatest(x.i - k, F.lit(0))
            return F.struct(
                x.m.alias("m"),
                (x.i + 1).alias("line_no"),
                F.array_join(F.slice(ls, start + 1, x.i + k + 1 - start), " ").alias("context"),
            )

        return F.transform(hits, around)

    return F.element_at(F.transform(F.array(tx.lines(text)), search), 1)


# Fixed pseudo-patterns of the URL rules.
URL_RULES = ("NET-001", "NET-007", "NET-008")


def tracking_domain_words(domains: list[str]) -> str:
    """Catalog domains that occur as whole words, one literal pattern per domain, as SQL text.

    Two plain gates come first: the endings the domains share, then the domains.
    """
    endings = list(dict.fromkeys(d[d.rfind("."):] for d in domains))
    gate = tx.sql_contains_any("low", endings) + " AND " + tx.sql_contains_any("low", domains)
    words = ", ".join(
        f"CASE WHEN contains(low, {sql_literal(d)}) AND text RLIKE {sql_literal('(?i)' + chr(92) + 'b' + re.escape(d) + chr(92) + 'b')} "
        f"THEN {sql_literal(d)} END"
        for d in domains)
    return f"CASE WHEN {gate} THEN array({words}) END"


def _url_findings(rules: set[str], domains: list[str]) -> Column:
    """Findings of one URL as an array: cleartext, third party, and one per catalog domain in it.

    Works on columns url, host, spec (host and path) and location.
    """
    def made(rule: str, key: str, evidence: str, sub: str = "0") -> str:
        return (f"named_struct('rule_id', '{rule}', 'part', 0, 'sub', {sub}, 'dedupe_key', {key}, 'title', '{INFO[rule].title}', "
                f"'evidence', {evidence}, 'location', location, 'confidence', CAST(NULL AS STRING))")

    url, host = F.col("url"), F.col("host")
    outside = ~urls.is_schema_url(url, host) & ~urls.is_test_host(host)
    singles = []
    if "NET-001" in rules:
        plain = F.expr("startswith(lower(url), 'http://')")
        singles.append(F.when(plain & outside, F.expr(made("NET-001", "url", "concat('Static URL: ', url)"))))
    if "NET-008" in rules:
        foreign = (host != "") & outside & ~urls.in_domains(host, [*urls.PLATFORM_DOMAINS, *domains])
        singles.append(F.when(foreign, F.expr(made("NET-008", "host", "concat('Static endpoint reference: ', url)"))))
    if "NET-007" not in rules:
        return F.array(*singles)
    listed = ", ".join(sql_literal(d) for d in domains)
    evidence = "concat('Static evidence: URL: ', url, ' (matches ', d, ')')"
    tracked = F.expr(
        f"transform(filter(array({listed}), d -> contains(spec, d)), (d, i) -> {made('NET-007', 'd', evidence, 'i')})")
    return F.concat(F.array(*singles), tracked) if singles else tracked


def tracking_domains(catalog: list[tuple[str, str, str]] | None = None) -> list[str]:
    rows = TRACKING_DOMAINS if catalog is None else catalog
    return list(dict.fromkeys(r[0].lower() for r in rows if r[0]))


def _matches(s: Spec) -> str | Column:
    """Array of matches of one pattern behind its gates, null when a gate is closed."""
    gate = tx.sql_contains_any("low" if s.gate_lower else "text", s.gate)
    if s.unless:
        gate += f" AND NOT {tx.sql_contains_any('text', s.unless)}"
    if s.requires:
        gate += f" AND contains(text, {sql_literal(s.requires)})"
    if s.kind == CONFIG:
        gate += " AND (contains(lower(location), 'network_security_config') OR contains(lower(location), 'res/xml'))"
    if s.context_lines is not None:
        return F.when(F.expr(gate), line_hits(F.col("text"), s.pattern, s.context_lines))
    pattern = sql_literal(s.pattern)
    if s.first_only:
        return f"CASE WHEN {gate} THEN array(nullif(regexp_extract(text, {pattern}, 0), '')) END"
    return f"CASE WHEN {gate} THEN regexp_extract_all(text, {pattern}, 0) END"


_LINE_TYPE = "array<struct<m:string,line_no:int,context:string>>"


def text_hits(artifacts: DataFrame, rules: set[str], domains: list[str]) -> tuple[DataFrame, list[Spec]]:
    """One row per pattern match: (app_id, target_seq, location, spec, pos, m, line_no, context)."""
    chosen = [s for s in specs() if s.rule_id in rules]
    entries: list[Column] = []

    def plain(sql: str) -> None:
        entries.append(F.expr(f"named_struct('spec', {len(entries)}, 'matches', {sql}, 'lines', CAST(NULL AS {_LINE_TYPE}))"))

    for s in chosen:
        found = _matches(s)
        if isinstance(found, str):
            plain(found)
        else:
            entries.append(F.struct(F.lit(len(entries)).alias("spec"), F.lit(None).cast("array<string>").alias("matches"),
                                    found.cast(_LINE_TYPE).alias("lines")))
    if rules & set(URL_RULES):
        gate = tx.sql_contains_any("low", ["http://", "https://"])
        plain(f"CASE WHEN {gate} THEN regexp_extract_all(text, {sql_literal(urls.URL_PATTERN)}, 0) END")
    if "NET-007" in rules:
        plain(tracking_domain_words(domains))
    found = (
        artifacts.select("app_id", "target_seq", "location", "text", F.lower("text").alias("low"))
        .select("app_id", "target_seq", "location", F.explode(F.array(*entries)).alias("e"))
        .where("coalesce(size(e.matches), 0) > 0 OR coalesce(size(e.lines), 0) > 0")
    )
    hits = found.select(
        "app_id", "target_seq", "location", "e.spec",
        F.posexplode(F.expr(
            "coalesce(e.lines, transform(e.matches, x -> named_struct('m', x, 'line_no', 0, 'context', '')))"
        )).alias("pos", "hit"),
    ).where("hit.m IS NOT NULL")
    return hits.select("app_id", "target_seq", "location", "spec", "pos", "hit.*"), chosen


def _spec_case(chosen: list[Spec], value: Callable[[Spec], object], default: object = None) -> Column:
    return literal_case("spec", {i: value(s) for i, s in enumerate(chosen)}, default)


def _pattern_hits(hits: DataFrame, chosen: list[Spec]) -> DataFrame:
    """Hits with the attributes of their pattern, the captured value and the context word."""
    groups = None
    for i, s in enumerate(chosen):
        if s.grouped:
            value = F.regexp_extract("m", s.pattern, 1)
            groups = F.when(F.col("spec") == i, value) if groups is None else groups.when(F.col("spec") == i, value)
    m = F.col("m")
    return hits.select(
        "*",
        _spec_case(chosen, lambda s: s.rule_id).alias("rule_id"),
        _spec_case(chosen, lambda s: s.part, 0).alias("part"),
        _spec_case(chosen, lambda s: s.kind, -1).alias("kind"),
        _spec_case(chosen, lambda s: s.title or INFO[s.rule_id].title).alias("title"),
        _spec_case(chosen, lambda s: s.prefix, "").alias("prefix"),
        _spec_case(chosen, lambda s: s.fixed).cast("string").alias("fixed"),
        _spec_case(chosen, lambda s: s.confidence).cast("string").alias("confidence"),
        _spec_case(chosen, lambda s: s.keep[0], 0).alias("keep_first"),
        _spec_case(chosen, lambda s: s.keep[1], 0).alias("keep_last"),
        _spec_case(chosen, lambda s: s.min_entropy, -1.0).alias("min_entropy"),
        (m if groups is None else groups.otherwise(m)).alias("value"),
        tx.strip(m).alias("snippet"),
    )


def _finding_columns(kinds: set[int]) -> tuple[Column, Column, Column, Column, Column]:
    """(keep, dedupe_key, title, evidence, location) of a hit, by kind."""
    kind, value, snippet = F.col("kind"), F.col("value"), F.col("snippet")
    keep, key, title, evidence, location = F.lit(True), F.expr("concat_ws(':', location, snippet)"), F.col("title"), None, None
    # Start from the plain snippet and lay the other kinds over it.
    evidence = F.expr("coalesce(fixed, concat(prefix, snippet))")
    location = F.col("location")
    numbered = F.expr("concat(location, ':line ', CAST(line_no AS STRING))")
    if GUARDED in kinds:
        keep = F.when(kind == GUARDED, value.rlike(P.SENSITIVE_WORD)).otherwise(keep)
    if SECRET in kinds:
        good = ~tx.is_placeholder(value) & (
            (F.col("min_entropy") < 0) | (tx.shannon_entropy(value) > F.col("min_entropy")))
        masked = tx.redact_secret(value, F.col("keep_first"), F.col("keep_last"))
        keep = F.when(kind == SECRET, good).otherwise(keep)
        key = F.when(kind == SECRET, F.concat_ws(":", "location", F.sha2(value, 256))).otherwise(key)
        evidence = F.when(kind == SECRET, F.concat("prefix", masked)).otherwise(evidence)
    if CONFIG in kinds:
        key = F.when(kind == CONFIG, F.col("target_seq").cast("string")).otherwise(key)
    if NEAR in kinds:
        word = F.regexp_extract("context", P.SENSITIVE_WORD, 0)
        keep = F.when(kind == NEAR, word != "").otherwise(keep)
        key = F.when(kind == NEAR, F.concat_ws(":", "location", snippet, word)).otherwise(key)
        evidence = F.when(kind == NEAR, F.concat(snippet, F.lit(" (keyword: "), word, F.lit(")"))).otherwise(evidence)
        location = F.when(kind == NEAR, numbered).otherwise(location)
    if TABLE in kinds:
        word = F.regexp_extract(value, P.SENSITIVE_WORD, 0)
        keep = F.when(kind == TABLE, word != "").otherwise(keep)
        key = F.when(kind == TABLE, F.concat_ws(":", "location", word)).otherwise(key)
        evidence = F.when(kind == TABLE, F.concat(F.lit("Schema with '"), word, F.lit("': "), snippet)).otherwise(evidence)
    if KEY in kinds:
        raw, algorithm = F.regexp_extract("m", P.KEY_SPEC, 1), F.regexp_extract("m", P.KEY_SPEC, 3)
        masked = F.when(raw != "", tx.redact_secret(raw, 2, 2)).otherwise("[STATIC_BYTE_ARRAY]")
        call = F.when(raw != "", F.concat(F.lit('"'), masked, F.lit('".getBytes()'))).otherwise(
            F.concat(F.lit("new byte[] { "), masked, F.lit(" }")))
        key = F.when(kind == KEY, F.concat_ws(":", "location", algorithm, masked)).otherwise(key)
        evidence = F.when(kind == KEY, F.concat(
            F.lit("new SecretKeySpec("), call, F.lit(', "'), algorithm, F.lit('")'))).otherwise(evidence)
    if HASH in kinds:
        algorithm = F.upper(value)
        words = ", ".join(f"CASE WHEN contains(lower(context), '{w}') THEN '{w}' END" for w in P.HASH_CONTEXT_WORDS)
        word = F.expr(f"coalesce({words})")
        keep = F.when(kind == HASH, word.isNotNull()).otherwise(keep)
        key = F.when(kind == HASH, F.concat_ws(":", "location", algorithm, word)).otherwise(key)
        evidence = F.when(kind == HASH, F.concat(snippet, F.lit(" (context: '"), word, F.lit("')"))).otherwise(evidence)
        location = F.when(kind == HASH, numbered).otherwise(location)
        title = F.when(kind == HASH, F.concat(
            F.lit("Obsolete Hash Algorithm in Security Context: "), algorithm)).otherwise(title)
    return keep, key, title, evidence, location


def text_findings(
    artifacts: DataFrame,
    rules: list[str] | None = None,
    apps: DataFrame | None = None,
    tracking_catalog: list[tuple[str, str, str]] | None = None,
    keep_key: bool = False,
) -> DataFrame:
    """Findings of the chosen text rules (all of them by default).

    `apps` supplies package names; with it, NET-008 leaves out first-party hosts.
    `keep_key` adds `dedupe_key`, unique with app_id and rule_id, for incremental scans.
    """
    wanted = set(rules) if rules is not None else {s.rule_id for s in specs()} | set(URL_RULES)
    domains = tracking_domains(tracking_catalog)
    hits, chosen = text_hits(artifacts, wanted, domains)
    url_rules = wanted & set(URL_RULES)
    n = len(chosen)
    rows = _pattern_hits(hits, chosen) if chosen else hits
    found = None
    if chosen:
        keep, key, title, evidence, location = _finding_columns({s.kind for s in chosen})
        made = F.struct("rule_id", "part", F.lit(0).alias("sub"), key.alias("dedupe_key"), title.alias("title"),
                        evidence.alias("evidence"), location.alias("location"), "confidence")
        found = F.array(F.when(keep, made))
    if url_rules:
        url = urls.clean_url(F.col("m"))
        is_url = F.col("spec") == n
        rows = rows.select("*", F.when(is_url, url).alias("url")).select(
            "*", urls.url_host(F.col("url")).alias("host"),
            F.concat(urls.url_host(F.col("url")), urls.url_path(F.col("url"))).alias("spec_text"))
        rows = rows.withColumnRenamed("spec", "spec_no").withColumnRenamed("spec_text", "spec")
        is_url = F.col("spec_no") == n
        from_url = _url_findings(url_rules, domains)
        if "NET-007" in url_rules:
            word = F.expr(
                f"array(named_struct('rule_id', 'NET-007', 'part', 1, 'sub', 0, 'dedupe_key', m, 'title', '{INFO['NET-007'].title}', "
                "'evidence', concat('Static evidence: Domain string: ', m), 'location', location, 'confidence', CAST(NULL AS STRING)))")
            from_url = F.when(is_url, from_url).otherwise(word)
        found = from_url if found is None else F.when(F.col("spec_no") < n, found).otherwise(from_url)
    emitted = (
        rows.select("app_id", "target_seq", "pos", F.explode(found).alias("f"))
        .where("f IS NOT NULL")
        .select("app_id", "target_seq", "pos", "f.*")
    )
    first = Window.partitionBy("app_id", "rule_id", "dedupe_key").orderBy("target_seq", "part", "pos", "sub")
    kept = emitted.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    if apps is not None and "NET-008" in wanted:
        package = apps.select("app_id", "package_name")
        own = (F.col("rule_id") == "NET-008") & urls.is_first_party(F.col("dedupe_key"), F.col("package_name"))
        kept = kept.join(package, "app_id", "left").where(~own)
    return finish(kept, ["dedupe_key"] if keep_key else [])


def finish(rows: DataFrame, more: list[str] = ()) -> DataFrame:
    """Common finding columns from (rule_id, part, pos, target_seq, ...) rows."""
    rule = "rule_id"
    if "sub" in rows.columns:  # several catalog domains can match one URL
        wide = F.col("pos").cast("bigint") * 64 + F.col("sub")
        rows = rows.withColumn("pos", F.when(F.col(rule) == "NET-007", wide).otherwise(F.col("pos")))
    return rows.select(
        "app_id",
        pack_seq(rule_column(rule, "ordinal"), F.col("target_seq"), F.col("part"), F.col("pos")).alias("finding_seq"),
        "rule_id",
        "title",
        rule_column(rule, "category").alias("category"),
        rule_column(rule, "severity").alias("severity"),
        F.coalesce("confidence", rule_column(rule, "confidence")).alias("confidence"),
        "evidence",
        "location",
        *more,
    )


def indicator_hits(artifacts: DataFrame, indicators: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """First match of every catalog indicator per application."""
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("indicator_seq"), F.lit(r[0]).alias("indicator_id"), F.lit(r[1]).alias("name"),
            F.lit(r[3]).alias("severity"), F.regexp_extract("text", r[2], 0).alias("match"),
        )
        for i, r in enumerate(indicators)
    ])
    first = Window.partitionBy("app_id", "indicator_id").orderBy("target_seq")
    return (
        artifacts.select("app_id", "target_seq", "location", F.explode(entries).alias("e"))
        .where(F.col("e.match") != "")
        .select("app_id", "target_seq", "location", "e.*")
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
        .select("app_id", "indicator_id", "name", "severity", "location", tx.redact_text(F.col("match")).alias("evidence"))
    )
