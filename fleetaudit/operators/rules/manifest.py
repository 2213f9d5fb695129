"""Manifest rules over apps, components and permissions.

MAN-001..005 style checks are row-local: one projection per table builds an
array of candidate findings, one explode emits them; there is no shuffle.
Only MAN-010 groups, on eleven known permission names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ...functions.metrics import sdk_level
from ...functions.text import alternation, simple_name
from .catalog import INFO, ORDINAL, pack_row_seq

APPLICATION = "AndroidManifest.xml:<application>"

# Action words of MAN-009.
SENSITIVE_ACTIONS = [
    "auth", "login", "admin", "payment", "backup", "sync",
    "upload", "export", "token", "credential", "reset",
]

# Permission groups of MAN-010 and their finding titles.
INTERNET = "android.permission.INTERNET"
SENSITIVE_GROUPS = [
    (["android.permission.ACCESS_FINE_LOCATION", "android.permission.ACCESS_COARSE_LOCATION"],
     "Geolocation Exfiltration Indicator"),
    (["android.permission.READ_PHONE_STATE", "android.permission.READ_PRIVILEGED_PHONE_STATE"],
     "Device Identifier Tracking Indicator"),
    (["android.permission.READ_CONTACTS", "android.permission.GET_ACCOUNTS"],
     "Contact List / Account Exfiltration Indicator"),
    (["android.permission.READ_SMS", "android.permission.RECEIVE_SMS"],
     "SMS / 2FA Token Exfiltration Indicator"),
    (["android.permission.RECORD_AUDIO", "android.permission.CAMERA"],
     "Surveillance / Media Exfiltration Indicator"),
]


def _candidate(
    rule_id: str, evidence: Column, location: Column, title: Column | None = None,
    severity: str | None = None, confidence: str | None = None,
) -> Column:
    info = INFO[rule_id]
    return F.struct(
        F.lit(ORDINAL[rule_id]).alias("ordinal"),
        F.lit(rule_id).alias("rule_id"),
        (F.lit(info.title) if title is None else title).alias("title"),
        F.lit(info.category).alias("category"),
        F.lit(severity or info.severity).alias("severity"),
        F.lit(confidence or info.confidence).alias("confidence"),
        evidence.alias("evidence"),
        location.alias("location"),
    )


def _emit(rows: DataFrame, candidates: list[Column], target: Column) -> DataFrame:
    return (
        rows.select("app_id", target.alias("target"), F.explode(F.array(*candidates)).alias("f"))
        .where(F.col("f").isNotNull())
        .select(
            "app_id",
            pack_row_seq(F.col("f.ordinal"), F.col("target")).alias("finding_seq"),
            "f.rule_id", "f.title", "f.category", "f.severity", "f.confidence", "f.evidence", "f.location",
        )
    )


def _app_rules() -> dict[str, Column]:
    level = sdk_level(F.col("target_sdk"))
    backup, cleartext = F.col("allow_backup"), F.col("uses_cleartext_traffic")
    where = F.lit(APPLICATION)
    backup_text = F.when(backup, 'android:allowBackup="true" in <application>').otherwise(
        "android:allowBackup not specified (defaults to true) in <application>"
    )
    return {
        "MAN-001": F.when(
            F.col("debuggable"),
            _candidate("MAN-001", F.lit('android:debuggable="true" in <application>'), where),
        ),
        "MAN-002": F.when(
            backup.isNull() | backup,
            _candidate("MAN-002", backup_text, where),
        ),
        "MAN-003": F.when(
            cleartext,
            _candidate("MAN-003", F.lit('android:usesCleartextTraffic="true" in <application>'), where,
                       F.lit("Cleartext Traffic Explicitly Permitted")),
        ).when(
            cleartext.isNull() & (level < 28),
            _candidate("MAN-003",
                       F.concat(F.lit("targetSdkVersion="), level.cast("string"),
                                F.lit(" with unconfigured usesCleartextTraffic")),
                       where, F.lit("Cleartext Traffic Allowed by Default (Legacy Target SDK)"),
                       "MEDIUM", "MEDIUM"),
        ),
        "MAN-004": F.when(
            (level >= 24) & (F.coalesce("network_security_config", F.lit("")) == ""),
            _candidate("MAN-004", F.lit("Missing 'android:networkSecurityConfig' attribute in <application>"), where),
        ),
    }


def manifest_cleartext(apps: DataFrame) -> DataFrame:
    """The manifest half of NET-002."""
    return _emit(
        apps,
        [F.when(
            F.col("uses_cleartext_traffic"),
            _candidate("NET-002", F.lit('android:usesCleartextTraffic="true" in <application>'), F.lit(APPLICATION),
                       F.lit("Cleartext Traffic Permitted in Manifest")),
        )],
        F.lit(0),
    )


def _component_rules() -> dict[str, Column]:
    kind, name = F.col("component_type"), F.col("name")
    exported = F.coalesce("exported", F.lit(False))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    open_to_all = exported & empty("permission")
    short = simple_name(name)

    def entry(tag: str, note: str) -> Column:
        return F.concat(F.lit(f'{tag} android:name="'), name, F.lit(f'" android:exported="true" ({note})'))

    def place(tag: Column) -> Column:
        return F.concat(F.lit("AndroidManifest.xml:<"), tag, F.lit(' name="'), name, F.lit('">'))

    def unprotected(rule_id: str, tag: str, label: str, test: Column, note: str = "no permission") -> Column:
        title = F.concat(F.lit(f"Exported {label} Unprotected: "), short)
        return F.when((kind == tag) & test, _candidate(rule_id, entry(tag, note), place(F.lit(tag)), title))

    pattern = "(?i)" + alternation(SENSITIVE_ACTIONS)
    matched = F.filter(F.coalesce("actions", F.array().cast("array<string>")), lambda a: a.rlike(pattern))
    listed = F.array_join(F.slice(matched, 1, 3), ", ")
    return {
        "MAN-005": unprotected("MAN-005", "activity", "Activity",
                               open_to_all & ~F.coalesce("is_main_launcher", F.lit(False))),
        "MAN-006": unprotected("MAN-006", "service", "Service", open_to_all),
        "MAN-007": unprotected("MAN-007", "receiver", "Receiver", open_to_all),
        "MAN-008": unprotected("MAN-008", "provider", "Content Provider",
                               open_to_all & empty("read_permission") & empty("write_permission"), "unprotected"),
        "MAN-009": F.when(
            open_to_all & (F.size(matched) > 0),
            _candidate("MAN-009",
                       F.concat(F.lit("Action(s): "), listed, F.lit(" on exported component '"), name, F.lit("'")),
                       place(kind), F.concat(F.lit("Sensitive Action Exposed: "), short)),
        ),
    }


def permission_combinations(permissions: DataFrame) -> DataFrame:
    """MAN-010: INTERNET together with any permission of a sensitive group."""
    known = [INTERNET] + [p for group, _ in SENSITIVE_GROUPS for p in group]
    held = (
        permissions.where(F.col("permission").isin(known))
        .groupBy("app_id")
        .agg(F.collect_set("permission").alias("held"))
        .where(F.array_contains("held", INTERNET))
    )
    groups = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(title).alias("label"),
                 F.array_sort(F.array_intersect("held", F.array(*[F.lit(p) for p in group]))).alias("m"))
        for i, (group, title) in enumerate(SENSITIVE_GROUPS)
    ])
    info = INFO["MAN-010"]
    names = F.array_join("g.m", ", ")
    return (
        held.select("app_id", F.explode(groups).alias("g"))
        .where(F.size("g.m") > 0)
        .select(
            "app_id",
            pack_row_seq(F.lit(ORDINAL["MAN-010"]), F.col("g.i")).alias("finding_seq"),
            F.lit("MAN-010").alias("rule_id"),
            F.concat("g.label", F.lit(": "), simple_name(names)).alias("title"),
            F.lit(info.category).alias("category"),
            F.lit(info.severity).alias("severity"),
            F.lit(info.confidence).alias("confidence"),
            F.concat(F.lit("INTERNET + "), names).alias("evidence"),
            F.lit("AndroidManifest.xml:<uses-permission>").alias("location"),
        )
    )


def manifest_findings(
    apps: DataFrame | None = None,
    components: DataFrame | None = None,
    permissions: DataFrame | None = None,
    rules: list[str] | None = None,
) -> DataFrame:
    """Findings of MAN-001..010 for whichever tables are given.

    `apps` holds one row per application whose manifest could be read; an
    application without a manifest is not in it and yields nothing.
    """
    wants = lambda r: rules is None or r in rules
    parts: list[DataFrame] = []
    if apps is not None:
        chosen = [c for r, c in _app_rules().items() if wants(r)]
        if chosen:
            parts.append(_emit(apps, chosen, F.lit(0)))
    if components is not None:
        chosen = [c for r, c in _component_rules().items() if wants(r)]
        if chosen:
            parts.append(_emit(components, chosen, F.col("comp_seq")))
    if permissions is not None and wants("MAN-010"):
        parts.append(permission_combinations(permissions))
    return reduce(DataFrame.unionByName, parts)


def with_manifest_only(rows: DataFrame, apps: DataFrame) -> DataFrame:
    """Keep rows of applications whose manifest was read (semi join)."""
    return rows.join(apps.select("app_id"), "app_id", "left_semi")
