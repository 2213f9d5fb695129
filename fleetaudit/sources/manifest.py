"""Manifest XML to application columns and component rows, parsed in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.metrics import sdk_level, tri_state

_NAMED = "array<struct<`_android:name`:string,`_name`:string>>"
_FILTERS = f"array<struct<action:{_NAMED},category:{_NAMED}>>"
_COMPONENT = (
    "array<struct<`_android:name`:string,`_name`:string,`_android:exported`:string,`_exported`:string,"
    "`_android:permission`:string,`_permission`:string,`_android:readPermission`:string,"
    f"`_android:writePermission`:string,`intent-filter`:{_FILTERS}>>"
)
COMPONENT_TYPES = ["activity", "service", "receiver", "provider"]
MANIFEST_SCHEMA = (
    "`_package` string, `_android:versionCode` string, `_android:versionName` string, "
    "`uses-sdk` struct<`_android:minSdkVersion`:string,`_android:targetSdkVersion`:string>, "
    f"`uses-permission` {_NAMED}, permission {_NAMED}, `uses-feature` {_NAMED}, "
    "application struct<`_android:label`:string,`_android:allowBackup`:string,`_android:debuggable`:string,"
    "`_android:usesCleartextTraffic`:string,`_android:networkSecurityConfig`:string,"
    f"`uses-library`:{_NAMED}," + ",".join(f"{t}:{_COMPONENT}" for t in COMPONENT_TYPES) + ">"
)


def _name(e: Column) -> Column:
    return F.coalesce(e["_android:name"], e["_name"])


def _names(items: Column) -> Column:
    """Non-empty names of a repeated element; empty array when absent."""
    found = F.filter(F.transform(items, _name), lambda n: F.coalesce(n, F.lit("")) != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def parse_manifests(manifests: DataFrame, xml: str = "manifest_xml") -> DataFrame:
    """(app_id, app columns, permission / feature / library arrays, parsed `application`)."""
    m = F.col("m")
    app = m["application"]
    return (
        manifests.select("app_id", xml, F.from_xml(F.col(xml), MANIFEST_SCHEMA, {"mode": "PERMISSIVE"}).alias("m"))
        .select(
            "app_id",
            F.coalesce(F.nullif(m["_package"], F.lit("")), F.lit("unknown.package")).alias("package_name"),
            app["_android:label"].alias("app_name"),
            m["_android:versionName"].alias("version_name"),
            m["_android:versionCode"].alias("version_code"),
            m["uses-sdk"]["_android:minSdkVersion"].alias("min_sdk"),
            m["uses-sdk"]["_android:targetSdkVersion"].alias("target_sdk"),
            tri_state(app["_android:allowBackup"]).alias("allow_backup"),
            tri_state(app["_android:debuggable"]).alias("debuggable"),
            tri_state(app["_android:usesCleartextTraffic"]).alias("uses_cleartext_traffic"),
            F.nullif(app["_android:networkSecurityConfig"], F.lit("")).alias("network_security_config"),
            _names(m["uses-permission"]).alias("permissions"),
            _names(m["permission"]).alias("declared_permissions"),
            _names(m["uses-feature"]).alias("features"),
            _names(app["uses-library"]).alias("libraries"),
            app.alias("application"),
        )
    )


def default_exported(attr: Column, kind: Column, target_sdk: Column, has_filter: Column) -> Column:
    """Explicit attribute; else providers by target level, others by intent filter."""
    implied = F.when(kind == "provider", F.coalesce(target_sdk < 17, F.lit(False))).otherwise(has_filter)
    return F.when(attr.isNotNull(), F.lower(F.trim(attr)).isin("true", "1")).otherwise(implied)


def is_launcher(filters: Column) -> Column:
    """MAIN action and LAUNCHER category inside the same intent filter."""
    return F.coalesce(
        F.exists(
            filters,
            lambda f: F.array_contains(f["actions"], "android.intent.action.MAIN")
            & F.array_contains(f["categories"], "android.intent.category.LAUNCHER"),
        ),
        F.lit(False),
    )


def component_rows(parsed: DataFrame) -> DataFrame:
    """One row per named component of a parsed manifest."""

    def filters(e: Column) -> Column:
        made = F.transform(
            e["intent-filter"],
            lambda f: F.struct(_names(f["action"]).alias("actions"), _names(f["category"]).alias("categories")),
        )
        return F.coalesce(made, F.array().cast("array<struct<actions:array<string>,categories:array<string>>>"))

    def of_type(t: str) -> Column:
        items = F.coalesce(F.col("application")[t], F.array().cast(_COMPONENT))
        return F.transform(
            items,
            lambda e: F.struct(
                F.lit(t).alias("component_type"),
                _name(e).alias("name"),
                F.coalesce(e["_android:exported"], e["_exported"]).alias("attr"),
                F.coalesce(e["_android:permission"], e["_permission"]).alias("permission"),
                e["_android:readPermission"].alias("read_permission"),
                e["_android:writePermission"].alias("write_permission"),
                filters(e).alias("filters"),
            ),
        )

    c = F.col("c")
    has_filter = F.size(c["filters"]) > 0
    return (
        parsed.select(
            "app_id", sdk_level(F.col("target_sdk")).alias("level"),
            F.posexplode(F.concat(*[of_type(t) for t in COMPONENT_TYPES])).alias("comp_seq", "c"),
        )
        .where(F.coalesce(c["name"], F.lit("")) != "")
        .select(
            "app_id",
            F.col("comp_seq").cast("bigint").alias("comp_seq"),
            c["component_type"].alias("component_type"),
            c["name"].alias("name"),
            default_exported(c["attr"], c["component_type"], F.col("level"), has_filter).alias("exported"),
            c["permission"].alias("permission"),
            c["read_permission"].alias("read_permission"),
            c["write_permission"].alias("write_permission"),
            has_filter.alias("has_intent_filter"),
            is_launcher(c["filters"]).alias("is_main_launcher"),
            F.flatten(F.transform(c["filters"], lambda f: f["actions"])).alias("actions"),
        )
    )


def permission_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("app_id", F.posexplode("permissions").alias("perm_seq", "permission")).select(
        "app_id", F.col("perm_seq").cast("bigint").alias("perm_seq"), "permission"
    )
