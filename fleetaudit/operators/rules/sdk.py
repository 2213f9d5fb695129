"""SDK identification and SDK permission exposure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ...catalogs import CATEGORY_DEFAULT_FAMILIES, PERMISSION_TO_FAMILY, SDKS
from ...functions.classify import literal_case
from ...functions.text import contains_any, literal_forms, strip
from .catalog import INFO, ORDINAL, pack_seq


def unique_sdks(catalog: list[tuple] | None = None) -> list[tuple]:
    """Catalog rows with a pattern; the first row of an id (or name) counts."""
    rows: dict[str, tuple] = {}
    for row in SDKS if catalog is None else catalog:
        if row[3]:
            rows.setdefault(row[0] or row[1] or "unknown_sdk", row)
    return list(rows.values())


def detected_sdks(candidates: DataFrame, catalog: list[tuple] | None = None) -> DataFrame:
    """(app_id, sdk_seq, kind, matched): first candidate that shows each SDK.

    The catalog is known when the plan is built, so each pattern is a literal,
    tried only where the plain strings of the pattern occur in the lower-case text.
    """
    sdks = unique_sdks(catalog)

    def matched(pattern: str) -> Column:
        found = F.regexp_extract("text", "(?i)" + pattern, 0)
        forms = literal_forms(pattern)
        return found if forms is None else F.when(contains_any(F.col("low"), [f.lower() for f in forms]), found)

    tests = F.array(*[
        F.struct(F.lit(i).alias("sdk_seq"), matched(r[3]).alias("matched")) for i, r in enumerate(sdks)
    ])
    first = Window.partitionBy("app_id", "sdk_seq").orderBy("cand_seq")
    return (
        candidates.select("app_id", "cand_seq", "kind", "text", F.lower("text").alias("low"))
        .select("app_id", "cand_seq", "kind", F.explode(tests).alias("t"))
        .where(F.col("t.matched") != "")
        .select("app_id", "cand_seq", "kind", "t.sdk_seq", "t.matched")
        .withColumn("rn", F.row_number().over(first))
        .where("rn = 1")
        .drop("rn", "cand_seq")
    )


def _sdk_field(index: int, catalog: list[tuple] | None):
    return literal_case("sdk_seq", {i: r[index] for i, r in enumerate(unique_sdks(catalog))}, None)


def permission_families(permissions: DataFrame) -> DataFrame:
    """(app_id, family, permission) for the 26 mapped permissions.

    The map is a fixed list, so it is broadcast; the declared permissions do not move.
    """
    mapped = permissions.sparkSession.createDataFrame(
        list(PERMISSION_TO_FAMILY.items()), "permission string, family string")
    declared = permissions.select("app_id", strip(F.col("permission")).alias("permission"))
    return declared.join(F.broadcast(mapped), "permission").select("app_id", "family", "permission")


def family_map(permissions: DataFrame) -> DataFrame:
    """(app_id, family, permissions): sorted list, at most 26 names per application."""
    return (
        permission_families(permissions)
        .groupBy("app_id", "family")
        .agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
    )


def sdk_families(
    detected: DataFrame, catalog: list[tuple] | None = None, with_sdk: bool = False
) -> DataFrame:
    """One row per detected SDK and family it may reach; `with_sdk` adds a row with an empty family."""
    sdks = unique_sdks(catalog)
    table = {
        i: [""] * with_sdk + list(dict.fromkeys(r[5] or CATEGORY_DEFAULT_FAMILIES.get(r[2], [])))
        for i, r in enumerate(sdks)
    }
    families = None
    for i, fams in table.items():
        value = F.array(*[F.lit(f) for f in fams]).cast("array<string>")
        test = F.col("sdk_seq") == i
        families = F.when(test, value) if families is None else families.when(test, value)
    return detected.select("*", F.posexplode(families).alias("family_seq", "family"))


def _as_findings(rows: DataFrame, catalog: list[tuple] | None) -> DataFrame:
    """Findings of (detected SDK, family) rows; the empty family stands for the SDK itself."""
    name, category, kind = _sdk_field(1, catalog), _sdk_field(2, catalog), F.col("kind")
    shown = F.initcap(F.replace(F.col("family"), F.lit("_"), F.lit(" ")))
    is_sdk = F.col("family") == ""
    one, two = INFO["SDK-001"], INFO["SDK-002"]
    pick = lambda a, b: F.when(is_sdk, a).otherwise(b)
    return rows.select(
        "app_id",
        pack_seq(pick(F.lit(ORDINAL[one.rule_id]), F.lit(ORDINAL[two.rule_id])), F.col("sdk_seq"), F.lit(0),
                 F.col("family_seq")).alias("finding_seq"),
        pick(F.lit(one.rule_id), F.lit(two.rule_id)).alias("rule_id"),
        pick(F.concat(F.lit("Third-Party SDK Detected: "), name, F.lit(" ("), category, F.lit(")")),
             F.concat(F.lit("SDK Permission Exposure: "), name, F.lit(" with "), shown, F.lit(" Access"))).alias("title"),
        F.lit(one.category).alias("category"),
        pick(F.lit(one.severity), F.lit(two.severity)).alias("severity"),
        pick(F.lit(one.confidence), F.lit(two.confidence)).alias("confidence"),
        pick(F.concat(F.lit("SDK: "), name, F.lit(" (Category: "), category, F.lit(", Matched: "), F.col("matched"),
                      F.lit(" in "), kind, F.lit(")")),
             F.concat(F.lit("SDK '"), name, F.lit("' ("), category, F.lit(") detected in "), kind,
                      F.lit(" + Host permissions: ["), F.array_join("permissions", ", "), F.lit("]"))).alias("evidence"),
        pick(kind, F.concat(kind, F.lit(":<uses-permission>"))).alias("location"),
    )


def sdk_findings(detected: DataFrame, catalog: list[tuple] | None = None) -> DataFrame:
    """SDK-001."""
    no_family = detected.select(
        "*", F.lit("").alias("family"), F.lit(0).alias("family_seq"), F.array().cast("array<string>").alias("permissions"))
    return _as_findings(no_family, catalog)


def exposure_findings(
    detected: DataFrame, permissions: DataFrame, catalog: list[tuple] | None = None
) -> DataFrame:
    """SDK-002: families of a detected SDK that the host also holds."""
    return _as_findings(sdk_families(detected, catalog).join(family_map(permissions), ["app_id", "family"]), catalog)


def all_sdk_findings(
    detected: DataFrame, permissions: DataFrame, catalog: list[tuple] | None = None
) -> DataFrame:
    """SDK-001 and SDK-002 from one pass over the candidates."""
    rows = sdk_families(detected, catalog, with_sdk=True).join(family_map(permissions), ["app_id", "family"], "left")
    return _as_findings(rows.where("family = '' OR permissions IS NOT NULL"), catalog)
