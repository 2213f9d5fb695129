"""Scan inputs: text targets and SDK candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.classify import literal_case
from ..functions.paths import class_from_path, package_from_class
from ..operators.ordinals import with_ordinal

# Order of the sources inside one application; each gets its own block of sequence numbers.
# Files are numbered up to the manifest's block, which no application reaches.
POOL_BLOCK, FILE_BLOCK, MANIFEST_BLOCK, RAW_BLOCK = 0, 1, 2**56, 2**56 + 1
POOL_LOCATION, MANIFEST_LOCATION = "DEX:StringPool", "AndroidManifest.xml"


def pool_targets(strings: DataFrame) -> DataFrame:
    """String pools as newline-joined texts, ordered by first offset.

    `strings` is (app_id, string_seq, string).  The pool of an application is one
    target: suppression marks, gates and line windows of a rule see all of it.  Its
    size is that of the application's code, so a row stays bounded.
    """
    return (
        strings.groupBy("app_id")
        .agg(F.array_sort(F.collect_list(F.struct("string_seq", "string"))).alias("s"))
        .select(
            "app_id", F.lit(POOL_BLOCK).cast("bigint").alias("target_seq"), F.lit(POOL_LOCATION).alias("location"),
            F.array_join(F.col("s.string"), "\n").alias("text"),
        )
    )


def text_targets(files: DataFrame, pools: DataFrame | None = None, apps: DataFrame | None = None) -> DataFrame:
    """Unify string pools, files (app_id, file_seq, location, text) and manifests, in scan order."""
    parts = []
    if pools is not None:
        parts.append(pools.select("app_id", "target_seq", "location", "text"))
    parts.append(files.select(
        "app_id", (F.col("file_seq") + FILE_BLOCK).cast("bigint").alias("target_seq"), "location", "text"))
    if apps is not None:
        parts.append(apps.where(F.coalesce("manifest_xml", F.lit("")) != "").select(
            "app_id", F.lit(MANIFEST_BLOCK).cast("bigint").alias("target_seq"),
            F.lit(MANIFEST_LOCATION).alias("location"), F.col("manifest_xml").alias("text")))
    return reduce(DataFrame.unionByName, parts)


def class_names(files: DataFrame, components: DataFrame) -> DataFrame:
    """Distinct class candidates: component names and source paths."""
    source = files.where(F.col("location").rlike(r"\.(?:java|kt)$")).select(
        "app_id", class_from_path(F.col("location")).alias("class_name"))
    return components.select("app_id", F.col("name").alias("class_name")).union(source).distinct()


def package_names(classes: DataFrame) -> DataFrame:
    return classes.select("app_id", package_from_class(F.col("class_name")).alias("package_name")).where(
        "package_name IS NOT NULL")


# Block of each candidate kind; the position inside the block follows the row.
_KIND_BLOCK = 2**40


def sdk_candidates(
    classes: DataFrame | None = None, components: DataFrame | None = None,
    artifacts: DataFrame | None = None, libraries: DataFrame | None = None,
) -> DataFrame:
    """(app_id, cand_seq, kind, text) in the order in which an SDK is looked up.

    Classes come before packages, component lists, libraries, the string pool,
    and each file's path before its content.
    """
    block = lambda n, pos: (F.lit(n * _KIND_BLOCK) + pos).cast("bigint").alias("cand_seq")
    parts = []
    if classes is not None:
        named = with_ordinal(classes, ["app_id"], "class_name", "n")
        parts.append(named.select("app_id", block(0, F.col("n")), F.lit("Class").alias("kind"), F.col("class_name").alias("text")))
        parts.append(named.where(F.contains("class_name", F.lit("."))).select(
            "app_id", block(1, F.col("n")), F.lit("Package").alias("kind"),
            package_from_class(F.col("class_name")).alias("text")))
    if components is not None:
        kinds = {"activity": (2, "Activities"), "service": (3, "Services"),
                 "receiver": (4, "Receivers"), "provider": (5, "Providers")}
        number = literal_case("component_type", {t: n for t, (n, _) in kinds.items()}, None)
        label = literal_case("component_type", {t: x for t, (_, x) in kinds.items()}, None)
        parts.append(components.where(F.col("component_type").isin(list(kinds))).select(
            "app_id", (number.cast("bigint") * _KIND_BLOCK + F.col("comp_seq")).cast("bigint").alias("cand_seq"),
            label.alias("kind"), F.col("name").alias("text")))
    if libraries is not None:
        parts.append(libraries.select(
            "app_id", block(6, F.col("lib_seq")), F.lit("Libraries").alias("kind"), F.col("library").alias("text")))
    if artifacts is not None:
        is_pool = F.col("location") == POOL_LOCATION
        pair = F.array(
            F.when(~is_pool, F.struct(F.lit(0).alias("half"), F.lit("FilePath").alias("kind"), F.col("location").alias("text"))),
            F.struct(F.lit(1).alias("half"), F.col("location").alias("kind"), F.col("text").alias("text")),
        )
        parts.append(
            artifacts.select("app_id", "target_seq", is_pool.alias("pool"), F.explode(pair).alias("p"))
            .where(F.col("p").isNotNull())
            .select("app_id",
                    (F.when(F.col("pool"), F.lit(7 * _KIND_BLOCK)).otherwise(F.lit(8 * _KIND_BLOCK))
                     + F.col("target_seq") * 2 + F.col("p.half")).cast("bigint").alias("cand_seq"),
                    F.col("p.kind").alias("kind"), F.col("p.text").alias("text"))
        )
    return reduce(DataFrame.unionByName, parts)
