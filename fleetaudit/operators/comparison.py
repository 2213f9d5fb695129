"""Comparison of our findings with those of another tool, by content hash.

Signatures are (hash, category, normalised name).  Both sides are grouped together
by the whole signature with map-side combining, so a hash with very many findings
spreads over all tasks; everything per hash is then a count.  Where membership alone is asked for,
a hash moves as its bytes and both sides as two bits of one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..catalogs import CANONICAL_CATEGORIES
from ..functions.classify import canonical_category
from ..functions.metrics import jaccard_counts
from ..functions.text import normalize_name
from .rows import side_by_side

SAMPLE = 5
SIGNATURE = ["apk_hash", "finding_category", "normalized_name"]


def normalize(rows: DataFrame, hash_col: str, category: str, name: str) -> DataFrame:
    return rows.select(
        F.lower(F.trim(hash_col)).alias("apk_hash"),
        canonical_category(F.col(category)).alias("finding_category"),
        F.col(name).alias("finding_name"),
        normalize_name(F.col(name)).alias("normalized_name"),
        *[c for c in ("tool", "severity") if c in rows.columns],
    )


def _named() -> Column:
    # A name without letters or digits normalises to nothing; testing the raw name
    # keeps the optimizer from running the normaliser twice per row.
    return F.lower("finding_name").rlike("[a-z0-9]")


def signatures(rows: DataFrame) -> DataFrame:
    return rows.where(_named()).select("apk_hash", "finding_category", "normalized_name").distinct()


def common_signatures(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Signatures of both sides, each once; one grouping, as an intersection would move the distinct rows again."""
    return _split(ours, theirs, F.col("in_ours") & F.col("in_theirs"))


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Signatures of the first side alone, each once, by one grouping."""
    return _split(a, b, F.col("in_ours") & ~F.col("in_theirs"))


def only_in_one(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Signatures of one side alone, each once, behind the name of the side; one grouping tells those of both sides."""
    side = F.when(F.col("in_ours"), "ours").otherwise("external").alias("side")
    return matched_signatures(ours, theirs).where(F.col("in_ours") != F.col("in_theirs")).select(side, *SIGNATURE)


def _split(ours: DataFrame, theirs: DataFrame, wanted: Column) -> DataFrame:
    return matched_signatures(ours, theirs).where(wanted).drop("in_ours", "in_theirs")


def all_hashes(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    return ours.select("apk_hash").union(theirs.select("apk_hash")).distinct()


def counted_signatures(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Every signature once, with its rows on both sides: (…, n_ours, n_theirs).

    One grouping over both sides; rows combine before they move.  A name without letters
    or digits normalises to nothing: it counts as a finding but is no signature.
    """
    tag = lambda df, side: df.select("apk_hash", "finding_category", "normalized_name", F.lit(side).alias("ours"))
    return tag(ours, True).union(tag(theirs, False)).groupBy("apk_hash", "finding_category", "normalized_name").agg(
        F.count_if("ours").alias("n_ours"), F.count_if(~F.col("ours")).alias("n_theirs"))


def matched_signatures(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Distinct signatures with membership flags.

    A hash in lower-case hex digits moves as the bytes that these stand for; any other text moves as it is.
    """
    digest = F.unhex("apk_hash")
    is_hex = F.lower(F.hex(digest)) == F.col("apk_hash")
    tag = lambda df, side: df.where(_named()).select(
        F.when(is_hex, digest).alias("digest"), F.when(is_hex, None).otherwise(F.col("apk_hash")).alias("plain"),
        *SIGNATURE[1:], F.lit(side).cast("tinyint").alias("side"))
    sides = tag(ours, 1).union(tag(theirs, 2)).groupBy("digest", "plain", *SIGNATURE[1:]).agg(F.bit_or("side").alias("sides"))
    return sides.select(
        F.coalesce(F.lower(F.hex("digest")), "plain").alias("apk_hash"), *SIGNATURE[1:],
        (F.col("sides") != 2).alias("in_ours"), (F.col("sides") != 1).alias("in_theirs"))


def _per_hash(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per hash: row and signature counts, category arrays of both tools (at most eight each), set algebra."""
    a, b = F.col("n_ours") > 0, F.col("n_theirs") > 0
    named = F.col("normalized_name") != ""
    categories = lambda side: F.array_sort(F.collect_set(F.when(side, F.col("finding_category"))))
    per = counted_signatures(ours, theirs).groupBy("apk_hash").agg(
        F.sum("n_ours").alias("our_findings_count"),
        F.sum("n_theirs").alias("external_findings_count"),
        categories(a).alias("ours"),
        categories(b).alias("theirs"),
        F.count_if(named & a & b).alias("common_findings_count"),
        F.count_if(named & a & ~b).alias("unique_our_tool_count"),
        F.count_if(named & ~a & b).alias("unique_external_tool_count"),
    )
    return per.select(
        "*",
        F.array_intersect("ours", "theirs").alias("common_categories"),
        F.array_except("ours", "theirs").alias("unique_our_categories"),
        F.array_except("theirs", "ours").alias("unique_external_categories"),
    )


def category_sets(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per hash: row counts of both tools, their categories and the set algebra of these."""
    return _per_hash(ours, theirs).drop("common_findings_count", "unique_our_tool_count", "unique_external_tool_count")


def category_overlap(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Applications per category seen by both tools or by one; all eight categories appear."""
    sets = category_sets(ours, theirs)
    has = lambda col, c: F.array_contains(col, c)
    counts = sets.agg(*[
        F.struct(
            F.count_if(has("ours", c) & has("theirs", c)).alias("both"),
            F.count_if(has("ours", c) & ~has("theirs", c)).alias("our_tool_only"),
            F.count_if(~has("ours", c) & has("theirs", c)).alias("external_tool_only"),
        ).alias(c)
        for c in CANONICAL_CATEGORIES
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("finding_category"), F.col(c)["both"].alias("both"),
                 F.col(c)["our_tool_only"].alias("our_tool_only"), F.col(c)["external_tool_only"].alias("external_tool_only"))
        for c in CANONICAL_CATEGORIES
    ])
    return counts.select(F.inline(rows))


def comparison_rows(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row per hash: counts, both similarities and category lists."""
    joinlist = lambda c: F.array_join(c, "; ").alias(c)
    return _per_hash(ours, theirs).select(
        "apk_hash", "our_findings_count", "external_findings_count",
        "common_findings_count", "unique_our_tool_count", "unique_external_tool_count",
        jaccard_counts(F.col("common_findings_count"), F.col("unique_our_tool_count"), F.col("unique_external_tool_count"))
        .alias("finding_jaccard_similarity"),
        jaccard_counts(F.size("common_categories"), F.size("unique_our_categories"), F.size("unique_external_categories"))
        .alias("category_jaccard_similarity"),
        joinlist("common_categories"), joinlist("unique_our_categories"), joinlist("unique_external_categories"),
    )


def comparison_samples(ours: DataFrame, theirs: DataFrame, k: int = SAMPLE) -> DataFrame:
    """Up to k example signatures per hash and group: (apk_hash, side, sample)."""
    m = matched_signatures(ours, theirs)
    side = (
        F.when(F.col("in_ours") & F.col("in_theirs"), "common").when(F.col("in_ours"), "ours").otherwise("external")
    )
    label = F.concat_ws(":", "finding_category", "normalized_name")
    first = Window.partitionBy("apk_hash", "side").orderBy("label")
    return (
        m.select("apk_hash", side.alias("side"), label.alias("label"))
        .withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= k)
        .groupBy("apk_hash", "side")
        .agg(F.array_join(F.array_sort(F.collect_list("label")), "; ").alias("sample"))
    )


def tool_names(theirs: DataFrame) -> DataFrame:
    """Sorted distinct tool names as one string; the number of tools is small by nature."""
    return theirs.select("tool").distinct().agg(
        F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_list("tool")), ", "), F.lit("")), F.lit("ExternalTool"))
        .alias("comparison_tool")
    )


def comparison_totals(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    rows = comparison_rows(ours, theirs).agg(
        F.count("*").alias("total_apks_evaluated"),
        F.coalesce(F.sum("our_findings_count"), F.lit(0)).alias("our_tool_total_findings"),
        F.coalesce(F.sum("external_findings_count"), F.lit(0)).alias("external_tool_total_findings"),
        F.coalesce(F.sum("common_findings_count"), F.lit(0)).alias("overall_common_findings"),
        F.coalesce(F.sum("unique_our_tool_count"), F.lit(0)).alias("overall_unique_our_tool"),
        F.coalesce(F.sum("unique_external_tool_count"), F.lit(0)).alias("overall_unique_external_tool"),
    )
    return side_by_side(rows, tool_names(theirs))
