"""Archive admission and record validation."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import is_safe_entry

MIB = 1024 * 1024

# Entries that are never text, and the text suffixes that are kept.
BINARY_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".so", ".dylib",
    ".dll", ".bin", ".mp3", ".wav", ".ogg", ".ttf", ".otf", ".woff", ".arsc",
]
ARCHIVE_TEXT = [".json", ".properties", ".txt"]
SOURCE_TEXT = [".java", ".kt"]
RESOURCE_TEXT = [".xml", ".json", ".properties", ".txt"]


@dataclass(frozen=True)
class Limits:
    """Default limits."""

    archive_bytes: int = 200 * MIB
    total_bytes: int = 500 * MIB
    entries: int = 10_000
    scanned_file_bytes: int = 5 * MIB
    dex_factor: int = 10
    bomb_bytes: int = 10 * MIB
    bomb_ratio: int = 200


def is_compression_bomb(size: Column, packed: Column, limits: Limits = Limits()) -> Column:
    return (packed > 0) & (size > limits.bomb_bytes) & (size / F.nullif(packed, F.lit(0)) > limits.bomb_ratio)


def admission_verdicts(
    entries: DataFrame, archives: DataFrame | None = None, limits: Limits = Limits()
) -> DataFrame:
    """(app_id, admitted, reason): the first failing check in fixed order.

    Sums, counts and the earliest bad entry combine before the shuffle, so an
    archive with very many entries costs one row per task.  `archives` adds
    (app_id, archive_size) for the checks on the file itself.
    """
    name = F.col("entry_name")
    error = F.col("error") if "error" in entries.columns else F.lit(None)
    bad = F.when(error.isNotNull(), None).when(~is_safe_entry(name), "unsafe path").when(
        is_compression_bomb(F.col("file_size"), F.col("compress_size"), limits), "compression bomb"
    )
    per_app = entries.groupBy("app_id").agg(
        F.count("*").alias("n"),
        F.sum("file_size").alias("total"),
        F.min(F.when(bad.isNotNull(), F.struct("entry_seq", bad.alias("why"), name.alias("entry_name")))).alias("first_bad"),
        F.coalesce(F.bool_or((name == "AndroidManifest.xml") | F.endswith(name, F.lit(".dex"))), F.lit(False)).alias("android"),
        F.coalesce(F.bool_or(error.isNotNull()), F.lit(False)).alias("unreadable"),
    )
    size = F.lit(None).cast("bigint")
    if archives is not None:
        per_app = archives.select("app_id", "archive_size").join(per_app, "app_id", "left")
        size = F.col("archive_size")
    reason = (
        F.when(size == 0, "empty archive")
        .when(size > limits.archive_bytes, "archive too large")
        .when(F.coalesce("unreadable", F.lit(False)), "not a valid archive")
        .when(F.coalesce("n", F.lit(0)) > limits.entries, "too many entries")
        .when(F.col("first_bad").isNotNull(), F.concat_ws(": ", F.col("first_bad.why"), F.col("first_bad.entry_name")))
        .when(F.coalesce("total", F.lit(0)) > limits.total_bytes, "uncompressed size too large")
        .when(~F.coalesce("android", F.lit(False)), "no manifest or dex")
    )
    return per_app.select("app_id", reason.isNull().alias("admitted"), reason.alias("reason"))


def has_suffix(name: Column, suffixes: list[str]) -> Column:
    return name.rlike("(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")


def harvestable(entries: DataFrame, origin: str = "archive", limits: Limits = Limits()) -> DataFrame:
    """Entries whose content is read; decided on name and size only.

    `origin` is the tree the entries come from: `archive`, `source` (decompiled
    code) or `resource` (decoded resources).
    """
    name, size = F.col("entry_name"), F.col("file_size")
    if origin == "archive":
        dex = F.endswith(name, F.lit(".dex")) & (size <= limits.scanned_file_bytes * limits.dex_factor)
        text = has_suffix(name, ARCHIVE_TEXT) & (size <= limits.scanned_file_bytes)
        keep = is_safe_entry(name) & ~has_suffix(F.lower(name), BINARY_SUFFIXES) & (dex | text)
    else:
        suffixes = {"source": SOURCE_TEXT, "resource": RESOURCE_TEXT}[origin]
        keep = has_suffix(name, suffixes) & (size <= limits.scanned_file_bytes)
    return entries.where(keep)


def first_entries(entries: DataFrame, limit: int = Limits().entries) -> DataFrame:
    """The first `limit` entries of each application: a limit of the feature itself.

    Spark applies the limit before the shuffle too, so a task gets `limit` entries of an
    application from each task before it at most.  `skipped_entries` lists the others.
    """
    first = Window.partitionBy("app_id").orderBy("entry_seq")
    return entries.withColumn("position", F.row_number().over(first)).where(F.col("position") <= limit).drop("position")


def skipped_entries(entries: DataFrame, origin: str = "archive", limits: Limits = Limits()) -> DataFrame:
    """Entries that are not read although their name asks for it: (app_id, entry_seq, entry_name, reason).

    A row for each limit that cuts something: the size of an entry and the number of entries.
    """
    wanted = harvestable(entries, origin, replace(limits, scanned_file_bytes=2**62 // limits.dex_factor))
    large = wanted.join(harvestable(entries, origin, limits).select("app_id", "entry_seq"), ["app_id", "entry_seq"], "left_anti")
    last = first_entries(entries, limits.entries).groupBy("app_id").agg(F.max("entry_seq").alias("last"))
    beyond = entries.join(last, "app_id").where("entry_seq > last")
    shown = lambda df, why: df.select("app_id", "entry_seq", "entry_name", F.lit(why).alias("reason"))
    return shown(large, "entry too large").unionByName(shown(beyond, "too many entries"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def app_reject_reason() -> Column:
    sha = F.coalesce("sha256", F.lit(""))
    return (
        F.when(_blank("filename"), "empty filename")
        .when(_blank("package_name"), "empty package_name")
        .when(F.col("file_size") < 0, "negative file_size")
        .when(sha == "", "empty sha256")
        .when(~F.trim(sha).rlike("^[0-9a-fA-F]{64}$"), "invalid sha256")
    )


def scan_reject_reason() -> Column:
    return (
        F.when(_blank("scan_id"), "empty scan_id")
        .when(~F.coalesce(F.col("risk_score").between(0, 100), F.lit(False)), "score out of range")
        .when(F.col("duration") < 0, "negative duration")
        .when(F.col("completed_at") < F.col("started_at"), "completed before started")
    )


def finding_reject_reason() -> Column:
    return F.when(_blank("rule_id"), "empty rule_id").when(_blank("title"), "empty title")


def permission_reject_reason() -> Column:
    return F.when(_blank("permission"), "empty permission")


def validate(rows: DataFrame, reason: Column) -> DataFrame:
    """Add `reject_reason`; null marks a good row."""
    return rows.withColumn("reject_reason", reason)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = checked.where("reject_reason IS NULL").drop("reject_reason")
    return good, checked.where("reject_reason IS NOT NULL")
