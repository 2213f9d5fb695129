"""Catalog readers and replacement catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import catalogs as C
from ..operators.permissions import CATALOG_SCHEMA

SDK_SCHEMA = (
    "id string, name string, category string, package_pattern string, description string, "
    "sensitive_families array<string>"
)
TRACKING_SCHEMA = "domain string, name string, category string"
INDICATOR_SCHEMA = "indicator_id string, name string, regex string, severity string, description string"

# A catalog becomes literals of the plan; more rows than this are refused.
MAX_LITERAL_ROWS = 2_000


def built_in(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = {
        "permissions": (C.PERMISSIONS, CATALOG_SCHEMA),
        "families": (C.PERMISSION_FAMILIES, "family string, display_name string, user_summary string"),
        "sdks": (C.SDKS, SDK_SCHEMA),
        "legacy_sdks": (C.LEGACY_SDKS, SDK_SCHEMA),
        "tracking": (C.TRACKING_DOMAINS, TRACKING_SCHEMA),
        "indicators": (C.TRACKING_INDICATORS, INDICATOR_SCHEMA),
    }[name]
    return spark.createDataFrame(rows, schema)


def read_catalog(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Catalog rows from JSON: the section of the document, exploded."""
    if name == "permissions":
        fields = ", ".join(c for c in CATALOG_SCHEMA.split(", ") if not c.startswith("permission "))
        value = "struct<" + ",".join(f.replace(" ", ":", 1) for f in fields.split(", ")) + ">"
        doc = spark.read.schema(f"permissions map<string,{value}>").json(path, multiLine=True)
        return doc.select(F.explode("permissions").alias("permission", "v")).select("permission", "v.*")
    section, schema = {
        "sdks": ("sdk_definitions", SDK_SCHEMA),
        "tracking": ("tracking_domains", TRACKING_SCHEMA),
        "indicators": ("tracking_indicators", INDICATOR_SCHEMA),
    }[name]
    value = "array<struct<" + ",".join(f.strip().replace(" ", ":", 1) for f in schema.split(", ")) + ">>"
    doc = spark.read.schema(f"{section} {value}").json(path, multiLine=True)
    return doc.select(F.inline(section))


def as_literals(catalog: DataFrame, limit: int = MAX_LITERAL_ROWS) -> list[tuple]:
    """Bring a replacement catalog into the plan, after checking its size."""
    rows = catalog.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"catalog has more than {limit} rows; join it as a table instead")
    return [tuple(r) for r in rows]
