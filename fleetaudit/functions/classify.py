"""Ranks, bands and category normalisers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..catalogs import CANONICAL_CATEGORIES, CATEGORY_PATTERNS, SEVERITIES
from .text import strip


def sql_literal(v: object) -> str:
    """A Python value as a SQL literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{v!r}D" if isinstance(v, float) else str(v)


def literal_case(key: Column | str, table: dict, default=None) -> Column:
    """CASE over plan-time pairs; stays inside generated code.

    `key` is a column, or SQL text, which builds the whole CASE in one step.
    """
    if isinstance(key, str):
        whens = " ".join(f"WHEN {sql_literal(k)} THEN {sql_literal(v)}" for k, v in table.items())
        return F.expr(f"CASE {key} {whens} ELSE {sql_literal(default)} END")
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def severity_rank(severity: Column) -> Column:
    return literal_case(severity, {s: i for i, s in enumerate(SEVERITIES)}, 5)


def rating_band(score: Column) -> Column:
    return (
        F.when(score >= 80, "CRITICAL")
        .when(score >= 60, "HIGH")
        .when(score >= 40, "MEDIUM")
        .when(score >= 20, "LOW")
        .otherwise("MINIMAL")
    )


def rating_level(rating: Column) -> Column:
    """Severity that corresponds to an overall rating."""
    same = {r: r for r in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    return literal_case(rating, same, "INFO")


def display_category(category: Column) -> Column:
    c = F.replace(F.upper(category), F.lit(" "), F.lit("_"))
    # Marker and display name, first match wins.
    table = [
        ("SECRET", "Secrets"),
        ("NET", "Network"),
        ("STOR", "Storage"),
        ("CRYPTO", "Cryptography"),
        ("SDK", "Third-Party SDK"),
        ("PERM", "Permissions"),
        ("MANIFEST", "Manifest"),
    ]
    out = None
    for mark, name in table:
        hit = F.contains(c, F.lit(mark))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def _at_word(pattern: str) -> str:
    """The same alternatives behind one word boundary, so they are tried where a word starts and not at every letter."""
    flag, bound = "(?i)", r"\b"
    words = pattern.removeprefix(flag).split("|")
    if not pattern.startswith(flag) or "(" in pattern[len(flag):] or not all(w.startswith(bound) for w in words):
        return pattern
    return f"{flag}{bound}(?:{'|'.join(w.removeprefix(bound) for w in words)})"


def canonical_category(raw: Column) -> Column:
    text = F.coalesce(raw, F.lit(""))
    exact = F.upper(strip(text))
    out = F.when(exact == "", "OTHER").when(exact.isin(CANONICAL_CATEGORIES), exact)
    for pattern, name in CATEGORY_PATTERNS:
        out = out.when(text.rlike(_at_word(pattern)), name)
    return out.otherwise("OTHER")
