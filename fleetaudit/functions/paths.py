"""Path and file-name safety predicates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip, strip_controls

# Device names that cannot be ordinary files.
RESERVED_STEMS = [
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
]


def path_stem(name: Column) -> Column:
    """Last path segment without its final extension."""
    base = F.element_at(F.split(F.regexp_replace(name, r"/+$", ""), "/"), -1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def sanitize_filename(name: Column, default: str = "unnamed.apk") -> Column:
    base = F.element_at(F.split(F.replace(strip_controls(name), F.lit("\\"), F.lit("/")), "/"), -1)
    trimmed = F.btrim(strip(base), F.lit(". "))
    cleaned = F.regexp_replace(trimmed, r"\.\.+", "")
    reserved = F.upper(path_stem(cleaned)).isin(RESERVED_STEMS)
    safe = F.when(reserved, F.concat(F.lit("safe_"), cleaned)).otherwise(cleaned)
    return F.when(F.coalesce(F.length(cleaned), F.lit(0)) == 0, F.lit(default)).otherwise(safe)


def is_safe_entry(name: Column) -> Column:
    """Archive entry name that cannot escape its extraction folder."""
    p = F.replace(name, F.lit("\\"), F.lit("/"))
    unsafe = (
        (F.length(p) == 0)
        | F.contains(p, F.lit("\x00"))
        | F.startswith(p, F.lit("/"))
        | (F.substring(p, 2, 1) == ":")
        | F.array_contains(F.split(p, "/"), "..")
    )
    return F.coalesce(~unsafe, F.lit(False))


def is_valid_output_path(path: Column) -> Column:
    bad = F.contains(path, F.lit("\x00")) | F.upper(path_stem(path)).isin(RESERVED_STEMS)
    return F.coalesce(~bad, F.lit(False))


def class_from_path(path: Column) -> Column:
    """Class name of a source file: tool prefix off, extension off, dots for slashes."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^jadx/", ""), r"^apktool/", "")
    return F.translate(F.regexp_replace(bare, r"\.[^.]*$", ""), "/\\", "..")


def package_from_class(name: Column) -> Column:
    """Everything before the last dot; null when there is no dot."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))
