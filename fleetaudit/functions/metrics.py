"""Set similarity, retrieval metrics, SDK levels and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.bround(both / union, 4))


def jaccard_counts(common: Column, only_a: Column, only_b: Column) -> Column:
    """Same measure from counts, for sets too large to hold as arrays."""
    union = common + only_a + only_b
    return F.when(union == 0, F.lit(1.0)).otherwise(F.bround(common / union, 4))


def _ratio(hit: Column, miss: Column) -> Column:
    return F.when(hit + miss > 0, hit / (hit + miss)).otherwise(F.lit(1.0))


def precision(tp: Column, fp: Column) -> Column:
    return F.bround(_ratio(tp, fp), 4)


def recall(tp: Column, fn: Column) -> Column:
    return F.bround(_ratio(tp, fn), 4)


def f1_score(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = _ratio(tp, fp), _ratio(tp, fn)
    return F.when(p + r > 0, F.bround(2 * p * r / (p + r), 4)).otherwise(F.lit(0.0))


def sdk_level(*sources: Column) -> Column:
    """First source that reads as an integer."""
    parsed = []
    for s in sources:
        text = strip(s.cast("string"))
        parsed.append(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("int")))
    return F.coalesce(*parsed)


def tri_state(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)


def version_label(name: Column, code: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), code)


def parse_iso(c: Column) -> Column:
    """ISO-8601 text to an instant; a missing zone means UTC (the session zone)."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def fixed(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))


def format_iso(ts: Column) -> Column:
    """ISO-8601 in UTC, fraction only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(""), F.lit("+00:00"))


def duration_seconds(start: Column, end: Column) -> Column:
    elapsed = (F.unix_micros(end) - F.unix_micros(start)).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(10,0)")
    return F.greatest(F.lit(0.001), F.bround(elapsed, 3).cast("double"))
