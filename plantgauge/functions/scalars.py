"""Small column expressions: durations, labels, sets, JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_between(start_us: Column, end_us: Column) -> Column:
    return (end_us - start_us) / 3.6e9


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; null where both are empty or either is null."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def json_number(x: Column, digits: int = 4) -> Column:
    """Rounded; NaN as null."""
    return F.round(F.when(F.isnan(x), None).otherwise(x), digits)


def tag_name(index: Column) -> Column:
    """Sensor index i as tag_{i + 1}, three digits."""
    return F.format_string("tag_%03d", index + 1)
