"""The quantile definitions in use, one helper each; all are exact aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sorted(x: Column) -> Column:
    return F.array_sort(F.collect_list(x))


def nearest_rank(x: str, q: float) -> Column:
    """The least value with at least a share q of the values at or below it."""
    return F.expr(f"percentile_disc({q}) within group (order by {x})")


def linear(x: Column, q: float) -> Column:
    """Interpolated between the two nearest of n - 1 equal steps."""
    return F.percentile(x, F.lit(q))


def rounded_index(x: Column, q: float) -> Column:
    """The value at index (n - 1) q, rounded half up; for groups of bounded size."""
    s = _sorted(x)
    return F.get(s, F.floor((F.size(s) - 1) * q + 0.5).cast("int"))


def upper_median(x: Column) -> Column:
    """The upper of the two middle values; for groups of bounded size."""
    s = _sorted(x)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def averaging_median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))
