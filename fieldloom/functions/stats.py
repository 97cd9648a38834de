"""The quantile and rounding rules, which differ from each other and from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Nearest whole number, halves towards plus infinity."""
    return F.floor(c + 0.5)


def _pick(values: Column, index: Column) -> Column:
    return F.get(values, index.cast("int"))


def upper_quantile(values: Column, share: float) -> Column:
    """Of a sorted array, item min(n - 1, floor(share n)); null of an empty one."""
    n = F.size(values)
    return _pick(values, F.least(n - 1, F.floor(n * F.lit(share))))


def nearest_quantile(values: Column, share: float) -> Column:
    """Of a sorted array, the item nearest to share of the way; 0 of an empty one."""
    n = F.size(values)
    return F.coalesce(_pick(values, half_up((n - 1) * F.lit(share))), F.lit(0.0))


def floor_quantile(values: Column, share: float) -> Column:
    """Of a sorted array, item floor((n - 1) share)."""
    return _pick(values, F.floor((F.size(values) - 1) * F.lit(share)))


def sorted_values(c: Column) -> Column:
    """Aggregate: the non-null values of a group, sorted."""
    return F.sort_array(F.collect_list(c))


def linear_quantile(c: Column, share: float) -> Column:
    """Aggregate: the quantile with linear interpolation."""
    return F.percentile(c, F.lit(share))


def middle_median(c: Column) -> Column:
    """Aggregate: the mean of the two middle values."""
    return F.median(c)
