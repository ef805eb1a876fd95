"""Concentration at the extremes and the population shares it is built from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayweave import constants as C


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ice(a, b, rest, share_a: float, share_b: float) -> Column:
    """Index in [-1, 1] of extreme ``a`` against ``b``, each relative to its overall share.

    NULL where nobody is counted.
    """
    high, low = _col(a) / share_a, _col(b) / share_b
    return F.try_divide(high - low, high + low + _col(rest) / (1 - share_a - share_b))


def ice_birth(a, b, rest) -> Column:
    return ice(a, b, rest, C.SHARE_NATIVE, C.SHARE_OTHER)


def ice_income(a, b, rest) -> Column:
    return ice(a, b, rest, C.SHARE_LOW_INCOME, C.SHARE_HIGH_INCOME)


def ice_group(value) -> Column:
    """Three groups of the index: 0 low, 1 balanced, 2 high."""
    low, high = C.ICE_GROUP_BOUNDS
    value = _col(value)
    return F.when(value < low, 0).when(value < high, 1).otherwise(2)


def null_safe_sum(*cols) -> Column:
    """Row-wise sum that reads NULL as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(_col(c).cast("double"), F.lit(0.0))
    return total


def share(part, whole) -> Column:
    """``part / whole``; zero when either is missing or the whole is zero."""
    return F.coalesce(F.try_divide(_col(part).cast("double"), _col(whole)), F.lit(0.0))
