"""Missing values. NaN and NULL are one thing: NULL. Without ``na_rm`` one missing value makes a reduction missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(c: Column) -> Column:
    """As double, NaN turned into NULL."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def finite(c: Column) -> Column:
    """Neither missing nor infinite."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), F.lit(False))


def all_finite(cols: list[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & finite(c)
    return out


def guarded(agg: Column, c: Column, na_rm: bool) -> Column:
    """``agg`` over ``c``; missing when a value was missing and those are not to be removed."""
    return agg if na_rm else F.when(F.count(F.lit(1)) == F.count(c), agg)
