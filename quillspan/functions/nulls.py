"""Null rules of numeric columns: NaN counts as null; sums of nothing are 0; means divide by all rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: str | Column) -> Column:
    """NaN to null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def sum0(c: str | Column) -> Column:
    return F.coalesce(F.sum(clean(c)), F.lit(0.0))


def biased_mean(c: str | Column) -> Column:
    """Sum of what isn't null over the count of all rows."""
    return sum0(c) / F.count(F.lit(1))


def biased_std(c: str | Column) -> Column:
    """sqrt(max(E[x^2] - E[x]^2, 0)) with the biased means."""
    v = clean(c)
    return F.sqrt(F.greatest(biased_mean(v * v) - biased_mean(v) * biased_mean(v), F.lit(0.0)))


def finite_or_zero(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def strict_max(*cs: Column) -> Column:
    """greatest() that is null if any argument is."""
    return F.when(_any_null(cs), None).otherwise(F.greatest(*cs))


def strict_min(*cs: Column) -> Column:
    return F.when(_any_null(cs), None).otherwise(F.least(*cs))


def _any_null(cs: tuple[Column, ...]) -> Column:
    out = F.lit(False)
    for c in cs:
        out = out | c.isNull()
    return out


def row_mean(*names: str) -> Column:
    """Mean over the columns that aren't null."""
    n = sum((clean(c).isNotNull().cast("int") for c in names), F.lit(0))
    return F.try_divide(sum((F.coalesce(clean(c), F.lit(0.0)) for c in names), F.lit(0.0)), n)


def row_range(*names: str) -> Column:
    if len(names) == 1:
        return clean(names[0]) - clean(names[0])
    return F.greatest(*map(clean, names)) - F.least(*map(clean, names))
