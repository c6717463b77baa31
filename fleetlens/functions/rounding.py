"""Rounding as SQL engines (half away from zero) and as array libraries (half to even) do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.round(c.cast("double") * F.lit(scale)) / F.lit(scale)


def round_half_even(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of the rows where both are known; null when either does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(a))) * F.stddev_pop(F.when(both, F.col(b)))
    return F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) / F.nullif(spread, F.lit(0.0))
