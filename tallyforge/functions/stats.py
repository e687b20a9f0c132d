"""Statistics written as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when den is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def wilson_bounds(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval clipped to [0, 1]; NULL when n is 0."""
    size = F.when(n > 0, n.cast("double"))
    share = k.cast("double") / size
    scale = 1 + F.lit(z * z) / size
    middle = (share + F.lit(z * z) / (2 * size)) / scale
    half = F.lit(z) / scale * F.sqrt(share * (1 - share) / size + F.lit(z * z) / (4 * size * size))
    missing = size.isNull()
    low = F.when(~missing, F.greatest(F.lit(0.0), middle - half))
    high = F.when(~missing, F.least(F.lit(1.0), middle + half))
    return low, high


def finite(score: Column) -> Column:
    """NaN and infinities are missing scores."""
    value = score.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
