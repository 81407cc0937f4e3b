"""Outlier tests as column predicates built from already-computed statistics."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------
FENCE = 1.5  # interquartile ranges beyond the quartiles
Z_LIMIT = 3.0
MIN_VALUES = 8
# -----------------------------------------------------------------------------


def iqr_outlier(c: Column, count: int, q1: float | None, q3: float | None, k: float = FENCE) -> Column:
    """Outside the quartile fences; never true on few values, no spread, or missing."""
    if count < MIN_VALUES or q1 is None or q3 is None or q3 == q1:
        return F.lit(False)
    reach = k * (q3 - q1)
    c = c.cast("double")
    return F.coalesce((c < q1 - reach) | (c > q3 + reach), F.lit(False))


def zscore_outlier(c: Column, count: int, mean: float | None, std: float | None, limit: float = Z_LIMIT) -> Column:
    if count < MIN_VALUES or not std or mean is None:
        return F.lit(False)
    return F.coalesce(F.abs((c.cast("double") - mean) / std) > limit, F.lit(False))
