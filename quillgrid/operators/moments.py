"""Single-pass statistics with the missing-value rules of the profile."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(c: Column) -> Column:
    """Sum over count, so that exact (decimal) sums give exact means."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def total(c: Column) -> Column:
    """Sum that is zero, not null, over no values."""
    return F.coalesce(F.sum(c), F.lit(0))


def steady_sum(c: Column) -> Column:
    """Sum of doubles whose shown digits do not depend on the order of the rows.

    Whole parts add exactly; what is below one stays too small to lose digits.
    """
    c = c.cast("double")
    whole = F.rint(c)
    return F.sum(whole) + F.sum(F.nanvl(c - whole, F.lit(0.0)))


def steady_total(c: Column) -> Column:
    return F.coalesce(steady_sum(c), F.lit(0.0))


def steady_mean(c: Column) -> Column:
    return F.try_divide(steady_sum(c), F.count(c).cast("double"))


def sample_std(c: Column) -> Column:
    """Sample deviation; zero for one value, null for none."""
    c = c.cast("double")
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))


def adjusted_skew(c: Column) -> Column:
    """Bias-corrected skew; null up to two values, zero for a constant."""
    c = c.cast("double")
    n = F.count(c).cast("double")
    correction = F.try_divide(F.sqrt(n * (n - 1)), n - 2)
    raw = F.when(F.stddev_pop(c) == 0, F.lit(0.0)).otherwise(F.skewness(c))
    return F.when(n > 2, raw * correction)


def pearson(a: Column, b: Column, complete: bool = False) -> Column:
    """Correlation over rows where both are present; null when either is constant.

    Pass `complete` when neither column has gaps: the deviations are then the same
    expressions for every pair, and the planner computes each only once.
    """
    x, y = a.cast("double"), b.cast("double")
    if not complete:
        both = a.isNotNull() & b.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
