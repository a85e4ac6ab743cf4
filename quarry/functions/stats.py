"""Ratios, percentiles and intervals as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """The double that a text spells, with white space about it or not; null of anything else, type letters as in 1d included."""
    plain = F.trim(c).rlike(r"(?i)^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?|nan)$")
    return F.when(plain, F.trim(c).try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b)


def nearest_rank(c: str, p: float = 0.95) -> Column:
    """The ceil(p n)-th smallest non-null value of a column named c; null of none."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def wilson(correct: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval's ends, within 0 and 1."""
    p = ratio(correct, n)
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def beta_mean(correct: Column, n: Column) -> Column:
    """Mean of the posterior of a uniform prior."""
    return (correct + 1) / (n + 2)


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def steady_avg(c: Column, places: int = 12) -> Column:
    """An average that does not hang on the order of rows: values count to so many places, up to 10**16."""
    return ratio(F.sum(c.cast(f"decimal({16 + places},{places})")), F.count(c))
