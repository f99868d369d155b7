"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def significant(x: Column, digits: int) -> Column:
    """Rounded to so many significant digits."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (digits - 1))
    return F.when(x == 0, 0.0).otherwise(F.round(x / power) * power)


def rotation_angle(dot: Column) -> Column:
    """The angle between two unit quaternions of this inner product."""
    return 2 * F.acos(F.least(F.abs(dot), F.lit(1.0)))


def spread_places(sizes: DataFrame, count: int) -> DataFrame:
    """Up to so many places i evenly over 0..n-1 with both ends; halves to even."""
    keys = [c for c in sizes.columns if c != "n"]
    m = F.least(F.lit(count), F.col("n"))
    rows = sizes.withColumns({"_m": m, "k": F.explode(F.sequence(F.lit(0), (m - 1).cast("int")))})
    place = F.when(F.col("_m") == 1, F.lit(0)).otherwise(F.rint(F.col("k") * (F.col("n") - 1) / (F.col("_m") - 1)))
    return rows.select(*keys, place.cast("bigint").alias("i")).distinct()


def differs(declared: Column, found: Column, tolerance: float = 1e-3) -> Column:
    """Relative difference beyond a tolerance; unknown if either is."""
    return F.abs(declared - found) > tolerance * F.abs(declared)


def power_share(values: Column, rate: float, above: float, n: int) -> Column:
    """Share of the power of a short array of n values at frequencies above a limit, without its mean, by the transform's sums."""
    import math

    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n

    def power(k: int) -> Column:
        part = lambda f: F.aggregate(F.transform(values, lambda x, i: (x - mean) * f(i * (2 * math.pi * k / n))), F.lit(0.0), lambda a, x: a + x)
        c, s = part(F.cos), part(F.sin)
        return c * c + s * s

    powers = {k: power(k) for k in range(1, n // 2 + 1)}
    high = [p for k, p in powers.items() if k * rate / n > above]
    return sum(high, F.lit(0.0)) / sum(powers.values(), F.lit(0.0))
