"""Interval and ratio formulas as column expressions (no UDF, all in generated code)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """Division that yields null, not an error, when nothing was counted."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(x: Column, n: Column, z: float | Column, lo_centred: bool = True) -> tuple[Column, Column]:
    """Wilson score bounds of x out of n, in counts rather than proportions."""
    shift = F.lit(z * z / 2.0)
    spread = F.lit(z) * F.sqrt(ratio(x * (n - x), n) + F.lit(z * z / 4.0))
    scale = n + F.lit(z * z)
    low_centre = x + shift if lo_centred else x
    return ratio(low_centre - spread, scale), ratio(x + shift + spread, scale)


def share_variance(share: Column, n: Column) -> Column:
    return ratio(share * (F.lit(1.0) - share), n)


def wald_diff_ci(
    p: Column, n: Column, q: Column, m: Column, z: float, two_sample: bool = True
) -> tuple[Column, Column, Column]:
    """p - q with the bounds for two independent proportions."""
    diff = p - q
    variance = share_variance(p, n)
    if two_sample:
        variance = variance + share_variance(q, m)
    half = F.lit(z) * F.sqrt(variance)
    return diff, diff - half, diff + half


def location_quotient(x: Column, n: Column, x_rest: Column, n_rest: Column) -> Column:
    return ratio(ratio(x, n), ratio(x_rest, n_rest))


def log_ratio_ci(
    lq: Column, x: Column, n: Column, x_rest: Column, n_rest: Column, z: float,
    two_sample: bool = True,
) -> tuple[Column, Column]:
    one = F.lit(1.0)
    variance = ratio(one, x) - ratio(one, n)
    if two_sample:
        variance = variance + ratio(one, x_rest) - ratio(one, n_rest)
    half = F.lit(z) * F.sqrt(variance)
    return F.exp(F.ln(lq) - half), F.exp(F.ln(lq) + half)


def usage_index(count: Column, people: Column, pool_count: Column, pool_people: Column) -> Column:
    return ratio(ratio(count, people), ratio(pool_count, pool_people))


def poisson_band(index: Column, count: Column, z: float) -> tuple[Column, Column]:
    margin = ratio(F.lit(z), F.sqrt(count))
    return index * (F.lit(1.0) - margin), index * (F.lit(1.0) + margin)


def per_residents(count: Column, people: Column, base: float | Column) -> Column:
    return ratio(count * F.lit(base).cast("double"), people)


def rest_of_parent(
    parent_x: Column, x: Column, parent_n: Column, n: Column
) -> tuple[Column, Column]:
    return parent_x - x, parent_n - n


def relative_error_pct(value: Column, reference: Column) -> Column:
    return ratio(F.lit(100.0) * (value - reference), F.abs(reference))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """Never null: two missing values agree, one missing value does not."""
    gone_a, gone_b = F.isnull(a) | F.isnan(a), F.isnull(b) | F.isnan(b)
    near = (a == b) | (F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return F.when(gone_a | gone_b, gone_a & gone_b).otherwise(near)


def register_sql_functions(spark: SparkSession, z: float = 1.96) -> None:
    """``wilson_lo(x, n)`` and ``wilson_hi(x, n)`` for ad-hoc SQL."""
    for name, sign in (("wilson_lo", "-"), ("wilson_hi", "+")):
        spark.sql(f"""
            CREATE OR REPLACE TEMPORARY FUNCTION {name}(x DOUBLE, n DOUBLE) RETURNS DOUBLE
            RETURN (x + {z * z / 2.0!r}D
                    {sign} {z!r}D * sqrt(x * (n - x) / n + {z * z / 4.0!r}D)) / (n + {z * z!r}D)
        """)
