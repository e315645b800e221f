"""Numeric helpers with explicit IEEE rules.

Spark 4 runs ANSI SQL: a bare ``x / 0.0`` raises. The per-item z-score divides by
a standard deviation that may be 0 or missing, and must give the same answer as
a division with ``fill_value=0``: when exactly one operand is missing it counts
as 0, when both are missing the result is NaN, and x/0 is +inf, -inf or NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def NAN() -> Column:
    return F.lit(float("nan"))


def POS_INF() -> Column:
    return F.lit(float("inf"))


def NEG_INF() -> Column:
    return F.lit(float("-inf"))


def ieee_div(num: Column, den: Column) -> Column:
    """num / den with IEEE results for den = 0; a null operand gives null."""
    return (F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
            .when(den != 0, num / den)
            .when(num > 0, POS_INF())
            .when(num < 0, NEG_INF())
            .otherwise(NAN()))


def zscore(x: Column, mean: Column, std: Column) -> Column:
    d = x - mean
    return (F.when(d.isNull() & std.isNull(), NAN())
            .otherwise(ieee_div(F.coalesce(d, F.lit(0.0)), F.coalesce(std, F.lit(0.0)))))


def denormalise(z: Column, mean: Column, std: Column) -> Column:
    """Inverse of the z-score: back to unit sales (a missing std counts as 0)."""
    return z * F.coalesce(std, F.lit(0.0)) + mean


def ieee_status(x: Column) -> Column:
    """'finite' | '+inf' | '-inf' | 'nan' | 'null' — so result hashing never
    depends on how an engine prints non-finite doubles."""
    return (F.when(x.isNull(), "null")
            .when(F.isnan(x), "nan")
            .when(x == POS_INF(), "+inf")
            .when(x == NEG_INF(), "-inf")
            .otherwise("finite"))


def is_finite(x: Column) -> Column:
    """True for a finite number, false for null, NaN and infinities."""
    return ieee_status(x) == "finite"


def finite_or_null(x: Column) -> Column:
    return F.when(ieee_status(x) == "finite", x)


def round6(x: Column) -> Column:
    """Finite values rounded to 6 places (+ 0.0 so that -0.0 prints as 0.0)."""
    return F.round(finite_or_null(x), 6) + F.lit(0.0)
