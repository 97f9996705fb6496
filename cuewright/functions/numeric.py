"""Numbers: missing stays missing, and nothing divides by zero."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

INF = float("inf")


def finite(c: Column) -> Column:
    """NaN and infinities count as missing evidence."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where the bottom is null or 0."""
    return F.try_divide(top.cast("double"), F.nullif(bottom.cast("double"), F.lit(0.0)))


def semitones(hz: Column, base: Column | float, log2: Callable[[Column], Column] = F.log2) -> Column:
    base = base if isinstance(base, Column) else F.lit(float(base))
    return F.lit(12.0) * log2(hz / base)


def c_log2(c: Column) -> Column:
    """``log2`` of the C library, to its last bit; Spark's own is a quotient of two logarithms."""

    def of(values: pd.Series) -> pd.Series:
        return pd.Series([math.log2(v) if v > 0 else None for v in values], dtype="float64")

    return F.pandas_udf(of, DoubleType())(c)


def c_exp2(c: Column) -> Column:
    """``pow(2, c)`` of the C library, to its last bit."""

    def of(values: pd.Series) -> pd.Series:
        return pd.Series([2.0**v for v in values], dtype="float64")

    return F.pandas_udf(of, DoubleType())(c)


def clamp(c: Column, low: float, high: float) -> Column:
    # greatest/least skip nulls, so null has to be kept explicitly
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def sigmoid(c: Column, limit: float = 700.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clamp(c, -limit, limit)))


def outside(c: Column, band: tuple[float, float]) -> Column:
    return (c < F.lit(band[0])) | (c > F.lit(band[1]))


def half_even(c: Column, digits: int) -> Column:
    return F.bround(c, digits)


def reasons(*pairs: tuple[Column, str | Column]) -> Column:
    """Ordered list of the codes whose condition holds; a null condition does not."""
    return F.array_compact(
        F.array(*[F.when(c, code if isinstance(code, Column) else F.lit(code)) for c, code in pairs])
    )


def derive_seed(base: Column, first: Column, second: Column, modulus: int = 2**31 - 1) -> Column:
    """(base + 104729*first + 7919*second) mod modulus, on bigints."""
    total = base.cast("bigint") + F.lit(104729) * first.cast("bigint") + F.lit(7919) * second.cast("bigint")
    return F.pmod(total, F.lit(modulus).cast("bigint"))
