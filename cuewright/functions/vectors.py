"""Array arithmetic inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """dot / sqrt(|a|^2 |b|^2), 0 where either is the zero vector."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def to_int16(samples: Column) -> Column:
    """Asymmetric PCM16 scale, rounded half to even and clamped."""
    return F.transform(
        samples,
        lambda x: F.greatest(
            F.lit(-32768),
            F.least(F.lit(32767), F.rint(x * F.when(x >= 0, 32767.0).otherwise(32768.0)).cast("int")),
        ),
    )
