"""Pitch measures of a take from its frame series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import finite, semitones
from .ordered import Hot, join_null_safe, quantile_neighbours

END_WINDOW = 0.55
TAIL_WINDOW, PREVIOUS_WINDOW = 0.25, 0.60
RELEASE_WINDOW = 0.20
EDGE_FRAMES = 5
MIN_SECONDS, MIN_VOICED = 0.25, 10


def _edge(voiced: DataFrame, keys: list[str], name: str, order: Column) -> DataFrame:
    """Median of the first frames in an order; the window group limit cuts before the shuffle."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    few = voiced.withColumn("_r", place).where(F.col("_r") <= EDGE_FRAMES)
    return few.groupBy(*keys).agg(F.median("f0").alias(name))


def pitch(frames: DataFrame, lengths: DataFrame, keys: list[str], hot: Hot = None) -> DataFrame:
    """All pitch measures per take, unrounded; null where the take is unmeasurable.

    ``frames``: keys, t (seconds), f0 (Hz, null when unvoiced). ``lengths``:
    keys, dur. Quantiles come from distributed ranks and slopes from algebraic
    aggregates, so one very long series spreads over many tasks. The windows at
    the end hold a fixed number of frames by their length in time.
    """
    voiced = frames.withColumn("f0", finite(F.col("f0"))).where(F.col("f0").isNotNull())
    near = quantile_neighbours(voiced, keys, "f0", {"median": 0.5, "p10": 0.1, "p90": 0.9}, 1.0, hot)
    base = near.select(
        *keys,
        F.col("_count").alias("n_voiced"),
        (F.col("median_low") + (F.col("median_high") - F.col("median_low")) * F.col("median_part")).alias("median_hz"),
        *[c for c in near.columns if c.startswith(("p10_", "p90_"))],
    )

    def at(name: str) -> Column:
        low, high = (semitones(F.col(f"{name}_{s}"), F.col("median_hz")) for s in ("low", "high"))
        return low + (high - low) * F.col(f"{name}_part")

    base = base.select(*keys, "n_voiced", "median_hz", (at("p90") - at("p10")).alias("range_st"))
    ends = voiced.groupBy(*keys).agg(F.max("t").alias("_end"))
    context = join_null_safe(join_null_safe(base, ends, keys), lengths, keys)
    near_end = join_null_safe(voiced, context.select(*keys, "_end", "dur", "median_hz"), keys).where(
        (F.col("t") > F.col("dur") - END_WINDOW) | (F.col("t") > F.col("_end") - PREVIOUS_WINDOW)
    ).withColumn("st", semitones(F.col("f0"), F.col("median_hz")))
    t, end = F.col("t"), F.col("_end")
    in_slope = t > F.col("dur") - END_WINDOW
    in_tail = t > end - TAIL_WINDOW
    in_prev = (t > end - PREVIOUS_WINDOW) & (t <= end - TAIL_WINDOW)
    in_release = t > end - RELEASE_WINDOW
    shape = near_end.groupBy(*keys).agg(
        F.count_if(in_slope).alias("_ns"),
        F.regr_slope(F.when(in_slope, F.col("st")), F.when(in_slope, t)).alias("_slope"),
        F.count_if(in_tail).alias("_nt"),
        F.count_if(in_prev).alias("_np"),
        F.median(F.when(in_tail, F.col("f0"))).alias("_tail"),
        F.median(F.when(in_prev, F.col("f0"))).alias("_prev"),
        F.count_if(in_release).alias("_nr"),
        F.regr_slope(F.when(in_release, F.col("st")), F.when(in_release, t)).alias("_glide"),
        F.max_by("st", "t").alias("_last"),
        F.min(F.when(in_release, F.col("st"))).alias("_low"),
    )
    first = _edge(voiced, keys, "first_hz", F.col("t").asc())
    last = _edge(voiced, keys, "last_hz", F.col("t").desc())
    joined = lengths
    for part in (base, shape, first, last):
        joined = join_null_safe(joined, part, keys, "left")
    good = (F.col("dur") >= MIN_SECONDS) & (F.coalesce("n_voiced", F.lit(0)) >= MIN_VOICED)
    values = {
        "median_hz": F.col("median_hz"),
        "range_st": F.col("range_st"),
        "end_slope": F.when(F.col("_ns") >= 5, F.coalesce("_slope", F.lit(0.0))).otherwise(F.lit(0.0)),
        "first_hz": F.col("first_hz"),
        "last_hz": F.col("last_hz"),
        "tail_delta": F.when((F.col("_nt") >= 3) & (F.col("_np") >= 3), semitones(F.col("_tail"), F.col("_prev"))),
        "final_glide": F.when(F.col("_nr") >= 4, F.coalesce("_glide", F.lit(0.0))),
        "final_rebound": F.when(F.col("_nr") >= 4, F.col("_last") - F.col("_low")),
    }
    return joined.select(*keys, "dur", good.alias("measurable"), *[F.when(good, v).alias(n) for n, v in values.items()])


ROUNDING = {
    "dur": 3, "median_hz": 1, "range_st": 2, "end_slope": 2, "first_hz": 1, "last_hz": 1, "tail_delta": 2,
    "final_glide": 1, "final_rebound": 2,
}


def stored(measured: DataFrame) -> DataFrame:
    """Measures at the precision they are kept with."""
    return measured.withColumns({n: F.bround(n, d) for n, d in ROUNDING.items()})
