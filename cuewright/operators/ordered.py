"""Row numbers, lags and running totals that survive a hot key.

A plain window over ``partitionBy(key)`` sends all rows of one key to one task.
Here the caller names a *chunk*: an expression that never decreases along the
order (a prefix of it); where the order puts nulls first, so does the chunk. Keys,
order and chunk may be null: a null key is a key like any other. The work then
has two levels:

* inside (key, chunk): a normal window, so a hot key spreads over its chunks;
* across chunks: one pre-aggregated row per (key, chunk), combined map-side,
  with a window over those few rows giving what each chunk inherits.

Both levels are ordinary DataFrame operations and give exactly what the plain
window would.

Without further knowledge every key is treated this way. ``hot`` names the keys
that need it (see ``hot_keys``): all others then take the plain window, one
shuffle, and an empty list means that no key does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut_lineage


def _chunked(df: DataFrame, keys: list[str], chunk: list[Column]) -> tuple[DataFrame, list[str]]:
    """The rows dealt out by (key, chunk), so that no window inherits a layout by key alone."""
    names = [f"_chunk{i}" for i in range(len(chunk))]
    base = df.withColumns(dict(zip(names, chunk)))
    return base.repartition(*[F.col(c) for c in [*keys, *names]]), names


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Joins on columns of one name where null equals null; ``right`` brings its other columns."""
    other = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = reduce(lambda a, c: a & c, [left[c].eqNullSafe(other[f"_on_{c}"]) for c in on])
    return left.join(other, same, how).drop(*[f"_on_{c}" for c in on])


#: Rows of one key that a task can sort; keys with more are hot. Not relative to the table.
HOT_ROWS = 1_000_000
SAMPLE_ROWS = 1_000_000
#: With more hot keys than this, all keys take the chunked plan and none is listed.
MOST_KEYS = 1_000
Hot = list[tuple] | None


def hot_keys(table: DataFrame, keys: list[str], min_rows: int = HOT_ROWS, most: int = MOST_KEYS) -> Hot:
    """Keys that hold at least ``min_rows`` rows, or None (treat every key as hot) if there are many.

    Meant for stored tables, whose row count comes from file footers. A sample of
    the key columns is enough: it only decides which of two exact plans a key
    gets. Tables too small to hold a hot key are not read at all.
    """
    total = table.count()
    if total < min_rows:
        return []
    fraction = min(1.0, SAMPLE_ROWS / total)
    seen = table.select(*keys).sample(fraction, seed=1).groupBy(*keys).count()
    found = seen.where(F.col("count") >= min_rows * fraction).limit(most + 1).collect()
    return None if len(found) > most else [tuple(r)[: len(keys)] for r in found]


def parts_by_heat(df: DataFrame, keys: list[str], hot: Hot) -> list[tuple[DataFrame, Hot]]:
    """The rows in parts, each with what ``hot`` says of it: [] where no key is hot, None where every key counts as hot."""
    if not hot or not keys:
        return [(df, hot if keys else None)]
    # at most MOST_KEYS rows, so the list is broadcast
    marks = F.broadcast(df.sparkSession.createDataFrame(hot, df.select(*keys).schema))
    return [(join_null_safe(df, marks, keys, "left_anti"), []), (join_null_safe(df, marks, keys, "left_semi"), None)]


def _by_heat(df: DataFrame, keys: list[str], hot: Hot, plain, chunked) -> DataFrame:
    parts = [chunked(part) if heat is None else plain(part) for part, heat in parts_by_heat(df, keys, hot)]
    return reduce(DataFrame.unionByName, parts)


def number_rows(
    df: DataFrame, keys: list[str], order: list[Column], chunk: list[Column], name: str, hot: Hot = None
) -> DataFrame:
    """1-based row number within the keys."""

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))

    def chunked(part: DataFrame) -> DataFrame:
        base, marks = _chunked(part, keys, chunk)
        within = W.partitionBy(*keys, *marks).orderBy(*order)
        earlier = W.partitionBy(*keys).orderBy(*marks).rowsBetween(W.unboundedPreceding, -1)
        sizes = base.groupBy(*keys, *marks).agg(F.count(F.lit(1)).alias("_n"))
        starts = sizes.select(*keys, *marks, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
        return (
            join_null_safe(base.withColumn("_local", F.row_number().over(within)), starts, [*keys, *marks])
            .withColumn(name, (F.col("_start") + F.col("_local")).cast("bigint"))
            .drop("_local", "_start", *marks)
        )

    return _by_heat(df, keys, hot, plain, chunked)


def number_with_next(
    df: DataFrame, keys: list[str], order: list[Column], chunk: list[Column], name: str, following: dict[str, str], hot: Hot = None
) -> DataFrame:
    """1-based row number within the keys, and ``lead(column, 1)`` for each ``{new name: column}``, in one pass."""
    packed = F.struct(*[F.col(c).alias(new) for new, c in following.items()])

    def plain(part: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*order)
        return part.withColumns({name: F.row_number().over(w).cast("bigint"), **{new: F.lead(c).over(w) for new, c in following.items()}})

    def chunked(part: DataFrame) -> DataFrame:
        base, marks = _chunked(part, keys, chunk)
        within = W.partitionBy(*keys, *marks).orderBy(*order)
        across = W.partitionBy(*keys).orderBy(*marks)
        local = base.withColumns({"_local": F.row_number().over(within), "_row_next": F.lead(packed).over(within)})
        pieces = local.groupBy(*keys, *marks).agg(F.count(F.lit(1)).alias("_n"), F.min_by(packed, "_local").alias("_head"))
        inherited = pieces.select(
            *keys, *marks, F.coalesce(F.sum("_n").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
            F.lead("_head").over(across).alias("_chunk_next"),
        )
        return (
            join_null_safe(local, inherited, [*keys, *marks])
            .withColumns({name: (F.col("_start") + F.col("_local")).cast("bigint"), "_found": F.coalesce("_row_next", "_chunk_next")})
            .withColumns({new: F.col(f"_found.{new}") for new in following})
            .drop("_local", "_row_next", "_start", "_chunk_next", "_found", *marks)
        )

    return _by_heat(df, keys, hot, plain, chunked)


def previous_row(
    df: DataFrame, keys: list[str], order: list[str], chunk: list[Column], columns: dict[str, str], hot: Hot = None
) -> DataFrame:
    """``lag(column, 1)`` for each ``{new name: column}``; order columns ascend."""
    packed = F.struct(*[F.col(c).alias(new) for new, c in columns.items()])

    def plain(part: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*order)
        return part.withColumns({new: F.lag(c).over(w) for new, c in columns.items()})

    def chunked(part: DataFrame) -> DataFrame:
        base, marks = _chunked(part, keys, chunk)
        within = W.partitionBy(*keys, *marks).orderBy(*order)
        across = W.partitionBy(*keys).orderBy(*marks)
        tails = base.groupBy(*keys, *marks).agg(F.max_by(packed, F.struct(*order)).alias("_tail"))
        inherited = tails.select(*keys, *marks, F.lag("_tail").over(across).alias("_chunk_before"))
        return (
            join_null_safe(base.withColumn("_row_before", F.lag(packed).over(within)), inherited, [*keys, *marks])
            .withColumn("_row_found", F.coalesce("_row_before", "_chunk_before"))
            .withColumns({new: F.col(f"_row_found.{new}") for new in columns})
            .drop("_row_before", "_chunk_before", "_row_found", *marks)
        )

    return _by_heat(df, keys, hot, plain, chunked)


COMBINE: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "min": F.min}


def running_before(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    chunk: list[Column],
    totals: dict[str, tuple[str, Column]],
    hot: Hot = None,
) -> DataFrame:
    """Totals over all earlier rows (the current row excluded).

    ``totals`` maps a new name to ("sum" | "max" | "min", expression). Sums
    start at 0, extremes at null.
    """
    before = (W.unboundedPreceding, -1)

    def plain(part: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(*before)
        made = {n: COMBINE[kind](e).over(w) for n, (kind, e) in totals.items()}
        return part.withColumns({n: F.coalesce(c, F.lit(0)) if totals[n][0] == "sum" else c for n, c in made.items()})

    def merge(n: str, kind: str) -> Column:
        inside, outside = F.col(f"_l_{n}"), F.col(f"_i_{n}")
        if kind == "sum":
            return F.coalesce(inside, F.lit(0)) + F.coalesce(outside, F.lit(0))
        return (F.greatest if kind == "max" else F.least)(inside, outside)

    def chunked(part: DataFrame) -> DataFrame:
        base, marks = _chunked(part, keys, chunk)
        base = base.withColumns({f"_v_{n}": e for n, (_, e) in totals.items()})
        within = W.partitionBy(*keys, *marks).orderBy(*order).rowsBetween(*before)
        across = W.partitionBy(*keys).orderBy(*marks).rowsBetween(*before)
        pieces = base.groupBy(*keys, *marks).agg(
            *[COMBINE[kind](f"_v_{n}").alias(f"_s_{n}") for n, (kind, _) in totals.items()]
        )
        inherited = pieces.select(
            *keys, *marks, *[COMBINE[kind](f"_s_{n}").over(across).alias(f"_i_{n}") for n, (kind, _) in totals.items()]
        )
        local = base.withColumns({f"_l_{n}": COMBINE[kind](f"_v_{n}").over(within) for n, (kind, _) in totals.items()})
        out = join_null_safe(local, inherited, [*keys, *marks])
        out = out.withColumns({n: merge(n, kind) for n, (kind, _) in totals.items()})
        return out.drop(*marks, *[f"{p}{n}" for n in totals for p in ("_v_", "_l_", "_i_")])

    return _by_heat(df, keys, hot, plain, chunked)


def _in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in sampled ranges of the order, written once; ``_range`` ascends along the order, nulls first."""
    sorted_rows = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*order)
    return cut_lineage(sorted_rows.withColumn("_range", F.spark_partition_id()))


def running_in_order(df: DataFrame, order: list[str], totals: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Sums over all earlier rows, per ``keys``, which lead the order; the current row is excluded.

    Ranges are sampled, so tasks are even for any form of the order columns: a hot
    key spans several ranges. One row per (key, range) says what each inherits.
    """
    keys = keys or []
    rows = _in_ranges(df.withColumns({f"_v_{n}": e for n, e in totals.items()}), order)
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    pieces = rows.groupBy(*keys, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals])
    inherited = pieces.select(*keys, "_range", *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_i_{n}") for n in totals])
    local = rows.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in totals})
    out = join_null_safe(local, inherited, [*keys, "_range"]).withColumns({n: F.col(f"_i_{n}") + F.col(f"_l_{n}") for n in totals})
    return out.drop("_range", *[f"{p}{n}" for n in totals for p in ("_v_", "_l_", "_i_")])


def number_in_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1-based number of every row of the table along the order."""
    before = running_in_order(df, order, {"_before": F.lit(1)})
    return before.withColumn(name, (F.col("_before") + 1).cast("bigint")).drop("_before")


def quantile_neighbours(
    df: DataFrame, keys: list[str], value: str, at: dict[str, float], width: float = 1.0, hot: Hot = None
) -> DataFrame:
    """The two values around each quantile, per key, with no group gathered in one place.

    Equal values are counted map-side first; ranks come from running counts, and
    only the neighbours survive. ``width`` is the value span of one chunk. Gives
    ``_count`` and, per quantile, ``<name>_low, <name>_high, <name>_part``.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_m"))
    sizes = counted.groupBy(*keys).agg(F.sum("_m").alias("_count"))
    ranked = running_before(counted, keys, [F.col(value)], [F.floor(F.col(value) / width)], {"_before": ("sum", F.col("_m"))}, hot)
    ranked = join_null_safe(ranked, sizes, keys) if keys else ranked.crossJoin(F.broadcast(sizes))  # one row without keys
    picks = []
    for name, p in at.items():
        position = (F.col("_count") - 1) * F.lit(float(p))
        for side, rank in (("low", F.floor(position)), ("high", F.ceil(position))):
            holds = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_m"))
            picks.append(F.max(F.when(holds, F.col(value))).alias(f"{name}_{side}"))
        picks.append(F.max(position - F.floor(position)).alias(f"{name}_part"))
    return ranked.groupBy(*keys, "_count").agg(*picks)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, at: dict[str, float], width: float = 1.0
) -> DataFrame:
    """Linear-interpolated quantiles per key, plus ``_count``."""
    near = quantile_neighbours(df, keys, value, at, width)
    blend = lambda n: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col(f"{n}_part")
    return near.select(*keys, "_count", *[blend(n).alias(n) for n in at])


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Callable[[], Callable[[tuple, Iterable[tuple]], list[tuple]]],
    schema: str,
) -> DataFrame:
    """A strictly sequential rule, streamed over each key in order.

    Only for rules whose next step depends on the outcome of the last one. Spark
    partitions by key and sorts on disk; a task then holds the state of one key
    and one Arrow batch, never a whole group. ``fold()`` makes a handler per
    task, called with (key, rows of that key in this batch) in order; rows are
    tuples of the non-key columns, results tuples of the schema's columns.
    """
    rest = [c for c in df.columns if c not in keys]
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterable[pd.DataFrame]):
        handle = fold()
        for batch in batches:
            if batch.empty:
                continue
            marks = list(zip(*[batch[k].tolist() for k in keys]))
            rows = list(zip(*[batch[c].tolist() for c in rest]))
            out: list[tuple] = []
            start = 0
            for stop in range(1, len(marks) + 1):
                if stop == len(marks) or marks[stop] != marks[start]:
                    out.extend(handle(marks[start], rows[start:stop]))
                    start = stop
            if out:
                yield pd.DataFrame(out, columns=names)

    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
