"""First sightings and recent values within a key's history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import SLICE, dealt, with_slice


def first_seen(
    df: DataFrame,
    key: list[str],
    order: str,
    tie: str,
    values: dict[str, str],
    recent: tuple[str, str, int] | None = None,
    hot: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """For each named value column adds two flags.

    ``<name>_new``: 1 if the key never met this value strictly before the row.
    ``<name>_first``: 1 on exactly one row per (key, value), the earliest.
    Both are 0 where the value is NULL.

    ``recent = (name, column, n)`` also adds the last ``n`` values of a column as
    an array. One shuffle on the key serves all of it; only the sorts differ.
    ``hot`` is the slice table of the key, None when no key is hot; ``tasks`` is how
    many tasks share the rows (Spark's choice by default).
    """
    if hot is None:
        return _flags(df, key, order, tie, values, recent, tasks)
    sliced = with_slice(df, hot, key, order)
    group = [*key, SLICE]
    ordinary = _flags(sliced.filter(~F.col("__hot")), group, order, tie, values, recent, tasks)
    busy = sliced.filter("__hot")
    stitched = _flags(busy, group, order, tie, values, recent, tasks)
    for name, value in values.items():
        home = busy.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(SLICE).alias("__home"))
        at_home = F.coalesce(F.col("__home") == F.col(SLICE), F.lit(False)).cast("int")
        stitched = (
            stitched.join(home, [*key, value], "left")
            .withColumns({f"{name}_{s}": F.col(f"{name}_{s}") * at_home for s in ("new", "first")})
            .drop("__home")
        )
    if recent:
        stitched = _stitch_recent(stitched, busy, key, order, tie, recent)
    return ordinary.unionByName(stitched).drop(SLICE, "__hot")


def _flags(df: DataFrame, group, order, tie, values, recent, tasks=None) -> DataFrame:
    cols = {}
    for name, value in values.items():
        by_value = Window.partitionBy(*group, value).orderBy(order, tie)
        seen = F.col(value).isNotNull()
        cols[f"{name}_new"] = (seen & (F.col(order) == F.first(order).over(by_value))).cast("int")
        cols[f"{name}_first"] = (seen & (F.row_number().over(by_value) == 1)).cast("int")
    if recent:
        name, value, n = recent
        cols[name] = F.collect_list(value).over(
            Window.partitionBy(*group).orderBy(order, tie).rowsBetween(-n, -1))
    return dealt(df, group, tasks).withColumns(cols)


def _stitch_recent(stitched: DataFrame, busy: DataFrame, key, order, tie, recent) -> DataFrame:
    """Puts the newest values of earlier slices in front of a slice's own."""
    name, value, n = recent
    group = [*key, SLICE]
    newest = Window.partitionBy(*group).orderBy(F.desc(order), F.desc(tie))
    # Each slice keeps its last n; the n slices before this one are enough,
    # since every slice holds at least one row.
    tail = (
        busy.select(*group, order, tie, value, F.row_number().over(newest).alias("__r"))
        .filter(F.col("__r") <= n)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct(
            F.col(order).alias("o"), F.col(tie).alias("t"), F.col(value).alias("v")))).alias("__tail"))
    )
    before = Window.partitionBy(*key).orderBy(SLICE).rowsBetween(-n, -1)
    tail = tail.select(
        *group, F.transform(F.flatten(F.collect_list("__tail").over(before)), lambda s: s["v"]).alias("__tail"))
    both = F.concat(F.coalesce(F.col("__tail"), F.array().cast("array<double>")), F.col(name))
    return (
        stitched.join(tail, group, "left")
        .withColumn(name, F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), n))
        .drop("__tail")
    )


def linear_percentile(ordered: Column, q: float) -> Column:
    """Percentile of a sorted array with linear interpolation; NULL for an empty array."""
    a = ordered
    at = (F.size(a) - 1) * F.lit(q)
    lo = F.floor(at).cast("int")
    hi = F.least(lo + 1, F.size(a) - 1)
    low, high = F.get(a, lo), F.get(a, hi)
    return F.when(F.size(a) > 0, low + (high - low) * (at - lo))
