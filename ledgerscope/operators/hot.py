"""Time slices for keys that hold more rows than one task should carry.

Histories are computed per key. A key below the row limit keeps its history in
one group; a key above it is cut along time into slices of bounded size, and the
operators in ``causal`` and ``firsts`` stitch the slices together exactly.

Finding the hot keys is a small job of its own (a count per key), so that a table
without any gets a plan without any of the stitching.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MINUTE_US
from ..session import stored

DEFAULT_LIMIT = 1_000_000

SLICE = "__slice"
START = "__start"
WIDTH = "__width"


#: Rows of a payment table that one task sorts for the histories of a key.
TASK_ROWS = 100_000


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int | None:
    """How many tasks share the table out by key, so that a task's memory does not grow with it.

    None for a small table, which is left to Spark. Spark sizes tasks by shuffled bytes; a
    history sorts its rows once per order, which takes many times those.
    """
    n = df.count()
    return max(-(-n // rows), df.sparkSession.sparkContext.defaultParallelism) if n > rows else None


def dealt(df: DataFrame, key: list[str], tasks: int | None) -> DataFrame:
    """Rows dealt out by key, to so many tasks if a number is given."""
    cols = [F.col(c) for c in key]
    return df.repartition(tasks, *cols) if tasks else df.repartition(*cols)


def hot_slices(
    df: DataFrame,
    key: list[str],
    order: str,
    limit: int = DEFAULT_LIMIT,
    grain: int = MINUTE_US,
) -> DataFrame | None:
    """One row per hot key: where its slices start and how wide they are.

    None when no key is hot. The width is a whole number of grains, chosen from
    the busiest grain of the key so that no slice exceeds the limit (or spans a
    single grain).
    """
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    hot = stored(counts.filter(F.col("__n") > limit).select(*key), "hot")
    return _cut(df, hot, key, order, limit, grain)


def hot_entities(
    df: DataFrame, entities: dict[str, list[str]], order: str, limit: int = DEFAULT_LIMIT
) -> dict[str, DataFrame | None]:
    """Slice tables of several single-column keys from one counting job.

    ``entities`` maps a key name to the columns that can hold such a key; its
    slice table has a column of that name.
    """
    seen = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("id"))
        for k, cols in entities.items() for c in cols
    ])
    counts = (
        df.select(F.explode(seen).alias("s"))
        .filter("s.id IS NOT NULL")
        .groupBy("s.kind", "s.id")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    hot = stored(counts.filter(F.col("__n") > limit).select("kind", "id"), "hot")
    kinds = {row["kind"] for row in hot.select("kind").distinct().collect()}
    out: dict[str, DataFrame | None] = {}
    for k, cols in entities.items():
        if k not in kinds:
            out[k] = None
            continue
        rows = None
        for c in cols:
            part = df.select(F.col(c).cast("string").alias(k), order)
            rows = part if rows is None else rows.unionByName(part)
        found = _cut(rows, hot.filter(F.col("kind") == k).select(F.col("id").alias(k)), [k], order, limit, MINUTE_US)
        out[k] = found.withColumn(k, F.col(k).cast(df.schema[cols[0]].dataType)) if found is not None else None
    return out


def _cut(df: DataFrame, hot: DataFrame, key: list[str], order: str, limit: int, grain: int) -> DataFrame | None:
    """The slice table of the hot keys, written once: it may hold any number of keys."""
    if hot.isEmpty():
        return None
    per_grain = (
        df.select(*key, order)
        .join(hot, key)
        .groupBy(*key, F.floor(F.col(order) / F.lit(grain)).alias("__g"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    slices = per_grain.groupBy(*key).agg(
        (F.min("__g") * grain).alias(START),
        (F.greatest(F.lit(1), F.floor(F.lit(limit) / F.max("__n"))) * grain).alias(WIDTH),
    )
    return stored(slices, "slices")


def with_slice(df: DataFrame, hot: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds the slice number: 0 for ordinary keys, time-based for hot ones."""
    number = F.floor((F.col(order) - F.col(START)) / F.col(WIDTH)).cast("long")
    return (
        df.join(hot, key, "left")
        .withColumns({SLICE: F.coalesce(number, F.lit(0).cast("long")), "__hot": F.col(START).isNotNull()})
        .drop(START, WIDTH)
    )
