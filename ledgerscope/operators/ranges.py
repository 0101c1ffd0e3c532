"""Rows cut into ordered ranges of bounded size, and what runs across all of them.

A table in a global order is written once, dealt out by Spark's range partitioning over all
the keys of the order: splitters of equal depth from a sample, the tie among them, so a value
that fills most of the table is split like any other. The rows of every range are counted;
were one to hold more than the bound, the table is cut finer. What came before a range is
known from one row of totals for each range, so positions and running sums are exact and
no task ever orders more than the bound. Tables within the bound are one range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

RANGE = "__range"
ROWS = 1_000_000  # the bound
_FINER = 4  # times a table is cut finer; rows equal in all keys cannot be told apart
_ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def ranged(df: DataFrame, keys: list[Column], rows: int | None = None) -> tuple[DataFrame, bool]:
    """``df`` with RANGE: ranges follow each other in the order of ``keys``; none holds more than ``rows``.

    Also says whether all of it is one range.
    """
    limit = rows or ROWS
    parts = max(1, -(-2 * df.count() // limit))
    if parts <= 2:  # at most the bound
        return df.withColumn(RANGE, F.lit(0)), True
    for _ in range(_FINER):
        table = stored(df.repartitionByRange(parts, *keys).withColumn(RANGE, F.spark_partition_id()), "ranges")
        widest = table.groupBy(RANGE).count().agg(F.max("count")).first()[0]
        if widest <= limit:
            break
        parts *= 2
    return table, False


def numbered(df: DataFrame, keys: list[Column], name: str, rows: int | None = None, first: int = 1) -> DataFrame:
    """``df`` with the position of each row in the order of ``keys``, counted from ``first``.

    Rows are sorted inside their range where they arrive, and numbered by Spark's own row
    ids: one shuffle, no window.
    """
    limit = rows or ROWS
    parts = max(1, -(-2 * df.count() // limit))
    row_id = F.monotonically_increasing_id().alias("__id")
    sorted_ = stored(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("*", row_id), "numbered")
    with_range = sorted_.withColumn(RANGE, F.shiftright("__id", _ROW_BITS))
    starts = before(with_range, {"n": F.lit(1)}).select(F.col(RANGE).alias("__r"), F.col("before_n"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    joined = with_range.join(F.broadcast(starts), F.col(RANGE) == F.col("__r"))
    return joined.withColumn(name, F.col("before_n") + inside + first).drop(RANGE, "__id", "__r", "before_n")


def before(table: DataFrame, sums: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """(by, RANGE, before_*, all_*): the sums of all earlier ranges and of all ranges; one row a range, so safe to broadcast."""
    by = list(by)
    totals = table.groupBy(*by, RANGE).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return totals.select(
        *by, RANGE,
        *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"before_{n}") for n in sums],
        *[F.sum(f"__t_{n}").over(every).alias(f"all_{n}") for n in sums])


def running(table: DataFrame, keys: list[Column], sums: dict[str, Column], by: list[str] = (), single: bool = False) -> DataFrame:
    """A ranged table with ``cum_*`` (up to and including the row) and ``all_*`` for each sum.

    ``single`` says that the table is one range: nothing comes before it.
    """
    by = list(by)
    inside = Window.partitionBy(*by, RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, RANGE).orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = table.select("*", *[F.sum(c).over(inside).alias(f"__o_{n}") for n, c in sums.items()],
                       *([F.sum(c).over(whole).alias(f"all_{n}") for n, c in sums.items()] if single else []))
    if single:
        return own.withColumnsRenamed({f"__o_{n}": f"cum_{n}" for n in sums}).drop(RANGE)
    heads = before(table, sums, by)
    heads = heads.select(*[F.col(c).alias(f"__k_{c}") for c in [*by, RANGE]], *[c for c in heads.columns if c not in [*by, RANGE]])
    same = F.lit(True)
    for c in [*by, RANGE]:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    joined = own.join(F.broadcast(heads) if not by else heads, same)
    return joined.withColumns({f"cum_{n}": F.col(f"before_{n}") + F.col(f"__o_{n}") for n in sums}).drop(
        RANGE, *[f"__k_{c}" for c in [*by, RANGE]], *[f"before_{n}" for n in sums], *[f"__o_{n}" for n in sums])

