"""Row order, splits, top-k and sampling without a global sort of the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CALIBRATION_SIZE, TEST_SIZE
from ..functions.columns import uniform
from ..session import stored
from . import ranges

_BINS = 65_536
_SORTED = 100_000  # rows around a boundary that are sorted at once
_SPLITS = 64  # values that cut the ids of one instant into ranges


def nth_value(df: DataFrame, col: str, n: int) -> tuple[int, int]:
    """The n-th smallest (0-based) value of a whole-number column, and how many rows lie below it.

    Narrows a histogram until its bins are single values; each round is one
    distributed count, whatever the row count or the number of ties.
    """
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        raise ValueError(f"{col} has no values")
    below = 0
    while lo < hi:
        width = max(1, -(-(hi - lo + 1) // _BINS))
        bins = (
            df.filter(F.col(col).between(lo, hi))
            .groupBy(F.expr(f"(`{col}` - {lo}L) div {width}L").alias("b"))
            .count().orderBy("b").collect()
        )
        for row in bins:
            if below + row["count"] > n:
                lo, hi = lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1)
                break
            below += row["count"]
        else:
            raise ValueError(f"fewer than {n + 1} rows")
    return lo, below


def boundaries(df: DataFrame, positions: list[int], order: str = "ts_us", tie: str = "txn_id") -> list[tuple]:
    """The (order, tie) found at 0-based positions of the whole order, by value of both columns.

    Reads a narrow copy of the two columns. Histograms serve all positions at
    once and are refined until few rows are left around each; those are sorted.
    One instant with more rows than that is narrowed by its ids in the same way.
    """
    narrow = stored(df.select(F.col(order).alias("o"), F.col(tie).alias("t")).filter("o IS NOT NULL"), "order")
    n, low, high = narrow.agg(F.count(F.lit(1)), F.min("o"), F.max("o")).first()
    if any(p < 0 or p >= n for p in positions):
        raise ValueError(f"a position lies outside 0..{n - 1}")
    spans = [[low, high, 0, n] for _ in positions]  # first and last value, rows below, rows inside
    while any(inside > _SORTED and lo < hi for lo, hi, _, inside in spans):
        wide = [(i, lo, max(1, -(-(hi - lo + 1) // _BINS)), hi) for i, (lo, hi, _, inside) in enumerate(spans) if inside > _SORTED and lo < hi]
        hit = F.array(*[
            F.when(F.col("o").between(lo, hi), F.struct(F.lit(i).alias("i"), F.expr(f"(o - {lo}L) div {width}L").alias("b")))
            for i, lo, width, hi in wide])
        bins = narrow.select(F.explode(hit).alias("h")).filter("h IS NOT NULL").groupBy("h.i", "h.b").count().orderBy("i", "b").collect()
        for i, lo, width, hi in wide:
            below = spans[i][2]
            for row in (r for r in bins if r["i"] == i):
                if below + row["count"] > positions[i]:
                    spans[i] = [lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1), below, row["count"]]
                    break
                below += row["count"]
    out = []
    for p, (lo, hi, below, inside) in zip(positions, spans, strict=True):
        if inside > _SORTED:
            out.append((lo, _nth_tie(narrow.filter(F.col("o") == lo).select("t"), p - below, inside)))
            continue
        row = narrow.filter(F.col("o").between(lo, hi)).orderBy("o", "t").offset(p - below).limit(1).first()
        out.append((row["o"], row["t"]))
    return out


def _nth_tie(ties: DataFrame, n: int, inside: int):
    """The n-th smallest (0-based) value of ``t``, of any type with an order, nulls first.

    Sampled values cut the rows into ranges and are ranges of their own, so each
    round, one distributed count, gets nearer also where one value fills most rows.
    """
    turn = 0
    while inside > _SORTED:
        share = min(1.0, 32 * _SPLITS / inside)
        lucky = F.shiftrightunsigned(F.xxhash64("t", F.lit(turn)), 11) < F.lit(int(share * (1 << 53)))
        some = [r["t"] for r in ties.filter(F.col("t").isNotNull() & lucky).distinct().orderBy("t").collect()]
        least = ties.agg(F.min("t")).first()[0]
        splits = [v for v in dict.fromkeys([least, *some[:: max(1, len(some) // _SPLITS)]]) if v is not None]
        place = F.when(F.col("t").isNull(), -1)
        for i, v in enumerate(splits):
            place = place.when(F.col("t") < F.lit(v), 2 * i).when(F.col("t") == F.lit(v), 2 * i + 1)
        ranges = ties.groupBy(place.otherwise(2 * len(splits)).alias("b")).agg(
            F.count(F.lit(1)).alias("rows"), F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("b").collect()
        for row in ranges:
            if n < row["rows"]:
                break
            n -= row["rows"]
        if row["lo"] == row["hi"]:
            return row["lo"]
        ties, inside, turn = ties.filter(F.col("t").between(row["lo"], row["hi"])), row["rows"], turn + 1
    return ties.orderBy("t").offset(n).limit(1).first()["t"]


def from_boundary(at, cut, order: str, tie: str) -> Column:
    """Predicate: the row lies at or after the boundary."""
    return (F.col(order) > F.lit(at)) | ((F.col(order) == F.lit(at)) & (F.col(tie) >= F.lit(cut)))


def at_or_after(df: DataFrame, n: int, order: str = "ts_us", tie: str = "txn_id") -> Column:
    """Predicate: the row's position in (order, tie) is n or later."""
    return from_boundary(*boundaries(df, [n], order, tie)[0], order, tie)


def temporal_split(
    df: DataFrame, test: float = TEST_SIZE, calib: float = CALIBRATION_SIZE,
    order: str = "ts_us", tie: str = "txn_id",
) -> DataFrame:
    """Adds ``split``: train on the past, calibrate on the recent past, test on the future."""
    n = df.count()
    test_start = int(n * (1 - test))
    calib_start = int(test_start * (1 - calib))
    if not n:
        return df.withColumn("split", F.lit(None).cast("string"))
    first_test, first_calib = boundaries(df, [min(test_start, n - 1), min(calib_start, n - 1)], order, tie)
    is_test = from_boundary(*first_test, order, tie) if test_start < n else F.lit(False)
    is_calib = from_boundary(*first_calib, order, tie) if calib_start < n else F.lit(False)
    return df.withColumn("split", F.when(is_test, "test").when(is_calib, "calib").otherwise("train"))


def tail_fraction(df: DataFrame, fraction: float, order: str = "ts_us", tie: str = "txn_id") -> DataFrame:
    """The latest share of the ledger."""
    n = df.count()
    return df.filter(at_or_after(df, int(n * (1 - fraction)), order, tie))


def top_k(df: DataFrame, k: int, by: str, tie: str = "txn_id") -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie)).limit(k)


def best_per_group(df: DataFrame, group: list[str], by: str, tie: str = "txn_id") -> DataFrame:
    """The whole row with the largest ``by`` in each group; the smallest id wins a tie.

    An aggregate, so a group of any size is reduced before it is shuffled.
    """
    rest = [c for c in df.columns if c not in group]
    best = F.min_by(F.struct(*rest), F.struct((-F.col(by)).alias("by"), F.col(tie).alias("tie"))).alias("r")
    return df.filter(F.col(by).isNotNull()).groupBy(*group).agg(best).select(*group, "r.*")


def keep_positives(df: DataFrame, n: int, label: str = "y", shuffle: Column | None = None, seed: int = 5,
                   tie: str = "txn_id") -> DataFrame:
    """Every positive row, topped up to ``n`` with negatives in hash order."""
    order = shuffle if shuffle is not None else uniform(seed, F.col(tie))
    positives = df.filter(F.col(label) == 1)
    room = max(0, n - positives.count())
    return positives.unionByName(df.filter(F.col(label) == 0).orderBy(order, tie).limit(room))


def cap_rows(df: DataFrame, cap: int, shuffle: Column | None = None, seed: int = 17, tie: str = "txn_id") -> DataFrame:
    """At most ``cap`` rows in all, picked in hash order."""
    return df.orderBy(shuffle if shuffle is not None else uniform(seed, F.col(tie)), tie).limit(cap)


def cap_per_group(
    df: DataFrame, group: list[str], cap: int, shuffle: Column | None = None, seed: int = 17, tie: str = "txn_id"
) -> DataFrame:
    """At most ``cap`` rows per group, picked in hash order.

    Ranked first inside salted parts of a group, so that a group with most of
    the rows is spread over many tasks and only the survivors meet.
    """
    order = shuffle if shuffle is not None else uniform(seed, F.col(tie))
    salted = df.withColumns({"__o": order, "__salt": F.pmod(F.xxhash64(tie), F.lit(64))})
    part = Window.partitionBy(*group, "__salt").orderBy("__o", tie)
    whole = Window.partitionBy(*group).orderBy("__o", tie)
    return (
        salted.withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= cap)
        .withColumn("__r", F.row_number().over(whole)).filter(F.col("__r") <= cap)
        .drop("__o", "__salt", "__r")
    )


def review_slice(
    df: DataFrame, n: int = 220, positive_share: float = 0.32, top_share: float = 0.20,
    shuffle: Column | None = None, seed: int = 3, tie: str = "txn_id",
) -> DataFrame:
    """A queue to look at: some positives, the highest-scored negatives, random rest, by time."""
    order = shuffle if shuffle is not None else uniform(seed, F.col(tie))
    pos, neg = df.filter(F.col("y") == 1), df.filter(F.col("y") == 0)
    picked = pos.orderBy(order, tie).limit(int(n * positive_share))
    n_pos = picked.count()
    top = top_k(neg, int(n * top_share), "score", tie)
    n_top = top.count()
    rest = neg.orderBy(order, tie).limit(max(0, n - n_pos - n_top))
    return picked.unionByName(top).unionByName(rest).dropDuplicates([tie]).orderBy("ts_us", tie)


def place(df: DataFrame, order: str = "ts_us", tie: str = "txn_id", name: str = "place") -> DataFrame:
    """Position of every row in (order, tie), from 1; rows without an order come first."""
    return ranges.numbered(df, [F.asc_nulls_first(order), F.asc_nulls_first(tie)], name)


def shuffled_index(df: DataFrame, name: str, seed: int, tie: str = "txn_id") -> DataFrame:
    """Numbers rows 0..n-1 in hash order."""
    return ranges.numbered(df, [F.xxhash64(tie, F.lit(seed)), F.asc_nulls_first(tie)], name, first=0)
