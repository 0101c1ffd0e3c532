"""Exact cumulative curves, quantiles and ranking metrics at any size.

A global order over raw rows would put everything in one task. Instead rows are first
summed per distinct value, and the distinct values, stored once, are cut into ordered
ranges of bounded size (``ranges``) with running sums across them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALERT_BUDGET, COSTS, FPR_TARGETS
from ..session import stored
from . import ranges


@dataclass(frozen=True)
class Points:
    """One stored row per distinct value (and group) with its own sums."""

    table: DataFrame
    value: str
    names: list[str]
    by: list[str]

    def running(self, descending: bool = True, marks: DataFrame | None = None) -> DataFrame:
        """Adds for every sum ``s`` the sum up to and including the value (``cum_s``) and of all (``all_s``);
        ``rank`` numbers the values.

        ``marks`` has further values, of no weight, that take their place in the order after an equal
        value; with it the result has them alone, so ``cum_s`` is the sum over all that is reached at a mark.
        """
        direction = F.desc if descending else F.asc
        names = ["points", *self.names]
        table = self.table.withColumn("points", F.lit(1).cast("long"))
        order = [direction(self.value)]
        if marks is not None:
            nothing = [F.lit(0).cast(table.schema[n].dataType).alias(n) for n in names]
            table = table.withColumn("__mark", F.lit(False)).unionByName(marks.select(self.value, *nothing, F.lit(True).alias("__mark")))
            order.append(F.asc("__mark"))
        # One order of all groups: a group of many values is cut like the table of a single one.
        cut, single = ranges.ranged(table, [F.asc(c) for c in self.by] + order)
        out = ranges.running(cut, order, {n: F.col(n) for n in names}, self.by, single)
        if marks is not None:
            out = out.filter("__mark").drop("__mark")
        return out.withColumnRenamed("cum_points", "rank").drop("points")


def points(df: DataFrame, value: str, sums: dict[str, Column], by: list[str] = ()) -> Points:
    """Sums per distinct value; ``rows`` (how many rows share it) is added to them."""
    by, sums = list(by), {"rows": F.lit(1).cast("long"), **sums}
    table = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return Points(stored(table, "points"), value, list(sums), by)


def cumulative(
    df: DataFrame, value: str, sums: dict[str, Column], by: list[str] = (), descending: bool = True
) -> DataFrame:
    """One row per distinct value with its own sums and the sums up to and including it (``Points.running``)."""
    found = points(df, value, sums, by)
    first = ["rank", "all_points"]
    rest = [c for n in found.names for c in (n, f"cum_{n}", f"all_{n}")]
    return found.running(descending).select(*found.by, value, *first, *rest)


def quantiles(df: DataFrame, value: str, qs: list[float], by: list[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles, exact: one row per group and q."""
    return quantiles_of(points(df, value, {}, by), qs)


def quantiles_of(found: Points, qs: list[float]) -> DataFrame:
    """The quantiles of the value whose distinct values are given.

    Each q lies between the values at two neighbouring positions. Positions and the
    stretches of positions that values fill meet in as many equal steps as there are qs, so
    a value is looked at only beside the few positions of its own steps.
    """
    by, value = found.by, found.value
    steps = F.greatest(F.lit(1), F.expr(f"all_rows div {len(qs)}"))
    step_of = lambda at: F.floor(at / steps)
    totals = found.table.groupBy(*by).agg(F.sum("rows").alias("all_rows")).filter("all_rows > 0")
    asks = totals.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = F.col("q") * (F.col("all_rows") - 1)
    ends = F.array(F.struct(F.floor(at).alias("i"), F.lit(False).alias("upper")),
                   F.struct(F.least(F.floor(at) + 1, F.col("all_rows") - 1).alias("i"), F.lit(True).alias("upper")))
    asks = asks.withColumns({"__w": at - F.floor(at), "e": F.explode(ends)})
    asks = asks.select(*[F.col(c).alias(f"__k_{c}") for c in by], "q", "__w", "e.i", "e.upper", step_of(F.col("e.i")).alias("__ask"))
    low, high = F.col("cum_rows") - F.col("rows"), F.col("cum_rows")
    table = found.running(descending=False).select(
        *by, F.col(value).alias("__v"), low.alias("__low"), high.alias("__high"), F.explode(F.sequence(step_of(low), step_of(high - 1))).alias("__step"))
    same = F.col("__step") == F.col("__ask")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    hits = table.join(asks if by else F.broadcast(asks), same).filter("i >= __low AND i < __high")
    upper = F.max(F.when(F.col("upper"), F.col("__v")))
    lower = F.max(F.when(~F.col("upper"), F.col("__v")))
    return hits.groupBy(*by, "q").agg((lower + (upper - lower) * F.max("__w")).alias("value"))


def score_points(scored: DataFrame, by: list[str] = ()) -> Points:
    """Distinct scores with their hits and the value of those. Needs ``score``, ``y`` and ``amount``."""
    pos = F.when(F.col("y") == 1, 1).otherwise(0).cast("long")
    amount = F.when(F.col("y") == 1, F.col("amount")).otherwise(0.0)
    return points(scored, "score", {"pos": pos, "pos_amount": amount}, by)


def score_curve(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """Distinct scores, highest first, with hits and value above each."""
    return score_points(scored, by).running()


def ranking_metrics(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """ROC-AUC with average ranks for ties, and average precision by steps."""
    tp, n, p = F.col("cum_pos"), F.col("cum_rows"), F.col("all_pos")
    negatives = F.col("all_rows") - p
    neg = F.col("rows") - F.col("pos")
    neg_below = negatives - (n - tp)
    return curve.groupBy(*by).agg(
        (F.sum(F.col("pos") * (neg_below + 0.5 * neg)) / F.nullif(F.max(p * negatives), F.lit(0))).alias("roc_auc"),
        (F.sum(F.col("pos") * (tp / n)) / F.nullif(F.max(p), F.lit(0))).alias("pr_auc"),
    )


def roc_points(curve: DataFrame, k: int | None = None) -> DataFrame:
    """(x, y) = (false-positive rate, recall), from the origin upwards."""
    tp, n, p = F.col("cum_pos"), F.col("cum_rows"), F.col("all_pos")
    points = curve.select(
        F.col("rank"), F.col("all_points"),
        ((n - tp) / (F.col("all_rows") - p)).alias("x"), (tp / p).alias("y"))
    return _with_start(points, 0.0, 0.0, k)


def pr_points(curve: DataFrame, k: int | None = None) -> DataFrame:
    """(x, y) = (recall, precision), starting at recall 0, precision 1."""
    tp, n, p = F.col("cum_pos"), F.col("cum_rows"), F.col("all_pos")
    points = curve.select(F.col("rank"), F.col("all_points"), (tp / p).alias("x"), (tp / n).alias("y"))
    return _with_start(points, 0.0, 1.0, k)


def _with_start(points: DataFrame, x: float, y: float, k: int | None) -> DataFrame:
    start = points.agg(F.max("all_points").alias("all_points")).select(
        F.lit(0).cast("long").alias("rank"), "all_points", F.lit(x).alias("x"), F.lit(y).alias("y"))
    out = points.unionByName(start)
    if k is not None:
        out = out.filter(evenly_spaced(F.col("rank"), F.col("all_points") + 1, k))
    return out.select("rank", "x", "y")


def evenly_spaced(index: Column, n: Column, k: int) -> Column:
    """True for the up to ``k`` evenly spaced positions of ``0..n-1``, ends included."""
    step = (n - 1) / F.lit(float(k - 1))
    j = F.ceil(index / step)
    near = lambda i: (i >= 0) & (i <= k - 1) & (F.floor(i * step) == index)
    hit = near(j) | near(j - 1) | near(j + 1) | (index == n - 1)
    return F.when(n <= k, True).otherwise(hit)


def recall_at_fpr(curve: DataFrame, targets: list[float] = FPR_TARGETS) -> DataFrame:
    """Best recall whose false-positive rate stays within each target."""
    tp, p = F.col("cum_pos"), F.col("all_pos")
    fpr = (F.col("cum_rows") - tp) / (F.col("all_rows") - p)
    best = [F.max(F.when(fpr <= t, tp / p)).alias(f"t{i}") for i, t in enumerate(targets)]
    rows = F.array(*[
        F.struct(F.lit(t).alias("fpr_target"), F.coalesce(F.col(f"t{i}"), F.lit(0.0)).alias("recall"))
        for i, t in enumerate(targets)])
    return curve.agg(*best).select(F.explode(rows).alias("r")).select("r.*")


def threshold_grid() -> list[float]:
    """220 quantile levels from 0.90 to 0.9999."""
    return [0.90 + (0.9999 - 0.90) * i / 219 for i in range(220)]


def cost_curve(scored: DataFrame, costs: dict = COSTS, qs: list[float] | None = None) -> DataFrame:
    """Expected cost at each distinct quantile of the score.

    The scores are summed once. The thresholds then stand among them in the same ranges as
    rows of no weight, so what lies at or above each is a running sum, and nothing is joined.
    """
    found = score_points(scored)
    grid = quantiles_of(found, qs or threshold_grid()).select(F.col("value").alias("score")).distinct()
    return _costed(found.running(marks=grid).withColumnRenamed("score", "threshold"), costs)


def _costed(steps: DataFrame, costs: dict) -> DataFrame:
    tp, n, p = F.col("cum_pos"), F.col("cum_rows"), F.col("all_pos")
    fp = n - tp
    missed = F.col("all_pos_amount") - F.col("cum_pos_amount")
    return steps.select(
        "threshold", (n / F.col("all_rows")).alias("alert_rate"),
        tp.alias("tp"), fp.alias("fp"), (p - tp).alias("fn"),
        (tp / F.greatest(p, F.lit(1))).alias("recall"),
        (tp / F.greatest(n, F.lit(1))).alias("precision"),
        expected_cost(missed, n, fp, costs).alias("expected_cost"),
    )


def expected_cost(missed_value: Column, alerts: Column, fp: Column, costs: dict = COSTS) -> Column:
    """Missed value lost, plus review of every alert, plus false declines."""
    return (
        missed_value * costs["fraud_loss_ratio"]
        + alerts * costs["review_cost"]
        + fp * (costs["decline_share"] * costs["false_decline_cost"])
    )


def choose_threshold(curve: DataFrame) -> DataFrame:
    """The cheapest row of a cost curve; the lowest threshold wins a tie."""
    best = F.min_by(F.struct(*curve.columns), F.struct(F.round("expected_cost", 2), "threshold"))
    return curve.agg(best.alias("b")).select("b.*")


def budget_threshold(scored: DataFrame, budget: float = ALERT_BUDGET) -> DataFrame:
    """Score above which a share ``budget`` of all rows lies."""
    return quantiles(scored, "score", [1.0 - budget]).select(F.col("value").alias("threshold"))


def percentile_in_reference(df: DataFrame, value: str, reference: DataFrame, ref_value: str) -> DataFrame:
    """Share of the reference strictly below each row's value, as ``percentile``.

    The reference's distinct values and the rows are put in one order, rows before the
    reference's equal value, and cut into ranges together; rows of one value are told apart
    by a hash, so none of them gathers. Nothing is joined back. NULL without a value.
    """
    weights = reference.filter(F.col(ref_value).isNotNull()).groupBy(F.col(ref_value).alias("__v")).agg(F.count(F.lit(1)).alias("__w"))
    row = F.struct(*df.columns)
    asks = df.select(F.col(value).alias("__v"), F.lit(0).cast("long").alias("__w"), row.alias("__row"))
    none = F.lit(None).cast(asks.schema["__row"].dataType)
    both = asks.withColumn("__h", F.xxhash64("__row")).unionByName(
        weights.select("__v", "__w", none.alias("__row"), F.lit(0).cast("long").alias("__h")))
    # Rows come first at a value, and rows without one before all others.
    order = [F.asc_nulls_first("__v"), F.asc("__kind"), F.asc("__h")]
    cut, single = ranges.ranged(both.withColumn("__kind", F.col("__row").isNull().cast("int")), order)
    ranked = ranges.running(cut, order, {"__w": F.col("__w")}, single=single).filter("__kind = 0")
    share = F.when(F.col("__v").isNotNull(), F.col("cum___w") / F.greatest(F.col("all___w"), F.lit(1)))
    return ranked.select("__row.*", share.alias("percentile"))
