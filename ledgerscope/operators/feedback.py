"""What slipped through, what to learn from it, and whether that helped.

Input: scored attack candidates with ``group_id, vector_id, amount, score``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from . import curves, ranges
from .ranks import cap_rows
from .reports import at_threshold, median_by

# Weight of each campaign parameter and which end is dear.
COST_WEIGHTS = {
    "device_hygiene": (0.30, "up"),
    "spread": (0.26, "up"),
    "mimicry": (0.24, "up"),
    "dwell": (0.14, "up"),
    "velocity": (0.06, "down"),
    "stealth": (0.05, "up"),
    "aggression": (0.00, "up"),
    "narrative_intensity": (0.04, "down"),
}


def evasion_by_group(candidates: DataFrame, threshold: float, group: str = "group_id") -> DataFrame:
    missed = F.col("score") < threshold
    stats = candidates.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(missed.cast("double")).alias("evasion_rate"),
        F.avg("score").alias("mean_score"), F.sum("amount").alias("value_extracted"),
        F.coalesce(F.sum(F.when(missed, F.col("amount"))), F.lit(0.0)).alias("value_evaded"))
    return stats.join(median_by(candidates, [group], "score", "median_score"), group, "left")


def evasion_by_family(by_group: DataFrame, family: str = "vector_id") -> DataFrame:
    """Mean over groups, not over rows."""
    return by_group.groupBy(family).agg(
        F.count(F.lit(1)).alias("n"), F.avg("evasion_rate").alias("evasion")).orderBy(F.desc("evasion"), family)


def mine_evasions(
    candidates: DataFrame, threshold: float, cap: int = K.MINED_CAP, shuffle: Column | None = None,
    weight: float = K.MINED_WEIGHT * K.POSITIVE_CLASS_WEIGHT, tie: str = "txn_id",
) -> DataFrame:
    """Candidates below the threshold, at most ``cap`` a round, with their training weight.

    The cap is part of the method (one prolific group must not swamp training).
    """
    missed = candidates.filter(F.col("score") < threshold)
    return cap_rows(missed, cap, shuffle, tie=tie).withColumn("weight", F.lit(weight))


def mined_by_vector(mined: DataFrame) -> DataFrame:
    return mined.groupBy("vector_id").agg(F.count(F.lit(1)).alias("mined"))


def with_class_weight(df: DataFrame, label: str = "y", positive: float = K.POSITIVE_CLASS_WEIGHT) -> DataFrame:
    return df.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(1.0))


def training_set(base: DataFrame, mined: DataFrame | None, label: str = "y") -> DataFrame:
    """Base rows by class weight, plus mined rows with their own weight."""
    weighted = with_class_weight(base, label)
    return weighted if mined is None else weighted.unionByName(mined, allowMissingColumns=True)


def frozen_measure(scored: DataFrame, budget: float = K.ALERT_BUDGET) -> DataFrame:
    """Quality on a fixed slice at a constant alert budget."""
    point = at_threshold(scored, curves.budget_threshold(scored, budget)).select(
        "threshold", "recall", "precision", "fpr", "alert_rate", "value_recall")
    auc = curves.ranking_metrics(curves.score_curve(scored)).select(F.col("roc_auc").alias("auc"))
    return point.crossJoin(F.broadcast(auc))


def gain(
    before: DataFrame, after: DataFrame, baseline_fpr: float, after_fpr: float,
    multiplier: float = K.FPR_BUDGET_MULTIPLIER, group: str = "group_id",
) -> DataFrame:
    """Evasion before and after a retrain per group, and whether false alarms stayed in budget."""
    b = before.select(group, F.col("evasion_rate").alias("evasion_pre"))
    a = after.select(group, F.col("evasion_rate").alias("evasion_post"))
    return b.join(a, group, "full_outer").select(
        group, "evasion_pre", "evasion_post", (F.col("evasion_pre") - F.col("evasion_post")).alias("gain"),
        F.lit(after_fpr <= baseline_fpr * multiplier).alias("fpr_within_budget"))


def first_round_reaching(rounds: DataFrame, target: float = K.EVASION_TARGET) -> DataFrame:
    """First round whose remaining evasion is below target with false alarms in budget."""
    return rounds.filter((F.col("evasion_post") < target) & F.col("fpr_within_budget")).agg(
        F.min("round").alias("first_round"))


def operating_cost(parameters: DataFrame, weights: dict = COST_WEIGHTS) -> Column:
    """Normalised 0-1 running cost of a parameter row; a missing parameter counts as 0.5."""
    total, norm = F.lit(0.0), 0.0
    for name, (w, end) in weights.items():
        v = F.coalesce(F.col(name), F.lit(0.5)) if name in parameters.columns else F.lit(0.5)
        total = total + w * (v if end == "up" else 1.0 - v)
        norm += w
    return total / max(norm, 1e-9)


def viability(
    groups: DataFrame, min_value: float = K.MIN_VALUE_EXTRACTED, penalty: float = K.COST_PENALTY_WEIGHT
) -> DataFrame:
    """Cost, value per attack, viability and fitness of each campaign group.

    Needs ``n, evasion_rate, value_extracted`` and the parameter columns.
    """
    per_attack = F.col("value_extracted") / F.greatest(F.col("n"), F.lit(1))
    ramp = 1.0 / (1.0 + F.exp(-(per_attack - min_value) / max(1.0, min_value * 0.45)))
    df = groups.withColumns({
        "operational_cost": operating_cost(groups), "value_per_attack": per_attack, "viability": ramp})
    raw = F.col("evasion_rate") * (0.35 + 0.65 * F.col("viability")) - (
        penalty * F.col("operational_cost") * F.col("evasion_rate"))
    return df.withColumn("fitness", F.greatest(F.lit(0.0), raw))


def clip_parameters(parameters: DataFrame, bounds: DataFrame, family: str = "family") -> DataFrame:
    """Parameters held inside [0, 1] and their family's own bounds.

    ``bounds(family, parameter, lower, upper)``.
    """
    names = [c for c in K.PARAMETER_NAMES if c in parameters.columns]
    wide = bounds.groupBy(family).agg(*[
        e for c in names for e in (
            F.max(F.when(F.col("parameter") == c, F.col("lower"))).alias(f"__lo_{c}"),
            F.min(F.when(F.col("parameter") == c, F.col("upper"))).alias(f"__hi_{c}"))])
    df = parameters.join(wide, family, "left")
    held = {
        c: F.least(F.coalesce(f"__hi_{c}", F.lit(1.0)), F.greatest(F.coalesce(f"__lo_{c}", F.lit(0.0)), F.col(c)),
                   F.lit(1.0)) for c in names}
    return df.withColumns(held).select(*parameters.columns)


def elite_centroid(groups: DataFrame, columns: list[str], share: float = 0.25, least: int = 3) -> DataFrame:
    """Mean parameters of the fittest groups (a share of them, never fewer than ``least``); the smaller id wins a tie."""
    rated = groups.filter(F.col("fitness").isNotNull())
    keep = max(least, int(rated.count() * share))
    placed = ranges.numbered(rated.select("fitness", "group_id", *columns), [F.desc("fitness"), F.asc("group_id")], "__place")
    return placed.filter(F.col("__place") <= keep).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in columns])
