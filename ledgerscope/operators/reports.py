"""Evaluation and ledger reports, each one tidy DataFrame.

Scored input: ``txn_id, amount, rail, y, score`` and, where used, ``vector_id``,
``benign_anomaly``, ``p_model``, ``novelty``, ``rule_score``, ``fired``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ALERT_BUDGET, COSTS, NOVELTY_TAIL_START, OPTIONAL_TELEMETRY
from . import curves
from .decisions import prevalence_adjusted


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def _value(cond: Column, amount: str = "amount") -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col(amount))), F.lit(0.0))


def _share(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def with_threshold(df: DataFrame, t: float | DataFrame) -> DataFrame:
    """Attaches an operating threshold: a number, or a one-row frame with ``threshold``."""
    if isinstance(t, DataFrame):
        return df.crossJoin(F.broadcast(t.select("threshold")))
    return df.withColumn("threshold", F.lit(float(t)))


# Ledger reports.

def ledger_summary(ledger: DataFrame) -> DataFrame:
    fraud = F.col("is_fraud") == 1
    df = ledger.agg(
        F.count(F.lit(1)).alias("transactions"), _n(fraud).alias("fraud_transactions"),
        _value(fraud).alias("fraud_value"), F.sum("amount").alias("total_value"),
        _n(F.col("benign_anomaly").isNotNull()).alias("benign_anomalies"),
    )
    legit = F.col("transactions") - F.col("fraud_transactions")
    return df.select(
        "transactions", "fraud_transactions",
        _share(F.col("fraud_transactions"), F.col("transactions")).alias("fraud_rate"),
        "fraud_value", "total_value",
        (F.col("fraud_value") / F.greatest(F.col("total_value"), F.lit(1.0))).alias("fraud_value_share"),
        _share(F.col("benign_anomalies"), legit).alias("benign_anomaly_rate"),
    )


def counts_by(ledger: DataFrame) -> DataFrame:
    """Fraud by vector, all and fraud by rail, legitimate anomalies by kind: one pass."""
    fraud = F.col("is_fraud") == 1
    axes = F.array(
        F.struct(F.lit("vector").alias("axis"), F.when(fraud, F.col("vector_id")).alias("k")),
        F.struct(F.lit("rail").alias("axis"), F.col("rail").alias("k")),
        F.struct(F.lit("fraud_rail").alias("axis"), F.when(fraud, F.col("rail")).alias("k")),
        F.struct(F.lit("benign").alias("axis"), F.col("benign_anomaly").alias("k")),
    )
    return (
        ledger.select(F.explode(axes).alias("a")).filter("a.k IS NOT NULL")
        .groupBy(F.col("a.axis").alias("axis"), F.col("a.k").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def entity_stats(customers: DataFrame, merchants: DataFrame, top: int = 10) -> DataFrame:
    count = F.count(F.lit(1)).alias("n")
    persona = customers.groupBy(F.lit("persona").alias("axis"), F.col("persona").alias("value")).agg(count)
    city = (
        customers.groupBy(F.lit("city").alias("axis"), F.col("city").alias("value")).agg(count)
        .orderBy(F.desc("n"), "value").limit(top)
    )
    category = merchants.groupBy(F.lit("category").alias("axis"), F.col("category").alias("value")).agg(count)
    out = persona.unionByName(city).unionByName(category)
    if "devices" in customers.columns:
        out = out.unionByName(customers.agg(F.sum(F.size("devices")).alias("n")).select(
            F.lit("devices").alias("axis"), F.lit("all").alias("value"), "n"))
    return out


def group_profile(ledger: DataFrame, group: str = "vector_id") -> DataFrame:
    """Rows, fraud rows and fraud value per group."""
    fraud = F.col("is_fraud") == 1
    return ledger.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("transactions"), _n(fraud).alias("fraud_transactions"),
        _value(fraud).alias("value_extracted"))


def fraud_share_by_rail(ledger: DataFrame) -> DataFrame:
    df = ledger.groupBy("rail").agg(F.count(F.lit(1)).alias("n"), _n(F.col("is_fraud") == 1).alias("fraud"))
    return df.withColumn("share", _share(F.col("fraud"), F.col("n"))).orderBy(F.desc("share"), "rail")


def telemetry_coverage(ledger: DataFrame, columns: list[str] = OPTIONAL_TELEMETRY) -> DataFrame:
    """Missing share of each optional column: overall, and by label."""
    label = F.explode(F.array(F.lit("all"), F.when(F.col("is_fraud") == 1, "fraud").otherwise("legit")))
    wide = ledger.withColumn("label", label).groupBy("label").agg(
        *[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns]))
    return wide.select("label", pairs.alias("p")).select("label", "p.column", "p.missing")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


# Evaluation at a threshold.

def at_threshold(scored: DataFrame, t: float | DataFrame, by: list[str] = (), costs: dict = COSTS) -> DataFrame:
    """Confusion counts, rates, value and cost at an operating threshold."""
    df = with_threshold(scored, t)
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    c = df.groupBy(*by).agg(
        F.max("threshold").alias("threshold"),
        _n(hit & pos).alias("tp"), _n(hit & ~pos).alias("fp"), _n(~hit & pos).alias("fn"), _n(~hit & ~pos).alias("tn"),
        _value(hit & pos).alias("value_caught"), _value(~hit & pos).alias("value_missed"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return c.select(
        *by, "threshold", "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))).alias("f1"),
        _share(fp, fp + tn).alias("fpr"), _share(tp + fp, tp + fp + fn + tn).alias("alert_rate"),
        "value_caught", "value_missed",
        (F.col("value_caught") / F.greatest(F.col("value_caught") + F.col("value_missed"), F.lit(1.0)))
        .alias("value_recall"),
        ((tp + fp) * costs["review_cost"]).alias("review_cost"),
        (fp * (costs["decline_share"] * costs["false_decline_cost"])).alias("false_decline_cost"),
        curves.expected_cost(F.col("value_missed"), tp + fp, fp, costs).alias("expected_cost"),
        prevalence_adjusted(precision, _share(tp + fn, tp + fp + fn + tn)).alias("precision_at_real_prevalence"),
    )


def median_by(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Exact median per group; a group of any size stays distributed."""
    return curves.quantiles(df, value, [0.5], group).select(*group, F.col("value").alias(name))


def recall_by_group(
    scored: DataFrame, t: float | DataFrame, group: str = "vector_id", holdout: tuple[str, ...] = ()
) -> DataFrame:
    df = with_threshold(scored, t).filter(F.col(group).isNotNull())
    hit = F.col("score") >= F.col("threshold")
    stats = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (_n(hit) / F.count(F.lit(1))).alias("recall"),
        F.sum("amount").alias("value"),
        (_value(hit) / F.greatest(F.sum("amount"), F.lit(1.0))).alias("value_recall"))
    return stats.join(median_by(df, [group], "score", "median_score"), group, "left").withColumn(
        "held_out", F.col(group).isin(*holdout) if holdout else F.lit(False))


def false_positives_by_anomaly(scored: DataFrame, t: float | DataFrame) -> DataFrame:
    df = with_threshold(scored, t).filter(F.col("y") == 0)
    kind = F.coalesce("benign_anomaly", F.lit("__normal__"))
    return df.groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"),
        (_n(F.col("score") >= F.col("threshold")) / F.count(F.lit(1))).alias("false_positive_rate"))


def rail_report(scored: DataFrame, t: float | DataFrame) -> DataFrame:
    df = with_threshold(scored, t)
    hit, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    return df.groupBy("rail").agg(
        F.count(F.lit(1)).alias("n"), _n(pos).alias("fraud"),
        _share(_n(hit & pos), _n(pos)).alias("recall"), (_n(hit) / F.count(F.lit(1))).alias("alert_rate"))


def rules_fired(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("fired").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def channel_attribution(scored: DataFrame, t: float | DataFrame) -> DataFrame:
    """Fraud only one channel would have caught, and mean model score by class."""
    df = with_threshold(scored, t)
    pos, quiet = F.col("y") == 1, F.col("p_model") < F.col("threshold")
    return df.agg(
        _n((F.col("rule_score") >= F.col("threshold")) & quiet & pos).alias("fraud_caught_only_by_rules"),
        _n((F.col("novelty") > NOVELTY_TAIL_START) & quiet & pos).alias("fraud_caught_only_by_novelty"),
        F.avg(F.when(pos, F.col("p_model"))).alias("mean_model_score_fraud"),
        F.avg(F.when(~pos, F.col("p_model"))).alias("mean_model_score_legit"))


def score_histogram(scored: DataFrame, bins: int = 40) -> DataFrame:
    """Counts by equal-width score bin and class; the last bin is closed."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("long")
    return scored.filter(F.col("score").between(0, 1)).groupBy(b.alias("bin")).agg(
        (F.first(b) / bins).alias("low"), _n(F.col("y") == 1).alias("fraud"), _n(F.col("y") == 0).alias("legit"))


def novelty_profile(scored: DataFrame, holdout: tuple[str, ...] = (), group: str = "vector_id") -> DataFrame:
    """How far into the anomaly tail each family sits, against the legitimate p99."""
    legit = scored.filter(F.col("y") == 0)
    q = curves.quantiles(legit, "novelty", [0.5, 0.99]).agg(
        F.max(F.when(F.col("q") < 0.6, F.col("value"))).alias("legit_p50"),
        F.max(F.when(F.col("q") > 0.6, F.col("value"))).alias("legit_p99"))
    df = scored.filter((F.col("y") == 1) & F.col(group).isNotNull()).crossJoin(F.broadcast(q))
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("novelty").alias("mean_novelty_percentile"),
        F.avg((F.col("novelty") > F.col("legit_p99")).cast("double")).alias("share_above_legit_p99"),
        F.max("legit_p50").alias("legit_p50"), F.max("legit_p99").alias("legit_p99"),
    ).withColumn("held_out", F.col(group).isin(*holdout) if holdout else F.lit(False))


def holdout_recall(
    scored: DataFrame, holdout: tuple[str, ...], t: float | DataFrame, group: str = "vector_id"
) -> DataFrame:
    """Recall on families kept out of training, next to all known ones.

    A family without test rows still gets a line, with no recall.
    """
    df = with_threshold(scored, t).filter(F.col("y") == 1)
    family = F.when(F.col(group).isin(*holdout), F.col(group)).otherwise("__known_families__")
    df = df.withColumn("family", family)
    stats = df.groupBy("family").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("recall"),
        F.avg("score").alias("mean_score"))
    stats = stats.join(median_by(df, ["family"], "score", "median_score"), "family", "left")
    names = scored.sparkSession.createDataFrame([(h,) for h in [*holdout, "__known_families__"]], "family STRING")
    return F.broadcast(names).join(stats, "family", "left").select(
        "family", F.coalesce("n", F.lit(0)).alias("n"), "recall", "mean_score", "median_score")


def paired_lift(df: DataFrame, level: str, s1: str, t1: float, s2: str, t2: float) -> DataFrame:
    """Recall of two scorers on the same rows, by sweep level."""
    a = F.avg((F.col(s1) >= t1).cast("double"))
    b = F.avg((F.col(s2) >= t2).cast("double"))
    return df.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount"),
        a.alias("recall_full"), b.alias("recall_without"), (a - b).alias("lift"),
        F.avg(s1).alias("mean_score_full"), F.avg(s2).alias("mean_score_without"))


MEDIAN_BINS = 4_096


def _binned(values: DataFrame, within: dict[str, tuple[float, float] | None]) -> list:
    """Rows, lowest and highest value of each bin (k, b, n, lo, hi) of the finite values of columns between two
    ends, both included; one bin where no ends are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = {k: MEDIAN_BINS if ends else 1 for k, ends in within.items()}
        n = {k: np.zeros(s, np.int64) for k, s in size.items()}
        low, high = {k: np.full(s, np.inf) for k, s in size.items()}, {k: np.full(s, -np.inf) for k, s in size.items()}
        for batch in batches:
            for i, (k, ends) in enumerate(within.items()):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                v = v[np.isfinite(v)]
                at = np.zeros(len(v), np.int64)
                if ends:
                    v = v[(v >= ends[0]) & (v <= ends[1])]
                    wide = ends[1] / 2 - ends[0] / 2  # halves: the range itself may overflow
                    share = (v / 2 - ends[0] / 2) / wide if wide else (v > ends[0]).astype(float)
                    at = np.minimum(share * MEDIAN_BINS, MEDIAN_BINS - 1).astype(np.int64)
                n[k] += np.bincount(at, minlength=size[k])
                np.minimum.at(low[k], at, v)
                np.maximum.at(high[k], at, v)
        for k in within:
            b = np.flatnonzero(n[k])
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(b), pa.string()), pa.array(b, pa.int32()), pa.array(n[k][b]), pa.array(low[k][b]), pa.array(high[k][b])], names=["k", "b", "n", "lo", "hi"])

    told = values.select(*within).mapInArrow(run, "k string, b int, n long, lo double, hi double")
    return told.groupBy("k", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median of each column over observed values, as (feature, median).

    Histograms of all columns at once close in on the middle: each pass counts the bins of
    a task's rows in arrays and moves these counts only, never rows, and the result is exact.
    Infinite values count as not observed.
    """
    names = {f"c{i}": c for i, c in enumerate(columns)}
    values = df.select(*[F.col(c).cast("double").alias(k) for k, c in names.items()])
    ends = _binned(values, dict.fromkeys(names))
    # lowest and highest value around the middle, rows below it, 0-based places of the two middle values
    state = {r["k"]: (r["lo"], r["hi"], 0, (r["n"] - 1) // 2, r["n"] // 2) for r in ends}
    found: dict[str, float] = {}
    while state:
        for k in [k for k, (lo, hi, *_) in state.items() if lo == hi]:
            found[k] = state.pop(k)[0]
        if not state:
            break
        bins = _binned(values, {k: (lo, hi) for k, (lo, hi, *_) in state.items()})
        for k, (_, _, below, first, second) in list(state.items()):
            left = None
            for row in sorted((r for r in bins if r["k"] == k), key=lambda r: r["b"]):
                if left is not None:  # the middle lies between two bins
                    found[k] = (left + row["lo"]) / 2
                    del state[k]
                    break
                if below + row["n"] > first:
                    if below + row["n"] > second:
                        state[k] = (row["lo"], row["hi"], below, first, second)
                        break
                    left = row["hi"]
                below += row["n"]
    rows = [(names[k], float(v)) for k, v in found.items()]
    return df.sparkSession.createDataFrame(rows, "feature STRING, median DOUBLE")


def brier(scored: DataFrame) -> DataFrame:
    p = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.agg(F.avg((F.col("y") - p) * (F.col("y") - p)).alias("brier"))


def evaluate(
    scored: DataFrame, costs: dict = COSTS, holdout: tuple[str, ...] = (), budget: float = ALERT_BUDGET,
    threshold_on: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Every evaluation report of a scored table.

    Thresholds are chosen on ``threshold_on`` (the calibration slice, say);
    without it, on the evaluated rows themselves.
    """
    basis = threshold_on if threshold_on is not None else scored
    costed = curves.cost_curve(basis, costs)
    t_budget = curves.budget_threshold(basis, budget)
    t_cost = curves.choose_threshold(costed).select("threshold")
    curve = curves.score_curve(scored)
    return {
        "summary": scored.agg(
            F.count(F.lit(1)).alias("n_test"), _n(F.col("y") == 1).alias("n_test_fraud"),
            F.avg(F.col("y").cast("double")).alias("test_fraud_rate"),
        ).crossJoin(curves.ranking_metrics(curve)).crossJoin(brier(scored)),
        "operating_point": at_threshold(scored, t_budget, costs=costs),
        "cost_optimal_point": at_threshold(scored, t_cost, costs=costs),
        "recall_at_fpr": curves.recall_at_fpr(curve),
        "per_vector": recall_by_group(scored, t_budget, holdout=holdout),
        "per_rail": rail_report(scored, t_budget),
        "false_positives": false_positives_by_anomaly(scored, t_budget),
        "rules_fired": rules_fired(scored),
        "channels": channel_attribution(scored, t_budget),
        "roc": curves.roc_points(curve, 160),
        "pr": curves.pr_points(curve, 160),
        "cost_curve": costed,
        "score_hist": score_histogram(scored),
        "holdout": holdout_recall(scored, holdout, t_budget) if holdout else None,
    }


def before_after(before: DataFrame, after: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Two report rows side by side, with deltas."""
    b = before.select(*keys, *[F.col(m).alias(f"{m}_before") for m in metrics])
    a = after.select(*keys, *[F.col(m).alias(f"{m}_after") for m in metrics])
    joined = b.join(a, keys, "full_outer") if keys else b.crossJoin(F.broadcast(a))
    return joined.select("*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics])


def union_reports(parts: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    return reduce(DataFrame.unionByName, [d.withColumn(tag, F.lit(k)) for k, d in parts.items()])
