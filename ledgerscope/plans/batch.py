"""The batch job: ledger in; features, split, model, scores and reports out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..ml.model import FraudModel, fit, medians_of
from ..ml.text import text_score
from ..operators import curves, feedback, quality, ranks, reports
from ..operators.decisions import decision
from ..operators.explain import explain
from ..operators.features import FEATURE_NAMES, features
from ..session import stored
from ..sources.schema import conform


@dataclass
class Run:
    """What one batch run produced; everything is a DataFrame but the model."""

    table: DataFrame
    model: FraudModel
    scored: DataFrame
    reports: dict[str, DataFrame]
    holdout: tuple[str, ...] = ()


def feature_job(
    ledger: DataFrame, customers=None, merchants=None, episodes=None, columns: list[str] | None = None,
    turns: DataFrame | None = None, **options
) -> DataFrame:
    """Features with split, noisy labels and the text score, cut off from their lineage.

    The table is read many times afterwards, so it is written once, as Parquet, to
    the shared folder; later passes read the columns they need. Conversations come as ``turns`` (one row each, any length)
    or as whole texts in ``episodes``.
    """
    split = ranks.temporal_split(conform(ledger))
    if episodes is not None and (turns is not None or "text" in episodes.columns):
        scores, _ = text_score(split, turns if turns is not None else episodes)
        episodes = episodes.join(scores.withColumnRenamed("narrative_id", "episode_id"), "episode_id", "left")
    table = features(ledger, customers, merchants, episodes, columns=columns, **options)
    table = table.join(split.select("txn_id", "split"), "txn_id").withColumn("y", F.col("is_fraud"))
    return stored(quality.label_noise(table), "features")


def run(
    ledger: DataFrame, customers=None, merchants=None, episodes=None, holdout: tuple[str, ...] = (),
    columns: list[str] | None = None, threshold_split: str = "calib", turns: DataFrame | None = None, **fit_options
) -> Run:
    """Train on the past, choose thresholds on the calibration slice, report on the future."""
    names = list(columns or FEATURE_NAMES)
    needed = sorted({*names, *_rule_inputs(), "amount"})
    table = feature_job(ledger, customers, merchants, episodes, columns=needed, turns=turns)
    model = fit(table, names, exclude=holdout, **fit_options)
    scored = stored(model.transform(table), "scored")  # reports read it many times
    test = scored.filter("split = 'test'")
    basis = scored.filter(F.col("split") == threshold_split)
    return Run(table, model, scored, reports.evaluate(test, holdout=holdout, threshold_on=basis), holdout)


def _rule_inputs() -> set[str]:
    from ..operators.decisions import RULES

    seen: set[str] = set()

    def note(name):
        seen.add(name)
        return F.lit(0.0)

    for rule in RULES:
        rule.predicate(note)
    return seen


def explain_rows(rows: DataFrame, result: Run, k: int = 4) -> DataFrame:
    """Score parts, fired rules, decision and reasons for any rows of the feature table."""
    names = list(result.model.features)
    medians = medians_of(result.table.filter("split = 'train'"), names)
    meds = rows.sparkSession.createDataFrame([tuple(medians[c] for c in names)], names)
    out = explain(
        rows, result.model.transform, meds, names, k, inputs=sorted({*names, *_rule_inputs()}),
        parts=["p_model", "novelty", "rule_score", "fired"])
    basis = result.scored.filter("split = 'calib'")
    cost = curves.choose_threshold(curves.cost_curve(basis)).select(F.col("threshold").alias("t_cost"))
    budget = curves.budget_threshold(basis).withColumnRenamed("threshold", "t_budget")
    out = out.crossJoin(F.broadcast(cost)).crossJoin(F.broadcast(budget))
    return out.withColumn("decision", decision(F.col("base_score"), F.col("t_cost"), F.col("t_budget"))).drop("t_cost", "t_budget")


def feedback_round(
    result: Run, candidates: DataFrame, names: list[str], threshold: float, cap: int = K.MINED_CAP, **fit_options
) -> tuple[FraudModel, DataFrame]:
    """Mines candidates the model missed, refits on them, and compares evasion per group.

    ``candidates`` are feature rows with ``group_id``. The threshold stays fixed
    across the refit, and the anomaly channel is reused.
    """
    before = result.model.transform(candidates)
    mined = feedback.mine_evasions(before, threshold, cap).select(
        "txn_id", *names, "vector_id", F.lit(1).alias("y_observed"), "weight")
    # Held-out families stay out of the refit too.
    model = fit(result.table, names, mined=mined, novelty=result.model.novelty, **{"exclude": result.holdout, **fit_options})
    after = model.transform(candidates)
    test = result.table.filter("split = 'test'")
    b = feedback.frozen_measure(result.model.transform(test)).first()
    a = feedback.frozen_measure(model.transform(test)).first()
    table = feedback.gain(
        feedback.evasion_by_group(before, threshold), feedback.evasion_by_group(after, threshold), b["fpr"], a["fpr"])
    return model, table
