"""The fused fraud model: boosted trees, calibration, anomaly channel and rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import uniform
from ..operators import reports
from ..operators.decisions import apply_rules, fuse
from ..operators.feedback import training_set
from ..operators.quality import assert_no_leakage
from .isolation import IsolationModel, fit_isolation

# Telemetry that may be missing: the learner also sees that it was.
NULLABLE = [
    *K.OPTIONAL_TELEMETRY, "session_ratio_customer", "hesitation_ratio_customer", "typing_variance_ratio",
    "screen_share_and_new_benef", "session_per_txn_value",
]


@dataclass
class FraudModel:
    features: list[str]
    medians: dict[str, float]
    trees: GBTClassificationModel
    calibrator: IsotonicRegressionModel | None
    novelty: IsolationModel
    blank: list[str] = field(default_factory=list)

    def raw(self, df: DataFrame) -> DataFrame:
        """Adds ``p_raw``, the uncalibrated probability of the trees."""
        out = self.trees.transform(_assemble(self._blanked(df), self.features, self.medians))
        return out.withColumn("p_raw", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction")

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p_model, novelty, rule_score, fired, novelty_contrib, score``."""
        out = self.raw(df)
        if self.calibrator is not None:
            out = self.calibrator.transform(out).withColumn(
                "p_model", F.least(F.greatest(F.col("p_cal"), F.lit(0.0)), F.lit(1.0))).drop("p_cal")
        else:
            out = out.withColumn("p_model", F.col("p_raw"))
        return fuse(apply_rules(self.novelty.transform(out)))

    def _blanked(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.lit(0.0) for c in self.blank}) if self.blank else df


# Levels of the declared categories; -1, a value outside the list, is a level of its own.
CATEGORICAL = {
    "cat_rail": K.RAILS, "cat_auth_method": K.AUTH_METHODS, "cat_merchant_category": K.CATEGORIES, "cat_persona": K.PERSONAS, "cat_device_os": K.DEVICE_OS,
}


def _as_levels(df: DataFrame, features: list[str]) -> DataFrame:
    """Categories as level numbers from 0 with the attribute that makes trees split them by sets of levels."""
    for c in (c for c in features if c in CATEGORICAL):
        names = ["none", *CATEGORICAL[c]]
        level = F.least(F.greatest(F.col(f"__x_{c}") + 1, F.lit(0.0)), F.lit(float(len(names) - 1)))
        df = df.withColumn(f"__x_{c}", level.alias(f"__x_{c}", metadata={"ml_attr": {"type": "nominal", "name": c, "vals": names}}))
    return df


def _assemble(df: DataFrame, features: list[str], medians: dict[str, float]) -> DataFrame:
    """Medians for missing values, one indicator per nullable column, categories as levels, one vector."""
    seen = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in features}
    flags = [c for c in features if c in NULLABLE]
    out = df.withColumns({
        **{f"__x_{c}": F.coalesce(e, F.lit(medians[c])) for c, e in seen.items()},
        **{f"__m_{c}": seen[c].isNull().cast("double") for c in flags}})
    out = _as_levels(out, features)
    inputs = [f"__x_{c}" for c in features] + [f"__m_{c}" for c in flags]
    return VectorAssembler(inputCols=inputs, outputCol="features").transform(out).drop(*inputs)


def medians_of(df: DataFrame, features: list[str]) -> dict[str, float]:
    """One number per feature; a feature never observed counts as 0."""
    got = {r["feature"]: r["median"] for r in reports.column_medians(df, features).collect()}
    return {c: float(got.get(c) or 0.0) for c in features}


def fit(
    df: DataFrame,
    features: list[str],
    label: str = "y_observed",
    exclude: tuple[str, ...] = (),
    exclude_from_calibration: bool = True,
    mined: DataFrame | None = None,
    blank: list[str] = (),
    novelty: IsolationModel | None = None,
    group: str = "vector_id",
    max_iter: int = 40,
    max_depth: int = 5,
    step: float = 0.1,
    isolation: dict | None = None,
    seed: int = 7,
) -> FraudModel:
    """Fits all channels on a split feature table.

    Needs ``txn_id, split``, the label and the features. Families in ``exclude``
    are kept out of training and, by default, of calibration. ``mined`` rows join
    the training set with their own ``weight``. ``blank`` columns are held at 0
    (channel ablation). A given ``novelty`` channel is reused, not refitted.
    """
    assert_no_leakage(features)
    if blank:
        df = df.withColumns({c: F.lit(0.0) for c in blank})
    held = F.coalesce(F.col(group).isin(*exclude), F.lit(False)) if exclude else F.lit(False)
    train = df.filter((F.col("split") == "train") & ~held).withColumn("__label", F.col(label).cast("double"))
    calib = df.filter(F.col("split") == "calib")
    if exclude_from_calibration:
        calib = calib.filter(~held)
    medians = medians_of(train, features)
    rows = training_set(train, mined.withColumn("__label", F.lit(1.0)) if mined is not None else None, "__label")
    rows = _assemble(rows, features, medians).select(
        "features", F.col("__label").alias("label"), "weight", (uniform(seed, F.col("txn_id")) < 0.12).alias("validation"))
    trees = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="weight", validationIndicatorCol="validation",
        maxIter=max_iter, maxDepth=max_depth, stepSize=step, subsamplingRate=0.8, seed=seed, minInstancesPerNode=28,
        cacheNodeIds=True,
    ).fit(rows)
    if novelty is None:
        novelty = fit_isolation(train.filter(F.col("__label") == 0), features, medians, **(isolation or {}))
    model = FraudModel(features, medians, trees, None, novelty, list(blank))
    model.calibrator = calibrate(model.raw(calib), label)
    return model


def calibrate(scored: DataFrame, label: str) -> IsotonicRegressionModel | None:
    """Isotonic map from raw to observed rate; None without rows.

    Rows of equal score are pooled first; different scores stay apart.
    """
    points = scored.groupBy("p_raw").agg(
        F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    if points.isEmpty():
        return None
    return IsotonicRegression(
        featuresCol="p_raw", labelCol="label", weightCol="weight", predictionCol="p_cal").fit(points)


def ablations(
    df: DataFrame, features: list[str], base: FraudModel, groups: dict[str, list[str]] = K.ABLATIONS,
    holdout: tuple[str, ...] = (), budget: float = K.ALERT_BUDGET, **options
) -> DataFrame:
    """What each channel buys: refit without it, measured on the test slice."""
    from ..operators import curves
    from ..operators.feedback import frozen_measure

    def measured(model: FraudModel) -> DataFrame:
        scored = model.transform(df.filter("split = 'test'"))
        return frozen_measure(scored, budget).crossJoin(
            curves.ranking_metrics(curves.score_curve(scored)).select("pr_auc"))

    parts = {"base": measured(base)}
    for tag, cols in groups.items():
        use = [c for c in cols if c in features]
        parts[tag] = measured(fit(df, features, exclude=holdout, blank=use, **options))
    return reports.union_reports(parts)


def importance(
    scored: DataFrame, model, features: list[str], n: int | None = None, top: int = 28, seed: int = 5, tie: str = "txn_id"
) -> DataFrame:
    """Fall in AUC of the fused score when one feature is shuffled between rows.

    Measured on all rows, or with ``n`` on every positive row topped up to ``n``
    with negatives; ``model`` needs ``transform``. Every feature is scored in the same pass.
    """
    from ..operators import curves
    from ..operators.ranks import keep_positives, shuffled_index

    rest = [c for c in features if c != "amount"]
    sample = scored.select(tie, "y", "amount", *rest)
    if n is not None:
        sample = keep_positives(sample, n, seed=seed, tie=tie)
    numbered = shuffled_index(sample, "__i", seed, tie)
    other = shuffled_index(sample, "__i", seed + 1, tie).select("__i", *[F.col(c).alias(f"__p_{c}") for c in features])
    both = numbered.join(other, "__i")
    each = both.withColumn("feature", F.explode(F.array(F.lit("__base"), *[F.lit(c) for c in features])))
    each = each.withColumns({
        c: F.when(F.col("feature") == c, F.col(f"__p_{c}")).otherwise(F.col(c)) for c in features
    }).drop(*[f"__p_{c}" for c in features])
    auc = curves.ranking_metrics(curves.score_curve(model.transform(each), ["feature"]), ["feature"])
    base = auc.filter("feature = '__base'").select(F.col("roc_auc").alias("__b"))
    return (
        auc.filter("feature <> '__base'").crossJoin(F.broadcast(base))
        .select("feature", (F.col("__b") - F.col("roc_auc")).alias("auc_drop"))
        .orderBy(F.desc("auc_drop"), "feature").limit(top)
    )
