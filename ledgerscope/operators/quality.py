"""Label noise, telemetry masking, and the checks a ledger must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    FALSE_FRAUD_RATE, FORBIDDEN_FEATURES, MISSED_FRAUD_RATE, OPTIONAL_TELEMETRY, TELEMETRY_COVERAGE,
)
from ..functions.columns import uniform


def label_noise(
    df: DataFrame, splits: tuple[str, ...] = ("train", "calib"), missed: float = MISSED_FRAUD_RATE,
    false: float = FALSE_FRAUD_RATE, seed: int = 31, label: str = "y", tie: str = "txn_id",
    draw: Column | None = None,
) -> DataFrame:
    """Adds ``y_observed``: labels with unreported and mistaken fraud in the given splits only.

    ``draw`` gives each row's number in [0, 1); by default a hash of ``tie``.
    """
    u = uniform(seed, F.col(tie)) if draw is None else draw
    y = F.col(label)
    flipped = F.when((y == 1) & (u < missed), 0).when((y == 0) & (u < false), 1).otherwise(y)
    return df.withColumn("y_observed", F.when(F.col("split").isin(*splits), flipped).otherwise(y).cast("int"))


def mask_columns(
    df: DataFrame, columns: list[str] = OPTIONAL_TELEMETRY, coverage: float = TELEMETRY_COVERAGE,
    seed: int = 7, tie: str = "txn_id", draw: Column | None = None,
) -> DataFrame:
    """Removes the columns together from a share of rows, independent of the label."""
    if coverage >= 0.999:
        return df
    keep = (uniform(seed, F.col(tie)) if draw is None else draw) < coverage
    return df.withColumns({c: F.when(keep, F.col(c)) for c in columns})


def assert_no_leakage(columns: list[str]) -> None:
    """Raises when an identifier, a label or a raw category would become a model input."""
    bad = sorted(FORBIDDEN_FEATURES & set(columns))
    if bad:
        raise ValueError(f"must not be features: {bad}")


def split_ranges(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def split_overlap(df: DataFrame) -> DataFrame:
    """Rows of a split that reach past the start of the next; empty when the split is clean."""
    wide = df.agg(
        F.max(F.when(F.col("split") == "train", F.col("ts_us"))).alias("train_last"),
        F.min(F.when(F.col("split") == "calib", F.col("ts_us"))).alias("calib_first"),
        F.max(F.when(F.col("split") == "calib", F.col("ts_us"))).alias("calib_last"),
        F.min(F.when(F.col("split") == "test", F.col("ts_us"))).alias("test_first"))
    return wide.select(
        (F.col("train_last") > F.col("calib_first")).alias("train_overlaps_calib"),
        (F.col("calib_last") > F.col("test_first")).alias("calib_overlaps_test"))


def band_checks(ledger: DataFrame) -> DataFrame:
    """Prevalence and legitimate-anomaly rate against their sane bands."""
    rates = ledger.agg(
        F.avg((F.col("is_fraud") == 1).cast("double")).alias("fraud_rate"),
        (F.count("benign_anomaly") / F.greatest(F.count(F.when(F.col("is_fraud") == 0, 1)), F.lit(1)))
        .alias("benign_anomaly_rate"))
    return rates.select(
        "fraud_rate", F.col("fraud_rate").between(0.005, 0.05).alias("fraud_rate_ok"),
        "benign_anomaly_rate", (F.col("benign_anomaly_rate") > 0.02).alias("benign_anomaly_rate_ok"))


def table_checks(df: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Row count, duplicated keys and missing required values.

    Duplicates are counted per key first, so no distinct set has to be held.
    """
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"__{c}") for c in required])
    return per_key.agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        *[(F.sum("n") - F.sum(f"__{c}")).alias(f"missing_{c}") for c in required])


def causality_gap(full: DataFrame, truncated: DataFrame, columns: list[str], key: str = "txn_id") -> DataFrame:
    """Largest change of each feature after later rows were removed; all 0 when causal."""
    b = truncated.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = full.join(b, key)
    gap = [
        F.max(F.when(F.col(c).isNull() != F.col(f"__{c}").isNull(), F.lit(float("inf")))
              .otherwise(F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")), F.lit(0.0)))).alias(c)
        for c in columns]
    return both.agg(F.count(F.lit(1)).alias("rows"), *gap)
