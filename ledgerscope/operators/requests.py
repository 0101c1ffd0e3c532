"""What-if scoring: partial requests filled up with population medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import RAILS
from ..functions.columns import ordinal


def fill_requests(requests: DataFrame, medians: DataFrame, features: list[str]) -> DataFrame:
    """Full feature rows: the request where it says something, else the median.

    ``medians`` has one row and a column per feature. Flags that follow from other
    fields are recomputed when the request sets their source.
    """
    have = set(requests.columns)
    given = {c: F.col(f"r.{c}") for c in features if c in have}
    if "beneficiary_age_days" in have:
        given["benef_age_days"] = F.col("r.beneficiary_age_days")
    if "amount" in have:
        given["log_amount"] = F.log1p("r.amount")
    if "rail" in have:
        given["cat_rail"] = F.when(F.col("r.rail").isNotNull(), ordinal(F.col("r.rail"), RAILS))
    if "coercion_score" in have:
        given["has_episode"] = F.when(F.col("r.coercion_score") > 0, 1.0).when(
            F.col("r.coercion_score").isNotNull(), 0.0)
    if {"screen_share", "is_new_beneficiary"} <= have:
        given["screen_share_and_new_benef"] = F.col("r.screen_share") * F.col("r.is_new_beneficiary")
    keys = [F.col(f"r.{c}") for c in requests.columns if c not in features and c not in ("rail", "beneficiary_age_days")]
    full = requests.alias("r").crossJoin(F.broadcast(medians.alias("m")))
    return full.select(*keys, *[
        F.coalesce(given[c].cast("double"), F.col(f"m.{c}")).alias(c) if c in given else F.col(f"m.{c}").alias(c)
        for c in features])


def median_row(medians: DataFrame, features: list[str]) -> DataFrame:
    """(feature, median) rows as one wide row; features never observed get 0."""
    return medians.agg(*[
        F.coalesce(F.max(F.when(F.col("feature") == c, F.col("median"))), F.lit(0.0)).alias(c) for c in features])
