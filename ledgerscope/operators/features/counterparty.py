"""What the device's and the merchant's past say about a payment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...constants import DAY_US, HOUR_US
from ..causal import Running, Trailing, causal
from ..firsts import first_seen

DEVICE_FEATURES = ["device_customer_count", "device_txn_1h", "device_txn_24h", "device_tenure_days"]
MERCHANT_FEATURES = [
    "merchant_txn_1h", "merchant_txn_24h", "merchant_distinct_customers", "merchant_repeat_rate",
    "merchant_tenure_days", "amount_to_merchant_mean",
]


def _history(ledger: DataFrame, key: str, hot: DataFrame | None, tasks: int | None) -> DataFrame:
    rows = ledger.filter(F.col(key).isNotNull()).select("txn_id", key, "customer_id", "ts_us", "amount")
    rows = first_seen(rows, [key], "ts_us", "txn_id", {"customer": "customer_id"}, hot=hot, tasks=tasks)
    one = F.lit(1).cast("long")
    return causal(
        rows.drop("customer_id", "customer_new"), [key], "ts_us",
        [
            Running("n", one),
            Running("customers", F.col("customer_first").cast("long")),
            Running("amount_sum", F.col("amount")),
            Running("first_us", F.col("ts_us"), "min"),
        ],
        [Trailing("n_1h", one, HOUR_US), Trailing("n_24h", one, DAY_US)],
        hot=hot,
    ).withColumn(
        "tenure", F.coalesce((F.col("ts_us") - F.col("first_us")) / F.lit(float(DAY_US)), F.lit(0.0))
    )


def device_features(ledger: DataFrame, hot: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``txn_id`` plus device features, for payments that name a device."""
    h = _history(ledger, "device_id", hot, tasks)
    return h.select(
        "txn_id",
        F.col("customers").cast("double").alias("device_customer_count"),
        F.col("n_1h").cast("double").alias("device_txn_1h"),
        F.col("n_24h").cast("double").alias("device_txn_24h"),
        F.col("tenure").alias("device_tenure_days"),
    )


def merchant_features(ledger: DataFrame, hot: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``txn_id`` plus merchant features, for payments that name a merchant."""
    h = _history(ledger, "merchant_id", hot, tasks)
    n = F.col("n")
    mean = F.col("amount_sum") / F.nullif(n, F.lit(0))
    return h.select(
        "txn_id",
        F.col("n_1h").cast("double").alias("merchant_txn_1h"),
        F.col("n_24h").cast("double").alias("merchant_txn_24h"),
        F.col("customers").cast("double").alias("merchant_distinct_customers"),
        ((n - F.col("customers")) / F.greatest(n, F.lit(1))).alias("merchant_repeat_rate"),
        F.col("tenure").alias("merchant_tenure_days"),
        F.when(n > 2, F.col("amount") / F.greatest(F.lit(50.0), mean)).otherwise(1.0)
        .alias("amount_to_merchant_mean"),
    )
