"""Exact features for every micro-batch, equal to the batch job.

The state of all entities is the recent ledger itself, kept as Parquet in a
shared folder. Each micro-batch is featurised together with the history it can
still see, by the same operators as the batch job, so a hot key is sliced over
many tasks here too and no single state object grows with a key's traffic.

Every write goes to a folder named after the batch and replaces it, so a batch
that is run again after a failure leaves the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import FEATURE_NAMES, features
from ..operators.hot import DEFAULT_LIMIT
from ..sources.schema import conform


# Features that a window of the past does not determine.
WINDOWED = {
    "cust_txn_1h", "cust_txn_24h", "cust_txn_7d", "cust_amt_1h", "cust_amt_24h", "cust_amt_7d", "cust_burst_ratio",
    "cust_amt_24h_to_balance", "device_txn_1h", "device_txn_24h", "merchant_txn_1h", "merchant_txn_24h",
    "benef_in_count_1h", "benef_in_count_24h", "benef_distinct_payers_24h", "benef_in_amt_24h", "benef_out_count_1h",
    "sender_in_24h", "cust_prior_disputes_90d",
}
LIFETIME = {
    n for n in FEATURE_NAMES if n not in WINDOWED and n.startswith(("cust_", "is_new_", "secs_", "merchant_", "device_", "benef_", "sender_", "dist_from_last", "travel_", "hour_dev"))
} | {"amount_z_customer", "amount_to_p95", "amount_to_merchant_mean", "session_ratio_customer", "hesitation_ratio_customer",
     "typing_variance_ratio", "screen_share_and_new_benef", "mandate_ceiling_to_typical", "mandate_drawdown_ratio"}


@dataclass
class OnlineFeatures:
    """Use ``start`` on a ledger stream, read results with ``results``.

    ``retention_us`` drops history older than the longest span in use. It is
    refused together with features that look at a whole life (``LIFETIME``),
    which need all of the history. Payments more than ``delay_us``
    behind the newest one seen before their batch are late: they are left out and
    counted in ``late``.
    """

    store: str
    columns: list[str] = field(default_factory=lambda: list(FEATURE_NAMES))
    customers: DataFrame | None = None
    merchants: DataFrame | None = None
    retention_us: int | None = None
    delay_us: int | None = None
    limit: int = DEFAULT_LIMIT
    episodes: DataFrame | None = None

    def __post_init__(self) -> None:
        lifetime = sorted(LIFETIME.intersection(self.columns))
        if self.retention_us is not None and lifetime:
            raise ValueError(f"retention would change lifetime features: {', '.join(lifetime)}")

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.store}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        rows = conform(batch).dropDuplicates(["txn_id"])
        history = self._history(batch.sparkSession, batch_id)
        if history is not None:
            seen = history.agg(F.max("ts_us")).first()[0]
            if self.delay_us is not None and seen is not None:
                late = F.col("ts_us") < seen - self.delay_us
                self._write(rows.filter(late).agg(F.count(F.lit(1)).alias("late")), "late", batch_id)
                rows = rows.filter(~late)
            rows = rows.join(history.select("txn_id"), "txn_id", "left_anti")
        self._write(rows.drop("ts_us"), "history", batch_id)
        spark = batch.sparkSession
        fresh = spark.read.parquet(f"{self.store}/history/batch={batch_id}")
        first = fresh.agg(F.min(F.unix_micros("ts"))).first()[0]
        if first is None:
            return
        known = fresh
        if history is not None:
            if self.retention_us is not None:
                history = history.filter(F.col("ts_us") >= first - self.retention_us)
            known = fresh.unionByName(history.drop("ts_us", "batch"))
        table = features(known, self.customers, self.merchants, self.episodes, columns=self.columns, limit=self.limit)
        self._write(table.join(fresh.select("txn_id"), "txn_id", "left_semi"), "features", batch_id)

    def _history(self, spark, batch_id: int) -> DataFrame | None:
        try:
            old = spark.read.parquet(f"{self.store}/history")
        except AnalysisException:
            return None
        old = old.filter(F.col("batch") < batch_id)
        return None if old.isEmpty() else old.withColumn("ts_us", F.unix_micros("ts"))

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.store}/{name}/batch={batch_id}")

    def results(self, spark, name: str = "features") -> DataFrame:
        return spark.read.parquet(f"{self.store}/{name}")
