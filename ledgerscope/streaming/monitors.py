"""Stateless and windowed views of a payment stream."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.decisions import RULES, apply_rules


def deduplicated(stream: DataFrame, delay: str = "1 hour", ts: str = "ts", key: str = "txn_id") -> DataFrame:
    """First delivery of each payment; state is dropped once the watermark passes."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def alerts(features: DataFrame, threshold: float = 0.5, rules=RULES) -> DataFrame:
    """Payments on which a rule of enough confidence fired. No state."""
    return apply_rules(features, rules).filter(F.col("rule_score") >= threshold)


def running_counters(scored: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """Scored, alerted, caught and missed so far.

    Spark adds up each task's rows before the shuffle, so one hot group costs no
    more than any other.
    """
    alert, fraud = F.col("score") >= threshold, F.col("y") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("scored"), n(alert).alias("alerted"),
        n(alert & fraud).alias("caught"), n(~alert & fraud).alias("missed"))


def sliding_velocity(
    stream: DataFrame, key: str = "customer_id", length: str = "1 hour", slide: str = "5 minutes",
    delay: str = "1 hour", ts: str = "ts",
) -> DataFrame:
    """Counts and sums per key and sliding window: a cheap stand-in for exact trailing spans.

    In append mode the state holds every window a payment falls into: ``ClosedWindows`` tells the
    same from panes. Where the whole answer is told anew each time, keep ``panes`` and make
    ``windows`` of them.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, length, slide).alias("window"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    )


def panes(
    stream: DataFrame, key: str = "customer_id", slide: str = "5 minutes", delay: str = "1 hour", ts: str = "ts",
) -> DataFrame:
    """Counts and sums per key and slide: a payment is in one pane, so the state holds it once."""
    return sliding_velocity(stream, key, slide, slide, delay, ts)


def windows(told: DataFrame, key: str = "customer_id", per_window: int = 12) -> DataFrame:
    """The sliding windows of ``per_window`` panes that hold a payment: ``start_us, key, n, amount``.

    Panes travel to their key once and are copied there, one copy for each window.
    """
    start, end = F.unix_micros("window.start"), F.unix_micros("window.end")
    first = told.select(key, start.alias("__at"), (end - start).alias("__width"), "n", "amount").repartition(key)
    back = first.withColumn("__i", F.explode(F.array(*[F.lit(i) for i in range(per_window)])))
    return (
        back.groupBy(key, (F.col("__at") - F.col("__i") * F.col("__width")).alias("start_us"))
        .agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    )


@dataclass
class ClosedWindows:
    """The windows of ``sliding_velocity`` in append mode: told once, when the watermark passes their end, then forgotten.

    What is kept from one micro-batch to the next are the panes of windows that are still open,
    so a payment is held once and not in each of its windows. As with the engine's own state, a
    micro-batch tells what the payments before it have closed, and a payment still counts in windows
    that close with its own micro-batch; windows told before are not told again.

    Use ``start`` on a ledger stream, then ``finish``, read with ``results``. Every write goes to a folder
    named after the batch and replaces it, so a batch that is run again leaves the same result.
    """

    store: str
    key: str = "customer_id"
    slide_us: int = 300_000_000
    per_window: int = 12
    delay_us: int = 3_600_000_000
    ts: str = "ts"

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        # A micro-batch is read twice, and comes with all columns of its stream.
        return (
            stream.select(self.ts, self.key, "amount").writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.store}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        told, passed = self._marks(spark, batch_id - 1)  # of the micro-batch before
        fresh = panes(batch, self.key, f"{self.slide_us} microseconds", f"{self.delay_us} microseconds", self.ts)
        self._hold(fresh.select("window", self.key, "n", "amount"), batch_id, told)
        self._tell(spark, batch_id, batch_id, told, passed)
        newest = batch.agg(F.max(F.unix_micros(self.ts))).first()[0]
        # The engine's watermark goes by milliseconds, and never back.
        later = passed if newest is None else max(passed, newest // 1000 * 1000 - self.delay_us)
        self._write(spark.range(1).select(F.lit(passed).cast("long").alias("told"), F.lit(later).cast("long").alias("passed")), "marks", batch_id)

    def finish(self, spark: SparkSession) -> DataFrame:
        """At the end of the stream: tells what its last micro-batch has closed, as the engine does in one without rows."""
        last = spark.read.parquet(f"{self.store}/marks").agg(F.max("batch")).first()[0]
        self._tell(spark, last + 1, last, *self._marks(spark, last))
        return spark.read.parquet(f"{self.store}/told").drop("batch")

    def _hold(self, fresh: DataFrame, batch_id: int, told: int) -> None:
        """The new panes and those kept before that are in a window not told yet."""
        if batch_id:
            before = fresh.sparkSession.read.schema(fresh.schema).parquet(f"{self.store}/panes/batch={batch_id - 1}")
            width = self.per_window * self.slide_us
            fresh = fresh.unionByName(before.filter(F.col("window.start") > F.timestamp_micros(F.lit(told - width))))
        self._write(fresh, "panes", batch_id)

    def _tell(self, spark: SparkSession, batch_id: int, held: int, told: int, passed: int) -> None:
        """The windows that end after ``told`` and not after ``passed``, of the panes of a micro-batch."""
        width = self.per_window * self.slide_us
        kept = spark.read.parquet(f"{self.store}/panes/batch={held}")
        closed = kept.filter((F.col("window.start") > F.timestamp_micros(F.lit(told - width))) & (F.col("window.start") < F.timestamp_micros(F.lit(passed))))
        end = F.col("start_us") + width
        made = windows(closed, self.key, self.per_window).filter((end > told) & (end <= passed))
        self._write(made.select(self.key, "start_us", "n", "amount"), "told", batch_id)

    def _marks(self, spark: SparkSession, batch_id: int) -> tuple[int, int]:
        """Up to where windows are told, and the watermark that the next micro-batch goes by."""
        return tuple(spark.read.parquet(f"{self.store}/marks/batch={batch_id}").first()) if batch_id >= 0 else (0, 0)

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.store}/{name}/batch={batch_id}")
