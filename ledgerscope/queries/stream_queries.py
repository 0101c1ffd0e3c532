"""Streaming jobs run to the end of what the tables hold now."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..operators.decisions import Rule
from ..sources import tables as T
from ..streaming import ClosedWindows, KeyedFeatures, OnlineFeatures, alerts, assembled, deduplicated, panes, running_counters, windows
from ..streaming.keyed import ENTITIES, FEATURES, dropped_late, rocksdb
from .feature_queries import BASE_SQL, FEATURE_SQL
from .other_queries import scratch
from .registry import HALF, LEDGER_SQL, n, r
from .report_queries import register


def stream_of(spark, sf, name):
    """The table as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return T.wall_clock_utc(raw)


def ledger_stream(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    return stream_of(spark, sf, "events").select("*", k).selectExpr(*[f"{e} AS {c}" for c, e in T.LEDGER_COLUMNS.items()])


SLICES = 3
DELAY_US = 3_600_000_000
# The slice that brings a payment: by thirds of the time range; every 97th of the first comes last.
SLICE_SQL = ("CASE WHEN event_id % 97 = 0 THEN {late} ELSE least(2, CAST(floor((us - lo) * 3.0e0 / (hi - lo + 1)) AS INT)) END")


FILES = 4


def deliver(df, path):
    """Appends the rows of one micro-batch as exactly ``FILES`` files; a part without rows leaves none, so empty ones make up for it."""
    spark = df.sparkSession
    try:
        before = len(spark.read.parquet(path).inputFiles())
    except AnalysisException:
        before = 0
    df.repartition(FILES).write.mode("append").parquet(path)
    for _ in range(before + FILES - len(spark.read.parquet(path).inputFiles())):
        spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)


def sliced_stream(spark, sf, late: bool = False):
    """The ledger as a stream of three micro-batches in the order of time; with ``late``, some early rows come last."""
    path = f"{scratch(spark, 'events')}/events"
    raw = T.read(spark, sf, "events").withColumn("us", F.unix_micros("ts"))
    ends = raw.agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    own = "least(2, CAST(floor((us - lo) * 3.0e0 / (hi - lo + 1)) AS INT))"
    cut = raw.crossJoin(F.broadcast(ends)).withColumn("slice", F.expr(SLICE_SQL.format(late=2 if late else own))).drop("us", "lo", "hi")
    for i in range(SLICES):  # written one after the other, which is the order they are read in
        deliver(cut.filter(F.col("slice") == i).drop("slice"), path)
    schema = spark.read.parquet(path).schema
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(path)
    return stream.select("*", k).selectExpr(*[f"{e} AS {c}" for c, e in T.LEDGER_COLUMNS.items()])


def finish(stream, spark, name, mode="append", told=lambda df: df):
    """Runs the stream to its end into Parquet and reads the result back; ``told`` makes what is written of a complete answer."""
    path = scratch(spark, name)
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").start(f"{path}/out")
    else:
        q = writer.foreachBatch(lambda df, i: told(df).write.mode("overwrite").parquet(f"{path}/out/batch={i}")).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    if mode == "append":
        return out
    last = out.agg(F.max("batch")).first()[0]
    return out.filter(F.col("batch") == last).drop("batch")


ONLINE = ["cust_txn_1h", "cust_txn_24h", "cust_amt_7d", "secs_since_last_txn", "device_txn_24h", "merchant_txn_1h",
          "is_new_merchant", "benef_in_count_24h", "benef_distinct_payers_24h", "sender_in_24h"]


@register("st1_st2_st3_online_features", f"{BASE_SQL} SELECT txn_id, " + ", ".join(r(FEATURE_SQL[c], c) for c in ONLINE) + " FROM j")
def _st1(spark, sf):
    job = KeyedFeatures(scratch(spark, "online"), ONLINE, T.customers(spark, sf))
    job.start(sliced_stream(spark, sf)).awaitTermination()
    return job.results(spark).select("txn_id", *ONLINE)


@register("st1_keyed_features", f"{BASE_SQL} SELECT txn_id, " + ", ".join(r(FEATURE_SQL[c], c) for c in FEATURES) + " FROM j")
def _st1_keyed(spark, sf):
    """Everything the keyed state answers, with the busiest customers and accounts held in parts."""
    ledger = T.ledger(spark, sf)
    n = lambda kind, c: ledger.filter(F.col(c).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("entity")).count()
    counts = n("customer", "customer_id").union(n("account", "beneficiary_id")).union(n("device", "device_id"))
    busy = counts.filter("count >= 60").select("kind", "entity", F.lit(3).alias("parts"))
    job = KeyedFeatures(scratch(spark, "keyed"), list(FEATURES), T.customers(spark, sf), busy)
    job.start(sliced_stream(spark, sf)).awaitTermination()
    return job.results(spark).select("txn_id", *FEATURES)


SIDES = {
    "customer": (tuple(e for e in ENTITIES if e.kind in ("customer", "dispute")), ["cust_txn_24h", "cust_amt_7d", "is_new_merchant", "cust_prior_disputes_90d"]),
    "account": (tuple(e for e in ENTITIES if e.kind == "account"), ["benef_in_count_24h", "benef_distinct_payers_24h", "sender_in_24h"]),
}
HELD_BACK = "slice = 0 AND txn_id % 97 = 0"  # answers of the account side that come after all others
ASSEMBLE_SQL = (f"{BASE_SQL}, cut AS (SELECT *, least(2, CAST(floor((ts_us - min(ts_us) OVER ()) * 3.0e0 / (max(ts_us) OVER () - min(ts_us) OVER () + 1)) AS INT)) AS slice, "
                "beneficiary_id IS NOT NULL OR self_account IS NOT NULL AS answered FROM j) ")


def _assembled(spark, sf):
    """Both sides of each payment's answers from two jobs, delivered slice by slice and joined as streams."""
    sides = {}
    for side, (entities, names) in SIDES.items():
        job = KeyedFeatures(scratch(spark, side), names, T.customers(spark, sf), entities=entities)
        job.start(sliced_stream(spark, sf)).awaitTermination()
        found = job.results(spark, keep_batch=True).withColumnRenamed("batch", "slice").filter("slice < 3")
        path = f"{scratch(spark, side)}/partials"
        held = F.expr(HELD_BACK if side == "account" else "false")
        for i in range(SLICES):
            deliver(found.filter((F.col("slice") == i) & ~held).drop("slice"), path)
        if side == "account":
            deliver(found.filter(held).drop("slice"), path)
        sides[side] = spark.readStream.schema(found.drop("slice").schema).option("maxFilesPerTrigger", FILES).parquet(path)
    path = scratch(spark, "assembled")
    with rocksdb(spark):  # the payments that wait for their other side are as many as the watermark leaves open
        q = (assembled(sides["customer"], sides["account"]).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out"))
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out"), dropped_late(q, "symmetricHashJoin")


BOTH_SIDES = [c for _, names in SIDES.values() for c in names]


@register("st2_assembled_partials", f"{ASSEMBLE_SQL} SELECT txn_id, " + ", ".join(r(FEATURE_SQL[c], c) for c in BOTH_SIDES) + f" FROM cut WHERE answered AND NOT ({HELD_BACK})")
def _st2(spark, sf):
    return _assembled(spark, sf)[0].select("txn_id", *BOTH_SIDES)


@register("st2_late_partials", f"{ASSEMBLE_SQL} SELECT {n(f'count(*) FILTER (answered AND NOT ({HELD_BACK}))', 'assembled')}, {n(f'count(*) FILTER (answered AND {HELD_BACK})', 'late')} FROM cut")
def _st2_late(spark, sf):
    rows, late = _assembled(spark, sf)
    return rows.agg(F.count(F.lit(1)).alias("assembled"), F.lit(late).cast("long").alias("late"))


def _newest(kind: str, column: str, span: int, lifetime: bool, when: str = "true") -> str:
    return (f"SELECT '{kind}' AS kind, count(*) FILTER (newest >= wm - {span}) AS held, {'count(*)' if lifetime else '0'} AS lifetime FROM "
            f"(SELECT {column} AS e, max(ts_us) AS newest, (SELECT max(ts_us) // 1000 * 1000 - {DELAY_US} FROM ledger) AS wm FROM ledger WHERE {column} IS NOT NULL AND {when} GROUP BY {column})")


@register("st3_state_eviction", f"WITH {LEDGER_SQL}, " + "u AS (" + " UNION ALL ".join(
    _newest(e.kind, e.told_by, max(e.spans), e.lifetime, e.when) for e in ENTITIES) + f") SELECT kind, {n('held', 'held')}, {n('lifetime', 'lifetime')} FROM u")
def _st3(spark, sf):
    """Entities that still hold recent events once the stream has ended, and those with lifetime totals."""
    job = KeyedFeatures(scratch(spark, "evicted"), ["cust_txn_1h"], T.customers(spark, sf))
    job.start(sliced_stream(spark, sf)).awaitTermination()
    count = lambda name, c: F.sum(F.when(F.col("state") == name, 1).otherwise(0)).alias(c)
    both = job.state(spark, "recent").withColumn("state", F.lit("recent")).union(job.state(spark, "life").withColumn("state", F.lit("life")))
    return both.groupBy("kind").agg(count("recent", "held"), count("life", "lifetime"))


SMALL_RULES = [
    Rule("big", 0.9, "", "Large amount", lambda f: f("amount") > 500.0),
    Rule("agent", 0.6, "", "Agent payment", lambda f: f("is_agentic") > 0),
]


@register("st4_rule_alerts", f"WITH {LEDGER_SQL} SELECT txn_id, CAST(CASE WHEN amount > 500 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS rule_score FROM ledger WHERE amount > 500 OR is_agentic > 0")
def _st4(spark, sf):
    return finish(alerts(ledger_stream(spark, sf), 0.5, SMALL_RULES).select("txn_id", "rule_score"), spark, "alerts")


@register("st5_running_counters", f"WITH {LEDGER_SQL}, s AS (SELECT rail, is_fraud AS y, (txn_id * 7919 % 10007) / 10007e0 AS score FROM ledger) SELECT rail, {n('count(*)', 'scored')}, {n('count(*) FILTER (score >= 0.8)', 'alerted')}, {n('count(*) FILTER (score >= 0.8 AND y = 1)', 'caught')}, {n('count(*) FILTER (score < 0.8 AND y = 1)', 'missed')} FROM s GROUP BY rail")
def _st5(spark, sf):
    s = ledger_stream(spark, sf).select("rail", F.col("is_fraud").alias("y"), F.expr("(txn_id * 7919 % 10007) / 10007e0").alias("score"))
    return finish(running_counters(s, 0.8, ["rail"]), spark, "counters", "complete")


@register("st6_sliding_velocity", f"WITH {LEDGER_SQL}, w AS (SELECT customer_id, amount, ts_us // 300000000 * 300000000 - i * 300000000 AS start_us FROM ledger, range(12) t(i)) SELECT customer_id, start_us, {n('count(*)', 'n')}, {r('sum(amount)', 'amount', 2)} FROM w GROUP BY customer_id, start_us")
def _st6(spark, sf):
    out = finish(panes(ledger_stream(spark, sf)), spark, "velocity", "complete", windows).select("customer_id", "start_us", "n", "amount")
    return out.withColumn("amount", F.floor(F.col("amount") * 100 + HALF) / 100)


LATE_SQL = (
    "e AS (SELECT event_id, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events), "
    f"s AS (SELECT us, {SLICE_SQL.format(late=2)} AS slice FROM e), "
    f"a AS (SELECT *, slice > 0 AND us < (SELECT max(us) FROM s WHERE slice = 0) - {DELAY_US} AS late1 FROM s), "
    f"b AS (SELECT *, CASE WHEN slice = 1 THEN late1 WHEN slice = 2 THEN us < (SELECT max(us) FROM a WHERE slice < 2 AND NOT late1) - {DELAY_US} ELSE false END AS late FROM a)")


@register("st7_late_rows", f"WITH {LATE_SQL} SELECT CAST(count(*) FILTER (late) AS BIGINT) AS late, CAST(count(*) FILTER (NOT late) AS BIGINT) AS kept FROM b")
def _st7(spark, sf):
    job = OnlineFeatures(scratch(spark, "late"), ["cust_txn_1h"], delay_us=DELAY_US)
    job.start(sliced_stream(spark, sf, late=True)).awaitTermination()
    kept = job.results(spark).agg(F.count(F.lit(1)).alias("kept"))
    return job.results(spark, "late").agg(F.sum("late").alias("late")).crossJoin(F.broadcast(kept))


ENGINE_LATE_SQL = (
    "e AS (SELECT event_id, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS lo, max(epoch_us(ts)) OVER () AS hi FROM events), "
    f"s AS (SELECT us, {SLICE_SQL.format(late=2)} AS slice FROM e), "
    f"b AS (SELECT slice = 2 AND us <= (SELECT max(us) // 1000 * 1000 - {DELAY_US} FROM s WHERE slice = 0) AS late FROM s)")


@register("st7_late_rows_by_engine", f"WITH {ENGINE_LATE_SQL} SELECT {n('count(*) FILTER (late)', 'late')}, {n('count(*) FILTER (NOT late)', 'kept')} FROM b")
def _st7_engine(spark, sf):
    """The engine drops and counts; its watermark is that of the micro-batch before the last finished one."""
    path = scratch(spark, "late")
    q = (deduplicated(sliced_stream(spark, sf, late=True)).select("txn_id").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out"))
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.lit(dropped_late(q)).cast("long").alias("late"), F.count(F.lit(1)).alias("kept"))


@register("st6_closed_windows", f"WITH {LEDGER_SQL}, w AS (SELECT customer_id, amount, ts_us // 300000000 * 300000000 - i * 300000000 AS start_us FROM ledger, range(12) t(i)), "
          f"m AS (SELECT max(ts_us) // 1000 * 1000 - {DELAY_US} AS wm FROM ledger) SELECT customer_id, start_us, {n('count(*)', 'n')}, {r('sum(amount)', 'amount', 2)} FROM w, m WHERE start_us + 3600000000 <= wm GROUP BY customer_id, start_us")
def _st6_closed(spark, sf):
    """Append mode: a window is told once, when the watermark passes its end, and then forgotten."""
    job = ClosedWindows(scratch(spark, "closed"), delay_us=DELAY_US)
    job.start(sliced_stream(spark, sf)).awaitTermination()
    out = job.finish(spark).select("customer_id", "start_us", "n", "amount")
    return out.withColumn("amount", F.floor(F.col("amount") * 100 + HALF) / 100)


@register("st8_stream_equals_batch", "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS different FROM events")
def _st8(spark, sf):
    from ..operators.features import features

    names = ["cust_txn_24h", "cust_amt_24h", "merchant_txn_24h"]
    job = OnlineFeatures(scratch(spark, "equal"), names)
    job.start(sliced_stream(spark, sf)).awaitTermination()
    online = job.results(spark).select("txn_id", *[F.col(c).alias(f"s_{c}") for c in names])
    both = features(T.ledger(spark, sf), columns=names).join(online, "txn_id")
    differs = ~(F.col(names[0]).eqNullSafe(F.col(f"s_{names[0]}")))
    for c in names[1:]:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"s_{c}"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(differs, 1)).alias("different"))


@register("st9_deduplicated", "SELECT DISTINCT event_id AS txn_id FROM events")
def _st9(spark, sf):
    doubled = ledger_stream(spark, sf).select("ts", "txn_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    return finish(deduplicated(doubled).select("txn_id"), spark, "dedup")
