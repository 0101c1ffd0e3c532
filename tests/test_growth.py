"""What a task, the state or the driver holds does not grow with the input."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerscope.operators.features import features
from ledgerscope.operators.features.account import account_timeline
from ledgerscope.operators.features.assemble import attach_dimensions
from ledgerscope.operators.hot import tasks_for
from ledgerscope.sources import files
from ledgerscope.sources import tables as T
from ledgerscope.streaming import panes, sliding_velocity, windows


def test_parts_of_a_spread_table_are_bounded_in_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = 100_000 * (cores + 1) + 1
    assert T.spread(spark.range(rows).coalesce(1), "id").rdd.getNumPartitions() == cores + 2
    assert T.spread(spark.range(50).coalesce(1), "id").rdd.getNumPartitions() == cores
    assert tasks_for(spark.range(1000), 10) == 100 and tasks_for(spark.range(10), 10) is None


def test_payments_without_a_key_do_not_meet_in_one_task(spark):
    ledger = spark.range(2000).select(
        F.col("id").alias("txn_id"), F.col("id").alias("ts_us"), F.lit(0).cast("long").alias("customer_id"), F.lit(0.0).alias("coercion_score"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("m"), F.col("id") % 7)).alias("merchant_id"),
        F.when(F.col("id") % 10 == 1, F.col("id") % 9).alias("narrative_id"))
    merchants = spark.range(5).select(F.concat(F.lit("m"), "id").alias("merchant_id"), (F.col("id") / 10).alias("chargeback_rate"))
    merchants = merchants.union(spark.sql("SELECT CAST(NULL AS STRING), 9.0D"))
    episodes = spark.range(5).select(F.col("id").alias("episode_id"), F.lit(3).alias("turn_count"), F.lit(1.5).alias("duration_s"))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for part in ({"merchants": merchants}, {"episodes": episodes}):
            out = attach_dimensions(ledger, **part)
            held = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert sum(held) == 2000 and max(held) < 700
        got = attach_dimensions(ledger, merchants=merchants, episodes=episodes).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for r in got:
        i = r["txn_id"]
        assert r["dim_chargeback_rate"] == (i % 7 / 10 if i % 10 == 0 and i % 7 < 5 else None)
        assert r["episode_turn_count"] == (3 if i % 10 == 1 and i % 9 < 5 else None)


def test_tasks_write_as_many_files_as_they_need(spark, tmp_path):
    df = spark.range(1000).select("id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") % 4 * 86_400_000_000).alias("ts"))
    files.write_columnar(df, f"{tmp_path}/d", rows_per_file=10)
    told = spark.read.parquet(f"{tmp_path}/d").groupBy(F.input_file_name().alias("f")).count().collect()
    assert sum(r["count"] for r in told) == 1000 and max(r["count"] for r in told) <= 10 and len(told) == 100
    assert len({r["f"].rsplit("/", 1)[1].split("-")[1] for r in told}) <= 4  # tasks, one a day


def test_panes_hold_a_payment_once_and_give_every_window(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(start + dt.timedelta(seconds=97 * i), i % 3 if i % 11 else None, None if i % 13 == 0 else i / 4) for i in range(150)]
    df = spark.createDataFrame([*rows, *rows[:5], (None, 1, 2.0)], "ts timestamp, customer_id long, amount double")
    want = sliding_velocity(df).select("customer_id", F.unix_micros("window.start").alias("start_us"), "n", "amount")
    assert {tuple(r) for r in windows(panes(df)).select(*want.columns).collect()} == {tuple(r) for r in want.collect()}
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = (panes(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
         .foreachBatch(lambda b, i: windows(b).write.mode("overwrite").parquet(f"{tmp_path}/out")).start())
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 150
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*want.columns).collect()} == {tuple(r) for r in want.collect()}


def test_an_account_line_has_the_moments_of_moves_only(spark):
    flows = spark.createDataFrame([("a", "b", 1, 10, 5.0), ("c", "b", 2, 20, 7.0), ("b", "d", 1, 4_000_000_000, 6.0), (None, "b", 1, 20, 1.0)],
                                  "src string, dst string, payer long, ts_us long, amount double")
    for limit in (1, 1000):
        line = account_timeline(flows, limit=limit).collect()
        assert {(r["acct"], r["ts_us"]) for r in line} == {("a", 10), ("b", 10), ("c", 20), ("b", 20), ("b", 4_000_000_000), ("d", 4_000_000_000)} and len(line) == 6
        b = {r["ts_us"]: r for r in line if r["acct"] == "b"}
        assert (b[20]["credits"], b[20]["payers_24h"], b[20]["in_amt_24h"]) == (1, 1, 5_000_000)
        assert (b[4_000_000_000]["credits"], b[4_000_000_000]["payers_24h"], b[4_000_000_000]["in_n_1h"], b[4_000_000_000]["in_n_24h"]) == (3, 2, 0, 3)
    few = account_timeline(flows, columns=["credits", "in_amt_24h"], tasks=3)
    assert few.columns == ["acct", "ts_us", "credits", "in_amt_24h"]
    assert {tuple(r) for r in few.collect()} == {(r["acct"], r["ts_us"], r["credits"], r["in_amt_24h"]) for r in line}


def test_features_of_many_tasks_equal_those_of_few(spark, sf_dir, monkeypatch):
    from ledgerscope.operators.features import assemble

    tables = T.ledger(spark, sf_dir), T.customers(spark, sf_dir), T.merchants(spark, sf_dir)
    names = ["amount_to_p95", "cust_txn_24h", "device_customer_count", "merchant_repeat_rate", "benef_distinct_payers_24h", "sender_in_24h"]
    few = features(*tables, columns=names).select("txn_id", *names)
    monkeypatch.setattr(assemble, "tasks_for", lambda df: 11)
    many = features(*tables, columns=names).select("txn_id", *names)
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_moves_without_a_time_are_not_told(spark, tmp_path):
    from ledgerscope.queries import QUERIES

    spark.sql("SELECT * FROM VALUES (1L, 7L, TIMESTAMP '2024-01-01'), (2L, 8L, CAST(NULL AS TIMESTAMP)) AS t(o_orderkey, o_custkey, o_orderdate)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("SELECT * FROM VALUES (1L, 3L, 10.0D, 1), (2L, 3L, 20.0D, 1) AS t(l_orderkey, l_suppkey, l_extendedprice, l_linenumber)").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = QUERIES["j15_account_state"](spark, str(tmp_path)).collect()
    assert {r["acct"] for r in rows} == {"7", "3"} and len(rows) == 2 and all(r["ts_us"] == 1_704_067_200_000_000 for r in rows)
