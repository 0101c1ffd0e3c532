"""Closed windows are made of panes as the engine makes them of payments."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerscope.queries import QUERIES
from ledgerscope.streaming import ClosedWindows, sliding_velocity

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def _stream(spark, path):
    """Four micro-batches; each holds late payments, in windows closed and still open, and rows without a time, key or amount."""
    schema = "ts timestamp, customer_id long, amount double"
    for i, hours in enumerate((0, 5, 8, 9)):
        rows = [(START + dt.timedelta(hours=hours, seconds=131 * k), k % 3 if k % 7 else None, None if k % 5 == 0 else k / 4) for k in range(60)]
        rows += [(START + dt.timedelta(hours=hours, minutes=-20 * k), 1, 1.0) for k in range(1, 16)] + [(None, 1, 9.0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and not os.path.exists(f"{path}/.{name}.seen"):
                os.utime(f"{path}/{name}", (1_700_000_000 + 60 * i, 1_700_000_000 + 60 * i))
                open(f"{path}/.{name}.seen", "w").close()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(path)


def test_closed_windows_equal_those_of_the_engine(spark, tmp_path):
    stream = _stream(spark, f"{tmp_path}/in")
    told = sliding_velocity(stream).select("customer_id", F.unix_micros("window.start").alias("start_us"), "n", "amount")
    (told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
     .start(f"{tmp_path}/engine").awaitTermination())
    want = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/engine").collect()), key=str)
    job = ClosedWindows(f"{tmp_path}/job")
    job.start(stream).awaitTermination()
    got = sorted(map(tuple, job.finish(spark).select("customer_id", "start_us", "n", "amount").collect()), key=str)
    assert len(want) > 100 and got == want
    held = [spark.read.parquet(f"{tmp_path}/job/panes/batch={i}").agg(F.sum("n")).first()[0] for i in range(4)]
    assert held[0] == 75 and all(n <= 75 * (i + 1) for i, n in enumerate(held)) and held[3] < held[2]  # a payment once, and not for ever


def test_query_keeps_no_window_in_the_state(spark, sf_dir, monkeypatch):
    from ledgerscope.queries import stream_queries

    monkeypatch.setattr(stream_queries, "finish", lambda *a, **b: pytest.fail("windows of the engine's state"))
    out = QUERIES["st6_closed_windows"](spark, sf_dir)
    assert out.count() > 0 and out.groupBy("customer_id", "start_us").count().filter("count > 1").isEmpty()
