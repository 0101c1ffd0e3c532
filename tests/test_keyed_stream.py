"""Keyed streaming state: equal to the batch features, split for busy entities, evicted, and counting late rows."""

import datetime as dt
import random

from ledgerscope.operators.features import features
from ledgerscope.streaming.keyed import ENTITIES, FEATURES, KeyedFeatures, dropped_late, merged_answers, questions

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "txn_id LONG, ts TIMESTAMP, customer_id STRING, amount DOUBLE, merchant_id STRING, beneficiary_id STRING, device_id STRING, dispute_filed INT"


def payments(rng, first, n, start, minutes):
    out = []
    for i in range(n):
        at = start + dt.timedelta(minutes=rng.choice([minutes * i, minutes * (i // 4)]))
        pick = lambda prefix, k: rng.choice([None, *[f"{prefix}{j}" for j in range(k)]])
        out.append((first + i, at, rng.choice(["c0", "c0", "c0", "c1", "c2"]), float(rng.randrange(1, 900)) / 4, pick("m", 3), pick("u", 2), pick("d", 2), rng.choice([0, 0, 1])))
    return sorted(out, key=lambda r: r[1])


def delivered(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, job, path):
    q = job.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path))
    q.awaitTermination()
    return q


def test_state_over_restarts_equals_the_batch_and_reads_only_new_rows(spark, tmp_path):
    rng = random.Random(1)
    slices = [payments(rng, 1000 * i, 60, T0 + dt.timedelta(days=4 * i), 37) for i in range(4)]
    slices[1].append(slices[1][5])  # delivered twice
    customers = spark.createDataFrame([("c0", "u0"), ("c1", None)], "customer_id STRING, self_account STRING")
    busy = spark.createDataFrame([("customer", "c0", 3), ("account", "u0", 4), ("device", "d1", 2)], "kind STRING, entity STRING, parts INT")
    path, names = f"{tmp_path}/in", list(FEATURES)
    job = KeyedFeatures(f"{tmp_path}/job", names, customers, busy)
    for part in slices[:2]:
        delivered(spark, part, path)
    first = run(spark, job, path)
    assert [p.numInputRows for p in first.recentProgress if p.numInputRows] == [60, 61]
    held = job.state(spark).count()
    for part in slices[2:]:
        delivered(spark, part, path)
    second = run(spark, job, path)  # goes on from the checkpoint
    assert [p.numInputRows for p in second.recentProgress if p.numInputRows] == [60, 60]
    got = {r["txn_id"]: r for r in job.results(spark).collect()}
    all_rows = spark.createDataFrame([r for s in slices for r in s], SCHEMA).dropDuplicates(["txn_id"])
    dims = customers.selectExpr("*", "'IN' AS country", "0D AS lat", "0D AS lon", "'c' AS city", "'p' AS persona", "0D AS balance")
    want = {r["txn_id"]: r for r in features(all_rows, dims, columns=names).collect()}
    assert len(got) == len(want) == 240
    for k, w in want.items():
        assert all(abs(got[k][c] - w[c]) < 1e-6 for c in names), (k, {c: (got[k][c], w[c]) for c in names if abs(got[k][c] - w[c]) >= 1e-6})
    # Four days apart: what 24 hours look at has gone, totals and disputes have stayed.
    kinds = {r["kind"] for r in job.state(spark).collect()}
    assert "dispute" in kinds and {r["kind"] for r in job.state(spark, "life").collect()} == {"customer", "merchant"}
    assert held > 0


def test_eviction_empties_idle_entities_and_late_rows_are_counted(spark, tmp_path):
    row = lambda i, hours, c: (i, T0 + dt.timedelta(hours=hours), c, 1.0, None, None, f"d{i}", 0)
    path, job = f"{tmp_path}/in", KeyedFeatures(f"{tmp_path}/job", ["device_txn_24h", "cust_txn_total"])
    for part in ([row(i, i * 0.1, "a") for i in range(9)], [row(20, 50, "b")], [row(21, 50.5, "b")], [row(30, 1, "a"), row(31, 51, "a")]):
        delivered(spark, part, path)
    q = run(spark, job, path)
    assert dropped_late(q) == 1
    assert {r["entity"] for r in job.state(spark).filter("kind = 'device'").collect()} == {"d20", "d21", "d31"}
    assert {r["txn_id"]: r["cust_txn_total"] for r in job.results(spark).filter("txn_id > 8").collect()} == {20: 0.0, 21: 1.0, 31: 9.0}


def test_questions_name_each_part_once(spark):
    rows = spark.createDataFrame([(1, T0, "c0", 2.0, "m0", "u0", None, 1)], SCHEMA).selectExpr("*", "'u0' AS self_account")
    busy = spark.createDataFrame([("account", "u0", 3)], "kind STRING, entity STRING, parts INT")
    got = questions(rows, ENTITIES, busy).collect()
    account = [r for r in got if r["kind"] == "account"]
    assert sorted((r["role"], r["part"]) for r in account) == [(x, p) for x in ("benef", "sender") for p in range(3)]
    assert sum(r["tells"] for r in account) == 1
    assert {r["kind"] for r in got} == {"account", "customer", "dispute", "merchant"}


def test_merging_answers_without_an_entity_gives_defaults(spark):
    cols = "txn_id LONG, ts TIMESTAMP, ts_us LONG, role STRING, n_1h LONG, last_us LONG, seen BOOLEAN"
    got = merged_answers(spark.createDataFrame([(1, T0, 5, "merchant", 2, None, None)], cols), ["merchant_txn_1h", "cust_txn_1h", "secs_since_last_txn", "is_new_merchant"]).first()
    assert (got["merchant_txn_1h"], got["cust_txn_1h"], got["secs_since_last_txn"], got["is_new_merchant"]) == (2.0, 0.0, 999999.0, 0.0)


def test_many_entities_of_a_bucket_are_answered_as_one_by_one(spark, tmp_path):
    """One bucket and one for each hash give the same; distinct payers are counted apart over a moving span."""
    rng = random.Random(4)
    rows = payments(rng, 0, 80, T0, 50)
    got = {}
    for buckets in (1, 64):
        path, job = f"{tmp_path}/in{buckets}", KeyedFeatures(f"{tmp_path}/job{buckets}", list(FEATURES), buckets=buckets)
        for part in (rows[:40], rows[40:]):
            delivered(spark, part, path)
        run(spark, job, path)
        got[buckets] = {r["txn_id"]: r.asDict() for r in job.results(spark).collect()}
    assert got[1] == got[64] and len(got[1]) == 80
    for i, r in enumerate(rows):
        seen = {x[2] for x in rows[:i] if x[5] is not None and x[5] == r[5] and r[1] - dt.timedelta(days=1) <= x[1] < r[1]}
        assert got[1][r[0]]["benef_distinct_payers_24h"] == len(seen), r


def test_a_slice_is_delivered_as_one_micro_batch_however_few_its_rows(spark, tmp_path):
    from ledgerscope.queries.stream_queries import FILES, deliver

    for n in (0, 1, 50):
        deliver(spark.range(n).coalesce(1), f"{tmp_path}/in")
    assert len(spark.read.parquet(f"{tmp_path}/in").inputFiles()) == 3 * FILES
    assert spark.read.parquet(f"{tmp_path}/in").count() == 51
