"""Learned channels, reasons, the batch job and streams."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerscope.ml import text
from ledgerscope.ml.isolation import fit_isolation
from ledgerscope.ml.model import calibrate, fit
from ledgerscope.operators.explain import explain
from ledgerscope.operators.features import FEATURE_NAMES, features
from ledgerscope.operators.features.texts import FEATURE_TEXT
from ledgerscope.streaming import OnlineFeatures


def test_every_feature_has_a_text_of_its_own():
    assert list(FEATURE_TEXT) == FEATURE_NAMES and len(set(FEATURE_TEXT.values())) == len(FEATURE_NAMES)


def test_isolation_singles_out_a_planted_outlier(spark):
    df = spark.range(600).select(
        F.col("id").alias("txn_id"), (F.col("id") % 17 / 17.0).alias("a"), (F.col("id") % 13 / 13.0).alias("b"))
    df = df.unionByName(spark.createDataFrame([(600, 9.0, -7.0)], df.schema))
    model = fit_isolation(df, ["a", "b"], {"a": 0.5, "b": 0.5}, trees=60, max_samples=601)
    got = {r["txn_id"]: r["novelty"] for r in model.transform(df).collect()}
    assert max(got, key=got.get) == 600 and got[600] == pytest.approx(600 / 601, abs=0.01)
    blank = spark.createDataFrame([(1, 0.5, 0.5), (2, None, float("nan"))], "txn_id LONG, a DOUBLE, b DOUBLE")
    pair = {r["txn_id"]: r["novelty"] for r in model.transform(blank).collect()}
    assert pair[1] == pair[2]


def test_model_is_bounded_and_separates_classes(spark):
    df = spark.range(3000).select(
        F.col("id").alias("txn_id"), F.when(F.col("id") % 10 < 5, "train").when(F.col("id") % 10 < 7, "calib").otherwise("test").alias("split"),
        (F.col("id") % 7 == 0).cast("int").alias("y_observed"), F.lit(None).cast("string").alias("vector_id"))
    from ledgerscope.plans.batch import _rule_inputs

    df = df.withColumns({c: F.lit(999.0) for c in _rule_inputs()})
    df = df.withColumns({"log_amount": F.col("y_observed") * 2.0 + F.col("txn_id") % 11 / 11.0,
                         "session_duration_s": F.when(F.col("txn_id") % 3 > 0, F.col("txn_id") % 5 * 1.0),
                         **{c: F.lit(0.0) for c in ("screen_share", "call_active", "is_new_device", "is_agentic", "cust_prior_disputes_90d", "amount_to_p95", "benef_distinct_payers_24h", "device_customer_count", "merchant_distinct_customers")}})
    model = fit(df, ["log_amount", "session_duration_s"], max_iter=5, isolation={"trees": 10, "max_samples": 64})
    out = model.transform(df.filter("split = 'test'"))
    got = out.agg(F.min("score"), F.max("score"), F.avg(F.when(F.col("y_observed") == 1, F.col("score"))),
                  F.avg(F.when(F.col("y_observed") == 0, F.col("score")))).first()
    assert 0 <= got[0] and got[1] <= 1 and got[2] > got[3] + 0.2


def test_calibration_never_falls(spark):
    df = spark.range(500).select((F.col("id") / 500).alias("p_raw"), (F.pmod(F.xxhash64("id"), F.lit(500)) < F.col("id")).cast("int").alias("y"))
    got = [r["p_cal"] for r in calibrate(df, "y").transform(df).orderBy("p_raw").collect()]
    assert all(a <= b + 1e-12 for a, b in zip(got, got[1:]))


def test_words_pairs_and_turns_agree(spark):
    turns = spark.createDataFrame([(1, 0, "user: Où es-tu"), (1, 1, "agent: ici a")], "episode_id LONG, turn LONG, text STRING")
    whole = spark.createDataFrame([(1, "user: Où es-tu\nagent: ici a")], "episode_id LONG, text STRING")
    a = {(r["term"], r["tf"]) for r in text.term_counts(turns).collect()}
    b = {(r["term"], r["tf"]) for r in text.term_counts(whole).collect()}
    assert a == b and ("ou", 1) in a and ("tu agent", 1) in a and not any(t == "a" for t, _ in a)


def test_text_score_needs_both_classes(spark):
    few = spark.createDataFrame([(i, "pay now", 1) for i in range(30)], "episode_id LONG, text STRING, is_fraud INT")
    none = text.fit_text(few)
    assert none.lr is None and none.reason and {r["coercion_score"] for r in none.score(few).collect()} == {None}
    both = few.unionByName(spark.createDataFrame([(100 + i, "see you at lunch", 0) for i in range(30)], few.schema))
    model = text.fit_text(both)
    got = {r["episode_id"]: r["coercion_score"] for r in model.score(both).collect()}
    assert got[0] > 0.8 and got[100] < 0.2


def test_reasons_rank_the_feature_that_drove_the_score(spark):
    df = spark.createDataFrame([(1, 9.0, 1.0), (2, 0.0, 0.0)], "txn_id LONG, amount_to_p95 DOUBLE, is_new_device DOUBLE")
    meds = spark.createDataFrame([(0.0, 0.0)], "amount_to_p95 DOUBLE, is_new_device DOUBLE")
    score = lambda d: d.withColumn("score", F.least(0.05 + 0.08 * F.col("amount_to_p95") + 0.1 * F.col("is_new_device"), F.lit(0.99)))
    got = {r["txn_id"]: r for r in explain(df, score, meds).collect()}
    assert [x["feature"] for x in got[1]["reasons"]] == ["amount_to_p95", "is_new_device"]
    assert got[1]["reasons"][0]["text"] == FEATURE_TEXT["amount_to_p95"] and got[2]["reasons"] == []


def test_three_micro_batches_equal_one_batch_and_late_rows_are_counted(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), f"c{i % 3}", 10.0 + i, f"m{i % 2}", f"acc{i % 2}") for i in range(60)]
    schema = "txn_id LONG, ts TIMESTAMP, customer_id STRING, amount DOUBLE, merchant_id STRING, beneficiary_id STRING"
    names = ["cust_txn_1h", "cust_amt_24h", "amount_z_customer", "is_new_merchant", "merchant_distinct_customers", "benef_distinct_payers_24h"]
    job = OnlineFeatures(str(tmp_path), names, delay_us=3_600_000_000)
    for i in range(3):
        part = rows[20 * i: 20 * i + 20]
        if i == 2:
            part = part + [(900, t0, "c1", 1.0, "m1", "acc1"), rows[39]]
        job.process(spark.createDataFrame(part, schema), i)
    job.process(spark.createDataFrame(rows[40:], schema), 2)  # a batch run again
    job.process(spark.createDataFrame(rows[40:] + [(900, t0, "c1", 1.0, "m1", "acc1")], schema), 2)
    got = {r["txn_id"]: r for r in job.results(spark).collect()}
    want = {r["txn_id"]: r for r in features(spark.createDataFrame(rows, schema), columns=names).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        for c in names:
            assert got[k][c] == pytest.approx(w[c]), (k, c)
    assert job.results(spark, "late").agg(F.sum("late")).first()[0] == 1


def test_the_batch_job_end_to_end(spark, sf_dir):
    from ledgerscope.plans.batch import explain_rows, feedback_round, run
    from ledgerscope.queries.model_queries import MODEL_FEATURES, SMALL
    from ledgerscope.sources import tables as T

    result = run(T.ledger(spark, sf_dir), T.customers(spark, sf_dir), T.merchants(spark, sf_dir),
                 T.episode_stats(spark, sf_dir), holdout=("v5",), columns=MODEL_FEATURES, turns=T.turns(spark, sf_dir), **SMALL)
    point = result.reports["operating_point"].first()
    test = result.scored.filter("split = 'test'").count()
    assert point["tp"] + point["fp"] + point["fn"] + point["tn"] == test == result.reports["summary"].first()["n_test"]
    assert {r["family"] for r in result.reports["holdout"].collect()} == {"v5", "__known_families__"}
    told = explain_rows(result.table.filter("split = 'test'").limit(20), result).collect()
    assert len(told) == 20 and {r["decision"] for r in told} <= {"approve", "review", "step_up", "decline"}
    attacks = result.table.filter("split = 'test' AND y = 1").withColumn("group_id", F.col("strain_id"))
    _, gains = feedback_round(result, attacks, MODEL_FEATURES, 0.5, max_iter=3, max_depth=3)
    rows = gains.collect()
    assert rows and all(0 <= r["evasion_pre"] <= 1 and 0 <= r["evasion_post"] <= 1 for r in rows)


def test_retention_is_refused_with_lifetime_features(tmp_path):
    with pytest.raises(ValueError, match="cust_txn_total"):
        OnlineFeatures(str(tmp_path), ["cust_txn_total", "cust_txn_1h"], retention_us=1)
    OnlineFeatures(str(tmp_path), ["cust_txn_1h", "amount"], retention_us=1)


def test_text_vectors_hold_the_weights_of_the_terms_by_place(spark):
    texts = spark.createDataFrame(
        [(1, "alpha beta alpha gamma"), (1, "beta delta"), (2, "beta gamma alpha beta"), (3, "zeta"), (None, "alpha gamma"), (None, "alpha gamma")], "episode_id LONG, text STRING")
    counts = text.term_counts(texts)
    tf = {(r.episode_id, r.term): r.tf for r in counts.collect()}
    assert tf[1, "alpha"] == 2 and tf[1, "beta"] == 2 and tf[1, "beta delta"] == 1 and tf[None, "alpha gamma"] == 2 and (2, "delta") not in tf
    vocab = text.vocabulary(counts, 4).select("term", "idf", "idx")
    want = {}
    for r in text.weights(counts, vocab).collect():
        want[r.episode_id, r.idx] = want.get((r.episode_id, r.idx), 0.0) + r.w
    got = {(r.episode_id, i): w for r in text._placed(counts, vocab, "episode_id").collect() for i, w in zip(r.idx, r.w, strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {k for k, _ in got} == {1, 2}


def test_texts_travel_to_their_key_and_not_their_terms(spark):
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "episode_id LONG, text STRING")
    plan = text.term_counts(texts)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(episode_id#\d+L, \d+\)", plan), plan
