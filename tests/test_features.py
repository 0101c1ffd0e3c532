"""The feature row: sliced keys change nothing, the past is never rewritten, defaults hold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscope.constants import FORBIDDEN_FEATURES
from ledgerscope.operators import quality, ranks
from ledgerscope.operators.features import FEATURE_NAMES, features
from ledgerscope.sources import tables as T


@pytest.fixture(scope="module")
def inputs(spark, sf_dir):
    ledger = T.ledger(spark, sf_dir).cache()
    return ledger, T.customers(spark, sf_dir), T.merchants(spark, sf_dir), T.episodes(spark, sf_dir)


def test_there_are_110_features_and_none_is_forbidden():
    assert len(FEATURE_NAMES) == len(set(FEATURE_NAMES)) == 110
    assert not FORBIDDEN_FEATURES & set(FEATURE_NAMES)
    with pytest.raises(ValueError):
        quality.assert_no_leakage(["amount", "vector_id"])


def test_sliced_keys_give_the_same_features(inputs):
    whole = {r["txn_id"]: r for r in features(*inputs).collect()}
    sliced = features(*inputs, limit=25).collect()
    assert len(sliced) == len(whole)
    for r in sliced:
        for c in FEATURE_NAMES:
            a, b = whole[r["txn_id"]][c], r[c]
            assert (a is None) == (b is None), c
            assert a is None or a == pytest.approx(b, rel=1e-9, abs=1e-7), (c, r["txn_id"])


def test_later_rows_do_not_change_earlier_features(inputs):
    ledger = inputs[0]
    cut = ranks.at_or_after(ledger.withColumn("ts_us", F.unix_micros("ts")), int(ledger.count() * 0.6))
    early = ledger.withColumn("ts_us", F.unix_micros("ts")).filter(~cut).drop("ts_us")
    names = ["amount_to_p95", "cust_amt_7d", "is_new_merchant", "device_customer_count", "merchant_repeat_rate",
             "benef_distinct_payers_24h", "sender_passthrough_ratio", "mandate_drawdown_ratio"]
    gap = quality.causality_gap(features(*inputs, columns=names), features(early, *inputs[1:], columns=names), names).first()
    assert gap["rows"] == early.count()
    assert all(gap[c] <= 1e-9 for c in names)


def test_a_first_payment_with_nothing_else_gets_every_default(spark):
    row = spark.createDataFrame(
        [("t1", dt.datetime(2024, 1, 6, 3, 0), "c1", 50.0, "", None)],
        "txn_id STRING, ts TIMESTAMP, customer_id STRING, amount DOUBLE, merchant_id STRING, session_duration_s DOUBLE")
    got = features(row).first().asDict()
    assert got["secs_since_last_txn"] == got["benef_dwell_secs"] == got["sender_dwell_secs"] == 999_999.0
    assert got["amount_to_p95"] == got["amount_to_merchant_mean"] == 1.0
    assert got["is_new_merchant"] == 0.0 and got["is_new_city"] == 1.0 and got["is_new_category"] == 1.0
    assert got["session_duration_s"] is None and got["session_ratio_customer"] is None
    assert got["customer_balance"] == 1.0 and got["device_sim_count"] == 1.0 and got["mandate_intent_match"] == 1.0
    assert got["is_night"] == 1.0 and got["is_weekend"] == 1.0 and got["day_of_week"] == 5.0
    assert features(row, weekday_mode="epoch_mod7").first()["day_of_week"] == 2.0


def test_money_relayed_through_accounts(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    rows = [("a", at(0), "A", 100.0, "accB"), ("b", at(10), "C", 60.0, "accB"), ("c", at(20), "C", 5.0, "accB"),
            ("d", at(30), "B", 90.0, "accD"), ("e", at(40), "A", 10.0, "accB")]
    ledger = spark.createDataFrame(rows, "txn_id STRING, ts TIMESTAMP, customer_id STRING, amount DOUBLE, beneficiary_id STRING")
    people = spark.createDataFrame([("A", "accA"), ("B", "accB"), ("C", "accC")], "customer_id STRING, self_account STRING").withColumns(
        {"lat": F.lit(0.0), "lon": F.lit(0.0), "country": F.lit("IN")})
    got = {r["txn_id"]: r for r in features(ledger, people).collect()}
    assert got["d"]["sender_in_24h"] == 165.0 and got["d"]["sender_dwell_secs"] == 10.0
    assert got["d"]["sender_passthrough_ratio"] == pytest.approx(90 / 165)
    assert got["e"]["benef_distinct_payers_24h"] == 2.0 and got["e"]["benef_in_count_24h"] == 3.0
    assert got["e"]["benef_passthrough_ratio"] == pytest.approx(90 / 165) and got["e"]["benef_out_count_1h"] == 1.0
    assert got["c"]["benef_distinct_payers_24h"] == 2.0


def test_payments_at_one_instant_do_not_see_each_other(spark):
    ts = dt.datetime(2024, 1, 1)
    rows = [(i, ts, "A", 10.0 + i, "m1", "acc") for i in range(3)] + [(9, ts + dt.timedelta(hours=1), "A", 1.0, "m1", "acc")]
    ledger = spark.createDataFrame(rows, "txn_id LONG, ts TIMESTAMP, customer_id STRING, amount DOUBLE, merchant_id STRING, beneficiary_id STRING")
    got = {r["txn_id"]: r for r in features(ledger).collect()}
    for i in range(3):
        assert got[i]["cust_txn_1h"] == 0.0 and got[i]["is_new_merchant"] == 1.0 and got[i]["benef_in_count_1h"] == 0.0
    # Exactly one hour later all three still count.
    assert got[9]["cust_txn_1h"] == 3.0 and got[9]["benef_in_count_1h"] == 3.0 and got[9]["merchant_distinct_customers"] == 1.0
