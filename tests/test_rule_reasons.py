"""Rows that fire any rule get reasons when all rule inputs are candidates."""

from __future__ import annotations

from ledgerscope.queries import ORACLES, QUERIES
from ledgerscope.queries import other_queries as Q


def test_all_rule_inputs_are_candidates_and_explain_mule_rows(spark):
    assert "x1_reason_codes_all_inputs" in QUERIES and "x1_reason_codes_all_inputs" in ORACLES
    assert set(Q.X_ALL) == Q._rule_inputs()
    quiet = {c: 1.0 for c in Q.X_ALL} | {
        "benef_dwell_secs": 1e6, "sender_dwell_secs": 1e6, "benef_age_days": 900.0, "customer_account_age_days": 900.0,
        "instrument_age_days": 900.0, "merchant_age_days": 900.0, "is_agentic": 0.0, "amount": 500.0, "typing_variance_ratio": 1.0,
        "screen_share": 0.0, "call_active": 0.0, "is_new_device": 0.0, "amount_to_p95": 0.5, "form_corrections": 2.0}
    mule = quiet | {"benef_dwell_secs": 10.0, "benef_passthrough_ratio": 0.9, "benef_age_days": 2.0}
    clone = quiet | {"typing_variance_ratio": 0.1, "form_corrections": 0.0}
    rows = [quiet] * 5 + [mule, clone]
    df = spark.createDataFrame([(i, *[r[c] for c in Q.X_ALL]) for i, r in enumerate(rows)], "txn_id LONG, " + ", ".join(f"{c} DOUBLE" for c in Q.X_ALL))
    got = {r["txn_id"]: r for r in Q.rule_reasons(df, Q.X_ALL).collect()}
    assert got[0]["base_score"] == 0 and got[0]["reasons"] == ""
    assert got[5]["base_score"] > 0.8 and "benef_dwell_secs" in got[5]["reasons"]
    assert got[6]["base_score"] > 0.7 and "typing_variance_ratio" in got[6]["reasons"]
