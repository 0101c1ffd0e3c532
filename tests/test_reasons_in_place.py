"""Reasons of the rule score without copies of rows, and medians counted in arrays."""

from __future__ import annotations

import statistics

from ledgerscope.operators import decisions, reports, requests
from ledgerscope.operators.explain import explain
from ledgerscope.queries import other_queries as Q


def table(spark):
    """Rows that fire rules or none, some ids twice with other values, one id missing twice."""
    quiet = {c: 1.0 for c in Q.X_ALL} | {
        "benef_dwell_secs": 1e6, "sender_dwell_secs": 1e6, "benef_age_days": 900.0, "customer_account_age_days": 900.0,
        "instrument_age_days": 900.0, "merchant_age_days": 900.0, "is_agentic": 0.0, "amount": 500.0, "typing_variance_ratio": 1.0,
        "screen_share": 0.0, "call_active": 0.0, "is_new_device": 0.0, "amount_to_p95": 0.5, "form_corrections": 2.0}
    mule = quiet | {"benef_dwell_secs": 10.0, "benef_passthrough_ratio": 0.9, "benef_age_days": 2.0}
    both = mule | {"typing_variance_ratio": 0.1, "form_corrections": 0.0}
    none = dict.fromkeys(Q.X_ALL)
    rows = [*[(i, quiet) for i in range(9)], (20, mule), (20, quiet), (21, both), (21, both), (None, mule), (None, quiet), (22, none)]
    return spark.createDataFrame([(i, *[r[c] for c in Q.X_ALL]) for i, r in rows], "txn_id LONG, " + ", ".join(f"{c} DOUBLE" for c in Q.X_ALL))


def test_reasons_equal_those_of_copied_rows_and_no_row_is_copied(spark):
    df = table(spark)
    meds = requests.median_row(reports.column_medians(df, Q.X_ALL), Q.X_ALL)
    copied = explain(df, lambda d: decisions.RuleScorer()(d), meds, Q.X_ALL)
    in_place = explain(df, decisions.RuleScorer(), meds, Q.X_ALL)
    told = lambda d: sorted(map(str, d.select("txn_id", "base_score", "reasons").collect()))
    assert told(in_place) == told(copied)
    assert {r["txn_id"]: len(r["reasons"]) > 0 for r in in_place.collect()}.items() >= {20: True, 21: True, None: True, 22: False, 3: False}.items()
    plan = Q.rule_reasons(df, Q.X_ALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_medians_are_exact_also_where_values_are_missing_endless_or_adjacent(spark):
    tiny = 5e-324
    columns = {
        "a": [3.0, None, float("nan"), 1.0, float("inf"), 2.5, -7.0], "b": [tiny, 0.0, tiny, tiny, 0.0, 0.0, None],
        "c": [1.7e308, -1.7e308, 1.6e308, 1.0, 2.0, 3.0, -1.0], "d": [None] * 7, "e": [float(i * i) for i in range(7)]}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} DOUBLE" for c in columns)).repartition(3)
    got = {r["feature"]: r["median"] for r in reports.column_medians(df, list(columns)).collect()}
    want = {c: statistics.median(x for x in v if x is not None and x == x and abs(x) < float("inf")) for c, v in columns.items() if c != "d"}
    assert got == want
    # One row a task, column and bin, made in arrays of the task's rows.
    assert len(reports._binned(df.select("e"), {"e": (0.0, 36.0)})) == 7
