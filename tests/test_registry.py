"""Features of a user's own: order of steps, shared passes, refusals, values against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.features import Registry

HOUR = 3_600_000_000


def _registry() -> Registry:
    own = Registry()
    # Declared before what it needs.
    own.history("big_before", "customer_id", "count", ["ratio"])(lambda ratio: ratio > 1.0)
    own.row("ratio", ["ledger.amount", "mean_2h"], default=0.0)(lambda amount, mean: amount / mean)
    own.history("mean_2h", "customer_id", "mean", ["ledger.amount"], 2 * HOUR, default=None)(lambda amount: amount)
    own.history("spent", "merchant_id", "sum", ["ledger.amount"])(lambda amount: amount)
    own.history("least", "merchant_id", "min", ["ledger.amount"], default=None)(lambda amount: amount)
    return own


def test_steps_follow_inputs_and_share_entities():
    builtin, steps = _registry().steps(["big_before", "spent", "least", "is_night"])
    assert builtin == ["is_night"]
    assert [(s.entity, {f.name for f in s.features}) for s in steps] == [
        ("merchant_id", {"spent", "least"}), ("customer_id", {"mean_2h"}), (None, {"ratio"}), ("customer_id", {"big_before"})]
    # What nobody asks for is not computed.
    assert _registry().steps(["spent"])[1][0].features[0].name == "spent" and len(_registry().steps(["spent"])[1]) == 1


def test_histories_of_an_entity_wait_for_each_other():
    own = Registry()
    own.history("a", "customer_id", "count")(lambda: F.lit(True))
    own.history("m", "merchant_id", "count")(lambda: F.lit(True))
    own.row("r", ["m"])(lambda m: m + 1)
    own.history("b", "customer_id", "sum", ["r"])(lambda r: r)
    assert [s.entity for s in own.steps(["a", "b"])[1]] == ["merchant_id", None, "customer_id"]


def test_refusals(spark):
    own = _registry()
    with pytest.raises(ValueError, match="already"):
        own.row("amount", [])(lambda: F.lit(1))
    with pytest.raises(ValueError, match="already"):
        own.row("ratio", [])(lambda: F.lit(1))
    with pytest.raises(ValueError, match="label"):
        own.row("cheat", ["ledger.is_fraud"])(lambda y: y)
    with pytest.raises(ValueError, match="no such history"):
        own.history("x", "customer_id", "max", ["ledger.amount"], HOUR)
    own.row("p", ["q"])(lambda q: q)
    own.row("q", ["p"])(lambda p: p)
    with pytest.raises(ValueError, match="each other"):
        own.steps(["p"])
    own.row("lost", ["nowhere"])(lambda x: x)
    with pytest.raises(ValueError, match="not a feature"):
        own.steps(["lost"])


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_values_against_a_plain_walk(spark, limit):
    rnd = random.Random(5)
    # Nine of ten payments are one customer's; ties, missing entities and missing amounts are there.
    rows = [(i, f"2026-01-{1 + i // 48:02d} {(i // 2) % 24:02d}:{rnd.choice((0, 0, 30)):02d}:00",
             None if i % 31 == 0 else "hot" if rnd.random() < 0.9 else f"c{i % 3}", None if i % 7 == 0 else f"m{i % 2}",
             None if i % 23 == 0 else float(rnd.randrange(1, 900))) for i in range(240)]
    ledger = spark.createDataFrame(rows, "txn_id long, ts string, customer_id string, merchant_id string, amount double")
    ledger = ledger.withColumn("ts", F.to_timestamp("ts"))
    got = {r["txn_id"]: r for r in _registry().table(["big_before", "ratio", "spent", "least"], ledger, limit=limit).collect()}
    at = {r["txn_id"]: r["us"] for r in ledger.select("txn_id", F.unix_micros("ts").alias("us")).collect()}
    ratio = {}
    for i, _, who, _, amount in rows:
        seen = [r[4] for r in rows if who is not None and r[2] == who and r[4] is not None and at[i] - 2 * HOUR <= at[r[0]] < at[i]]
        ratio[i] = amount / (sum(seen) / len(seen)) if seen and amount is not None else 0.0
    assert len(got) == len(rows)
    for i, _, who, shop, _ in rows:
        past = [r for r in rows if at[r[0]] < at[i]]
        spent = [r[4] for r in past if shop is not None and r[3] == shop and r[4] is not None]
        assert got[i]["ratio"] == pytest.approx(ratio[i])
        assert got[i]["spent"] == pytest.approx(sum(spent))
        assert got[i]["least"] == (min(spent) if spent else None)
        assert got[i]["big_before"] == sum(who is not None and r[2] == who and ratio[r[0]] > 1.0 for r in past)


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], "txn_id long, ts timestamp, customer_id string, merchant_id string, amount double")
    assert _registry().table(["big_before", "spent"], empty).collect() == []
