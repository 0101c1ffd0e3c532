"""Ordered ranges of bounded size: positions, running sums, quantiles, thresholds and percentiles whatever the bound."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators import curves, feedback, ranges, ranks


@pytest.fixture(params=[1_000_000, 40])
def bound(request, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", request.param)
    return request.param


def skewed(spark, n=1500):
    """Nine rows in ten at one instant and one score."""
    rng = random.Random(1)
    rows = [(i, 5 if rng.random() < 0.9 else rng.randrange(10**15), 0.5 if rng.random() < 0.9 else rng.random(), int(rng.random() < 0.2), float(rng.randrange(99))) for i in range(n)]
    return spark.createDataFrame(rows, "txn_id long, ts_us long, score double, y int, amount double"), rows


def test_no_range_is_larger_than_the_bound_even_on_one_value(spark):
    df, rows = skewed(spark)
    table, single = ranges.ranged(df, [F.asc("score"), F.asc("txn_id")], rows=100)
    assert not single
    cuts = table.groupBy(ranges.RANGE).agg(F.count("*").alias("n"), F.min(F.struct("score", "txn_id")).alias("lo"), F.max(F.struct("score", "txn_id")).alias("hi")).orderBy(ranges.RANGE).collect()
    assert len(cuts) >= 15 and max(c["n"] for c in cuts) <= 100
    assert all(tuple(a["hi"]) < tuple(b["lo"]) for a, b in zip(cuts, cuts[1:]))


def test_places_and_shuffled_numbers(spark, bound):
    df, rows = skewed(spark)
    one_instant = df.withColumn("ts_us", F.lit(7).cast("long"))
    for table, key in ((df, lambda r: (r[1], r[0])), (one_instant, lambda r: r[0])):
        got = {r["txn_id"]: r["place"] for r in ranks.place(table).collect()}
        assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=key))}
    some = {r["txn_id"]: r["i"] for r in ranks.shuffled_index(df, "i", 3).collect()}
    assert sorted(some.values()) == list(range(len(rows))) and some == {r["txn_id"]: r["i"] for r in ranks.shuffled_index(df, "i", 3).collect()}
    none = df.withColumn("ts_us", F.when(F.col("txn_id") > 9, F.col("ts_us")))
    assert {r["txn_id"] for r in ranks.place(none).filter("place <= 10").collect()} == set(range(10))


def test_running_sums_in_groups_and_both_directions(spark, bound):
    df, rows = skewed(spark, 400)
    df = df.withColumn("g", F.when(F.col("txn_id") % 3 > 0, F.col("txn_id") % 3))
    for down in (True, False):
        got = curves.cumulative(df, "score", {"pos": F.col("y").cast("long")}, ["g"], down).collect()
        for r in got:
            same = [x for x in rows if (x[0] % 3 or None) == r["g"] and (x[2] >= r["score"] if down else x[2] <= r["score"])]
            assert (r["cum_rows"], r["cum_pos"], r["rank"]) == (len(same), sum(x[3] for x in same), len({x[2] for x in same}))


def test_thresholds_and_quantiles(spark, bound):
    df, rows = skewed(spark, 600)
    for c in curves.cost_curve(df, qs=[0.0, 0.1, 0.5, 0.93, 0.97, 1.0]).collect():
        above = [r for r in rows if r[2] >= c["threshold"]]
        assert (c["tp"], c["tp"] + c["fp"]) == (sum(r[3] for r in above), len(above))
    scores = sorted(r[2] for r in rows)
    got = {r["q"]: r["value"] for r in curves.quantiles(df, "score", [0.25, 0.95]).collect()}
    for q, v in got.items():
        at = q * (len(scores) - 1)
        lo = int(at)
        assert v == pytest.approx(scores[lo] + (scores[min(lo + 1, len(scores) - 1)] - scores[lo]) * (at - lo))


def test_percentile_in_reference(spark, bound):
    df, rows = skewed(spark, 500)
    asks = df.select("txn_id", F.when(F.col("txn_id") % 7 > 0, F.col("score")).alias("p"), F.lit(1).alias("percentile_of"))
    asks = asks.union(asks.limit(3))
    got = curves.percentile_in_reference(asks, "p", df.filter("y = 0"), "score").collect()
    ref = [r[2] for r in rows if r[3] == 0]
    assert len(got) == 503
    for r in got:
        want = None if r["p"] is None else sum(x < r["p"] for x in ref) / len(ref)
        assert r["percentile"] == (want if want is None else pytest.approx(want))
    assert curves.percentile_in_reference(asks, "p", df.limit(0), "score").agg(F.max("percentile")).first()[0] == 0.0


def test_elite_of_tied_groups(spark, bound):
    groups = spark.createDataFrame([(i, 0.5 if i > 3 else None, float(i)) for i in range(404)], "group_id long, fitness double, aggression double")
    got = feedback.elite_centroid(groups, ["aggression"]).first()
    assert got["n"] == 100 and got["aggression"] == pytest.approx(sum(range(4, 104)) / 100)


def test_cost_optimum_needs_few_exchanges_and_no_array_filter(spark):
    df, _ = skewed(spark, 300)
    plan = curves.choose_threshold(curves.cost_curve(df))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") - text.count("BroadcastExchange ") <= 6
    assert "filter(grid" not in text
