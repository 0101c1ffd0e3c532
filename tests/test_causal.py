"""Histories against a slow row-by-row walk, with and without sliced keys."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerscope.operators.causal import Running, Trailing, causal, next_after
from ledgerscope.operators.firsts import first_seen, linear_percentile
from ledgerscope.operators.hot import hot_slices

HOUR = 3_600_000_000
SPAN = 3 * HOUR


def make_rows(n=260, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}"
        ts = rng.randrange(0, 400) * HOUR // 4
        value = None if rng.random() < 0.2 else f"v{rng.randrange(12)}"
        rows.append((i, key, ts, float(rng.randrange(1, 90)), value))
    # A payment exactly one span earlier counts; one microsecond older does not.
    rows += [(9001, "edge", 10 * HOUR, 1.0, "a"), (9002, "edge", 10 * HOUR + SPAN, 2.0, "a"),
             (9003, "edge", 10 * HOUR + SPAN + 1, 3.0, "b"),
             (9004, "tie", HOUR, 5.0, "a"), (9005, "tie", HOUR, 6.0, "a")]
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id LONG, key STRING, ts LONG, amount DOUBLE, value STRING").repartition(5)


def past(row):
    return [o for o in ROWS if o[1] == row[1] and o[2] < row[2]]


@pytest.mark.parametrize("limit", [1_000_000, 7, 1])
def test_running_and_trailing(frame, limit):
    one = F.lit(1).cast("long")
    out = causal(
        frame, ["key"], "ts",
        [Running("n", one), Running("total", F.col("amount")), Running("low", F.col("amount"), "min"),
         Running("last", F.struct("ts", "id", "amount"), "max"), Running("m", F.log1p("amount"), "moments")],
        [Trailing("n3", one, SPAN), Trailing("a3", F.col("amount").cast("long"), SPAN), Trailing("a9", F.col("amount").cast("long"), 3 * SPAN)],
        limit=limit,
    ).collect()
    assert len(out) == len(ROWS)
    by_id = {r["id"]: r for r in out}
    for row in ROWS:
        got, before = by_id[row[0]], past(row)
        near = [o for o in before if o[2] >= row[2] - SPAN]
        wide = [o for o in before if o[2] >= row[2] - 3 * SPAN]
        assert got["n"] == len(before) and got["n3"] == len(near)
        assert got["total"] == pytest.approx(sum(o[3] for o in before))
        assert got["a3"] == sum(o[3] for o in near) and got["a9"] == sum(o[3] for o in wide)
        assert got["low"] == (min(o[3] for o in before) if before else None)
        want_last = max(((o[2], o[0]) for o in before), default=None)
        assert (None if got["last"] is None else (got["last"]["ts"], got["last"]["id"])) == want_last
        logs = [math.log1p(o[3]) for o in before]
        assert got["m_n"] == len(logs)
        if logs:
            assert got["m_mean"] == pytest.approx(statistics.fmean(logs), abs=1e-9)
            assert got["m_m2"] == pytest.approx(statistics.pvariance(logs) * len(logs), abs=1e-7)


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_collapsed_timeline(frame, limit):
    line = causal(
        frame.select("key", "ts", "amount"), ["key"], "ts", [Running("n", F.lit(1).cast("long"))],
        [Trailing("n3", F.lit(1).cast("long"), SPAN)], limit=limit, collapse=True).collect()
    assert len(line) == len({(r[1], r[2]) for r in ROWS})
    for r in line:
        before = [o for o in ROWS if o[1] == r["key"] and o[2] < r["ts"]]
        assert r["n"] == len(before) and r["n3"] == len([o for o in before if o[2] >= r["ts"] - SPAN])


@pytest.mark.parametrize("limit", [1_000_000, 7])
def test_next_after(frame, limit):
    for r in next_after(frame.select("id", "key", "ts"), ["key"], "ts", "nxt", limit=limit).collect():
        later = [o[2] for o in ROWS if o[1] == r["key"] and o[2] > r["ts"]]
        assert r["nxt"] == (min(later) if later else None)


@pytest.mark.parametrize("limit", [1_000_000, 9, 2])
def test_first_seen_and_recent(frame, limit):
    hot = hot_slices(frame.select("key", "ts"), ["key"], "ts", limit)
    assert (hot is None) == (limit > len(ROWS))
    out = first_seen(frame, ["key"], "ts", "id", {"v": "value"}, recent=("recent", "amount", 60), hot=hot)
    out = out.withColumn("p95", linear_percentile(F.sort_array("recent"), 0.95)).collect()
    assert len(out) == len(ROWS)
    first = {}
    for r in sorted(ROWS, key=lambda o: (o[2], o[0])):
        first.setdefault((r[1], r[4]), r[0])
    for r in out:
        before = sorted((o for o in ROWS if o[1] == r["key"] and (o[2], o[0]) < (r["ts"], r["id"])), key=lambda o: (o[2], o[0]))
        known = {o[4] for o in ROWS if o[1] == r["key"] and o[2] < r["ts"]}
        assert r["v_new"] == int(r["value"] is not None and r["value"] not in known)
        assert r["v_first"] == int(r["value"] is not None and first[(r["key"], r["value"])] == r["id"])
        assert list(r["recent"]) == [o[3] for o in before][-60:]
        vals = sorted(r["recent"])
        if vals:
            at = 0.95 * (len(vals) - 1)
            lo = math.floor(at)
            hi = min(lo + 1, len(vals) - 1)
            assert r["p95"] == pytest.approx(vals[lo] + (vals[hi] - vals[lo]) * (at - lo))
        else:
            assert r["p95"] is None


def test_slices_stay_within_the_limit(frame):
    from ledgerscope.operators.hot import SLICE, with_slice

    hot = hot_slices(frame, ["key"], "ts", 20, grain=HOUR)
    sizes = with_slice(frame, hot, ["key"], "ts").groupBy("key", SLICE).count().collect()
    assert max(r["count"] for r in sizes) <= 20
