"""Disputes on two clocks, greedy pairs in rounds, writers of days and of nested lines, declared categories."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.ml.model import CATEGORICAL, _assemble
from ledgerscope.operators import catalogue as CAT
from ledgerscope.operators.causal import seen_since
from ledgerscope.sources import files


@pytest.mark.parametrize("limit", [100_000, 5])
def test_a_dispute_counts_from_when_it_was_filed(spark, limit):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        ts = rng.randrange(1000)
        rows.append((i, rng.choice("aab"), ts, rng.choice([None, ts, ts + rng.randrange(200), ts - 5, ts + 900]), rng.randrange(3)))
    df = spark.createDataFrame(rows, "id long, who string, t long, filed long, n long")
    got = {r["id"]: r["seen"] for r in seen_since(df, ["who"], "t", "filed", "seen", F.col("n"), 300, limit=limit).collect()}
    want = {i: sum(n for _, w, s, f, n in rows if w == who and s < t and s >= t - 300 and f is not None and f < t) for i, who, t, _, _ in rows}
    assert got == want


def walk(pairs, k, cap):
    used, picked = {}, []
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if len(picked) < k and used.get(a, 0) < cap and used.get(b, 0) < cap:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            picked.append((a, b, len(picked) + 1))
    return picked


@pytest.mark.parametrize(("k", "cap", "levels"), [(5, 2, 4), (60, 2, 1000), (60, 1, 2), (3, 3, 1)])
def test_rounds_pick_what_the_walk_picks(spark, k, cap, levels):
    rng = random.Random(k + cap)
    pairs = list({(f"p{a}", f"p{b}") for a, b in (rng.sample(range(25), 2) for _ in range(200))})
    pairs = [(a, b, rng.randrange(levels) / 8) for a, b in pairs]
    df = spark.createDataFrame([((a,), (b,), s, 0.0) for a, b, s in pairs], "a struct<id string>, b struct<id string>, pre_score double, bonus double")
    got = sorted((r["a_id"], r["b_id"], r["pick"]) for r in CAT.select_pairs(df, k, cap).collect())
    assert got == sorted(walk(pairs, k, cap))


def test_composites_name_the_hand_off_and_the_links(spark):
    rows = CAT.compose_pairs(CAT.sample_catalogue(spark), 3).collect()
    assert rows and all(r["kill_chain"][2].startswith("[hand-off] ") and len(r["kill_chain"]) == 5 for r in rows)
    assert all(r["observable_signals"][-2:] == CAT.LINKS for r in rows)


def test_days_become_few_files_of_bounded_size(spark, tmp_path):
    hours = F.when(F.col("id") < 900, 5).otherwise(F.col("id") % 96)
    df = spark.range(1000).select("id", F.timestamp_micros(F.lit(1_704_067_200_000_000) + hours * 3_600_000_000).alias("ts"))
    df = df.union(spark.sql("SELECT 5000L, CAST(NULL AS TIMESTAMP)"))
    files.write_columnar(df, f"{tmp_path}/d", rows_per_file=100)
    per_file = spark.read.parquet(f"{tmp_path}/d").groupBy("dt", F.input_file_name().alias("f")).count().collect()
    assert sum(r["count"] for r in per_file) == 1001 and max(r["count"] for r in per_file) <= 100
    days = {}
    for r in per_file:
        days.setdefault(str(r["dt"]), []).append(r["count"])
    assert len(days) == 5 and len(days["2024-01-01"]) >= 10 and all(len(v) == 1 for d, v in days.items() if d != "2024-01-01")
    files.write_columnar(df.limit(0), f"{tmp_path}/none")


def test_nested_lines_longer_than_a_batch(spark, tmp_path):
    rows = [("x", "k", i, "u", f"said {i} \"q\"\n") for i in range(700)] + [("y", None, 2, None, "b"), ("y", None, 1, "s", None), (None, "z", 1, "s", "é")]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id string, kind string, turn int, speaker string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        files.write_nested(df, f"{tmp_path}/n", ["id"], ["turn"], ["speaker", "text"], "turns")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["id"]: r for r in (json.loads(line["value"]) for line in spark.read.text(f"{tmp_path}/n").collect())}
    assert set(got) == {"x", "y", None} and got["y"] == {"id": "y", "kind": None, "turns": [{"speaker": "s", "text": None}, {"speaker": None, "text": "b"}]}
    assert [t["text"] for t in got["x"]["turns"]] == [f"said {i} \"q\"\n" for i in range(700)] and got[None]["turns"] == [{"speaker": "s", "text": "é"}]


def test_unknown_categories_are_a_level_of_their_own(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (3.0,), (99.0,), (None,)], "cat_rail double")
    out = _assemble(df, ["cat_rail"], {"cat_rail": 0.0})
    assert [r["features"][0] for r in out.select("features").collect()] == [0.0, 1.0, 4.0, float(len(CATEGORICAL["cat_rail"])), 1.0]
    attrs = out.schema["features"].metadata["ml_attr"]["attrs"]
    assert attrs["nominal"][0]["vals"][0] == "none"
