"""Rules, curves, ranking, selection, quality and files on small hand-made frames."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerscope.functions import columns as C
from ledgerscope.operators import catalogue, curves, decisions, feedback, quality, ranks, reports
from ledgerscope.sources import files


def test_missing_telemetry_never_fires_a_rule(spark):
    df = spark.createDataFrame(
        [(1, None), (2, float("nan")), (3, 0.0), (4, 1.0)], "txn_id LONG, screen_share DOUBLE"
    ).withColumn("screen_share", C.observed("screen_share"))
    others = {c: 0.0 for c in _inputs() - {"screen_share"}} | {"is_new_beneficiary": 1.0, "amount_to_p95": 9.0, "amount": 999.0,
              "benef_age_days": 99.0, "instrument_age_days": 5.0, "benef_dwell_secs": 999999.0, "sender_dwell_secs": 999999.0}
    df = df.withColumns({c: F.lit(v) for c, v in others.items()})
    got = {r["txn_id"]: r for r in decisions.apply_rules(df).collect()}
    assert [got[i]["fired"] for i in (1, 2, 3)] == [[], [], []]
    assert got[4]["fired"] == ["R-COERCION-01"] and got[4]["rule_score"] == 0.88


def _inputs():
    from ledgerscope.plans.batch import _rule_inputs

    return _rule_inputs()


def test_rule_catalogue_has_fourteen_rules(spark):
    rows = decisions.rule_catalogue(spark).collect()
    assert len(rows) == 14 and all(0 < r["confidence"] < 1 for r in rows)


SCORED = [(i, s, y, a) for i, (s, y, a) in enumerate(
    [(0.9, 1, 10.0), (0.9, 0, 5.0), (0.8, 1, 7.0), (0.8, 0, 1.0), (0.8, 0, 2.0), (0.3, 1, 4.0), (0.3, 0, 3.0), (0.1, 0, 6.0)])]


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame(SCORED, "txn_id LONG, score DOUBLE, y INT, amount DOUBLE")


def test_auc_and_average_precision_with_ties(scored):
    got = curves.ranking_metrics(curves.score_curve(scored)).first()
    pos = [s for _, s, y, _ in SCORED if y == 1]
    neg = [s for _, s, y, _ in SCORED if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["roc_auc"] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s, _, _ in SCORED}, reverse=True):
        hit = [y for _, s, y, _ in SCORED if s >= t]
        ap += (sum(hit) / len(pos) - last) * (sum(hit) / len(hit))
        last = sum(hit) / len(pos)
    assert got["pr_auc"] == pytest.approx(ap)


def test_quantiles_interpolate_between_neighbours(scored):
    import numpy as np

    qs = [0.0, 0.25, 0.5, 0.93, 1.0]
    got = {r["q"]: r["value"] for r in curves.quantiles(scored, "amount", qs).collect()}
    for q in qs:
        assert got[q] == pytest.approx(float(np.quantile([a for *_, a in SCORED], q)))


def test_first_cheapest_threshold_wins(spark):
    curve = spark.createDataFrame([(0.9, 5.0), (0.7, 3.001), (0.8, 3.002)], "threshold DOUBLE, expected_cost DOUBLE")
    assert curves.choose_threshold(curve).first()["threshold"] == 0.7


def test_cost_curve_matches_a_plain_search(scored):
    rows = curves.cost_curve(scored, qs=[0.0, 0.4, 0.7, 0.9]).collect()
    for r in rows:
        hit = [(y, a) for _, s, y, a in SCORED if s >= r["threshold"]]
        missed = sum(a for _, s, y, a in SCORED if s < r["threshold"] and y == 1)
        fp = sum(1 for y, _ in hit if y == 0)
        assert r["fp"] == fp and r["tp"] == len(hit) - fp
        assert r["expected_cost"] == pytest.approx(missed * 0.72 + len(hit) * 55 + fp * 0.35 * 420)


def test_evenly_spaced_points(spark):
    import numpy as np

    for n, k in ((300, 160), (161, 160), (50, 160), (1000, 7)):
        got = [r["id"] for r in spark.range(n).filter(curves.evenly_spaced(F.col("id"), F.lit(n), k)).orderBy("id").collect()]
        want = sorted(set(np.linspace(0, n - 1, k).astype(int))) if n > k else list(range(n))
        assert got == [int(x) for x in want]


def test_nth_value_and_split_with_many_ties(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 5, 5, 7, 10**15])) for i in range(400)]
    df = spark.createDataFrame(rows, "txn_id LONG, ts_us LONG")
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    for n in (0, 100, 250, 399):
        assert ranks.nth_value(df, "ts_us", n)[0] == ordered[n][1]
    got = {r["txn_id"]: r["split"] for r in ranks.temporal_split(df).collect()}
    test_start = int(400 * 0.7)
    calib_start = int(test_start * 0.82)
    for i, (txn, _) in enumerate(ordered):
        assert got[txn] == ("test" if i >= test_start else "calib" if i >= calib_start else "train")
    place = {r["txn_id"]: r["place"] for r in ranks.place(df).collect()}
    assert all(place[txn] == i + 1 for i, (txn, _) in enumerate(ordered))


def test_split_of_text_ids_has_exact_sizes(spark):
    df = spark.createDataFrame([(f"t{i}", i // 7) for i in range(100)], "txn_id STRING, ts_us LONG")
    got = {r["split"]: r["rows"] for r in reports.split_counts(ranks.temporal_split(df)).collect()}
    assert got == {"train": 57, "calib": 13, "test": 30}


def test_cap_per_group_keeps_every_small_group(spark):
    df = spark.range(3000).select(F.col("id").alias("txn_id"), F.when(F.col("id") < 2900, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 10)).alias("g"))
    got = {r["g"]: r["count"] for r in ranks.cap_per_group(df, ["g"], 25).groupBy("g").count().collect()}
    assert got.pop("big") == 25 and set(got.values()) == {10}


def test_shuffled_index_is_a_permutation(spark):
    df = ranks.shuffled_index(spark.range(500).withColumnRenamed("id", "txn_id"), "i", 4)
    assert sorted(r["i"] for r in df.collect()) == list(range(500))


def test_pair_selection_equals_the_greedy_walk(spark):
    cat = catalogue.sample_catalogue(spark)
    more = cat.unionByName(cat.withColumns({"id": F.concat("id", F.lit("x")), "family": F.concat("family", F.lit("2")), "impact": F.lit(2)}))
    pairs = catalogue.pair_candidates(more)
    rows = sorted(pairs.select("a.id", "b.id", "pre_score").collect(), key=lambda r: (-r[2], r[0], r[1]))
    used, want = {}, []
    for a, b, _ in rows:
        if used.get(a, 0) < 2 and used.get(b, 0) < 2 and len(want) < 6:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            want.append((a, b))
    got = catalogue.select_pairs(pairs, 6).orderBy("pick").select("a_id", "b_id").collect()
    assert [tuple(r) for r in got] == want
    built = catalogue.compose(catalogue.select_pairs(pairs, 6)).collect()
    assert len(built) == 6 and all(len(set(r["parents"])) == 2 and 0 < r["threat_score"] <= 100 for r in built)
    assert [r["id"] for r in sorted(built, key=lambda r: r["id"])] == [f"HYB-{i:02d}" for i in range(1, 7)]


def test_label_noise_leaves_test_labels_alone(spark):
    df = spark.range(4000).select(
        F.col("id").alias("txn_id"), (F.col("id") % 10 == 0).cast("int").alias("y"),
        F.when(F.col("id") < 3000, "train").otherwise("test").alias("split"))
    noisy = quality.label_noise(df, missed=0.2, false=0.01)
    changed = {r["split"]: r["n"] for r in noisy.groupBy("split").agg(F.sum((F.col("y") != F.col("y_observed")).cast("int")).alias("n")).collect()}
    assert changed["test"] == 0 and changed["train"] > 20
    assert noisy.exceptAll(quality.label_noise(df, missed=0.2, false=0.01)).count() == 0


def test_masking_is_joint_and_independent_of_the_label(spark):
    df = spark.range(5000).select(F.col("id").alias("txn_id"), (F.col("id") % 5 == 0).cast("int").alias("is_fraud"),
                                  F.lit(1.0).alias("hesitation_ms"), F.lit(2.0).alias("typing_variance"))
    out = quality.mask_columns(df, ["hesitation_ms", "typing_variance"])
    assert out.filter("(hesitation_ms IS NULL) <> (typing_variance IS NULL)").count() == 0
    got = {r["label"]: r["missing"] for r in reports.telemetry_coverage(out, ["hesitation_ms"]).collect()}
    assert abs(got["all"] - 0.38) < 0.05 and abs(got["fraud"] - got["all"]) < 0.06


def test_holdout_family_without_rows_is_still_listed(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.9), (2, "b", 1, 0.1)], "txn_id LONG, vector_id STRING, y INT, score DOUBLE")
    got = {r["family"]: r for r in reports.holdout_recall(df, ("b", "zz"), 0.5).collect()}
    assert got["zz"]["n"] == 0 and got["zz"]["recall"] is None
    assert got["b"]["recall"] == 0.0 and got["__known_families__"]["recall"] == 1.0


def test_viability_is_bounded_and_parameters_are_clipped(spark):
    df = spark.createDataFrame([("g", "f", 10, 1.0, 80000.0, 1.4, -0.2)], "group_id STRING, family STRING, n INT, evasion_rate DOUBLE, value_extracted DOUBLE, aggression DOUBLE, velocity DOUBLE")
    bounds = spark.createDataFrame([("f", "velocity", 0.3, None)], "family STRING, parameter STRING, lower DOUBLE, upper DOUBLE")
    held = feedback.clip_parameters(df, bounds).first()
    assert held["aggression"] == 1.0 and held["velocity"] == 0.3
    got = feedback.viability(df.withColumns({"aggression": F.lit(1.0), "velocity": F.lit(0.5)})).first()
    assert 0 <= got["operational_cost"] <= 1 and 0 <= got["viability"] <= 1 and got["fitness"] > 0


def test_ndjson_skips_blank_lines_and_reads_gzip(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as fh:
        fh.write(json.dumps({"txn_id": "a", "amount": 1.5}) + "\n\n" + json.dumps({"txn_id": "b"}) + "\n")
    rows = files.read_ndjson(spark, str(tmp_path)).orderBy("txn_id").collect()
    assert [(r["txn_id"], r["amount"]) for r in rows] == [("a", 1.5), ("b", None)]


def test_json_safe_numbers_and_csv_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.23456789)], "id INT, v DOUBLE")
    assert [r["v"] for r in files.normalise(df).orderBy("id").collect()] == [None, None, 1.234568]
    files.write_csv(df, str(tmp_path / "c"), ["v", "id", "absent"])
    back = spark.read.option("header", "true").csv(str(tmp_path / "c"))
    assert back.columns == ["v", "id", "absent"] and back.count() == 3


@pytest.mark.parametrize("text_ids", [False, True])
def test_boundaries_with_one_instant_and_refined_bins(spark, monkeypatch, text_ids):
    monkeypatch.setattr(ranks, "_SORTED", 20)
    rng = random.Random(4)
    for times in ([7] * 300, [5] * 270 + [rng.randint(-(10**15), 10**15) for _ in range(30)]):
        rows = [(f"t{i:04d}" if text_ids else i, t) for i, t in enumerate(times)]
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, f"txn_id {'STRING' if text_ids else 'LONG'}, ts_us LONG")
        ordered = sorted((t, i) for i, t in rows)
        at = [0, 1, 150, 298, 299]
        assert ranks.boundaries(df, at) == [ordered[p] for p in at]
        place = {r["txn_id"]: r["place"] for r in ranks.place(df).collect()}
        assert all(place[i] == n + 1 for n, (_, i) in enumerate(ordered))


def test_medians_close_in_on_the_middle(spark):
    import statistics

    from ledgerscope.operators import reports

    rng = random.Random(9)
    columns = {
        "even": [rng.gauss(0, 1e6) for _ in range(400)], "ties": [3.0] * 390 + [rng.random() for _ in range(10)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-200, 300) for _ in range(400)],
        "gaps": [None if i % 3 else float("nan") if i % 2 else float(i) for i in range(400)],
        "two": [1.0, 2.0] + [None] * 398, "none": [None] * 400,
        "infinite": [float("inf"), float("-inf")] + [float(i) for i in range(398)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} DOUBLE" for c in columns))
    got = {r["feature"]: r["median"] for r in reports.column_medians(df, list(columns)).collect()}
    want = {c: [x for x in v if x is not None and abs(x) < float("inf")] for c, v in columns.items()}
    assert got == {c: statistics.median(v) for c, v in want.items() if v}


def test_first_flows_of_a_campaign_are_found_whatever_the_days(spark):
    from ledgerscope import constants as K
    from ledgerscope.queries.other_queries import earliest_per_campaign

    rng = random.Random(12)
    rows = [(c, rng.randrange(40), rng.randrange(3), rng.randrange(3), 1.0 * rng.randrange(2), int(rng.randrange(days) * K.DAY_US / 2))
            for c, days in ((1, 200), (2, 3), (3, 1), (None, 90)) for _ in range(400)]
    rows += rows[:100] + [(4, 1, 1, 1, 1.0, None), (4, 2, 1, 1, 1.0, 5)]
    df = spark.createDataFrame(rows, "campaign_id long, order_id long, layer int, dst long, amount double, ts_us long")
    wanted = []
    for c in (1, 2, 3, 4, None):
        mine = sorted({r for r in rows if r[0] == c}, key=lambda r: (-1 if r[5] is None else r[5], *r[1:5]))
        wanted += [r[:5] for r in mine[:5]]
    found = [(r.campaign_id, r.order_id, r.layer, r.dst, r.amount) for r in earliest_per_campaign(df, 5).collect()]
    assert sorted(map(str, found)) == sorted(map(str, wanted))
