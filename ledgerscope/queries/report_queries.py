"""Projections, joins, aggregates, decisions and curves over the generic tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import curves, decisions, ranks, reports
from ..sources import tables as T
from .registry import HALF, CUSTOMERS_SQL, EPISODES_SQL, LEDGER_SQL, MERCHANTS_SQL, SCORED_SQL, n, query, r, rounded

S = f"WITH {SCORED_SQL}"
TH = 0.9
HOLD = "('v7', 'v8', 'v_unseen')"
BUDGET = "th AS (SELECT quantile_cont(score, 0.98) AS threshold FROM scored)"
CURVE = (
    "d AS (SELECT score, count(*) AS rows, count(*) FILTER (y = 1) AS pos, "
    "coalesce(sum(amount) FILTER (y = 1), 0) AS pos_amount FROM scored GROUP BY score), "
    "cv AS (SELECT *, sum(rows) OVER w AS n, sum(pos) OVER w AS tp, sum(pos_amount) OVER w AS tv, "
    "row_number() OVER (ORDER BY score DESC) AS rk, count(*) OVER () AS points, sum(rows) OVER () AS an, "
    "sum(pos) OVER () AS ap, sum(pos_amount) OVER () AS av FROM d "
    "WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
)


def scored(spark, sf):
    return T.scored(spark, sf)


def register(name, sql):
    """Registers a query whose doubles are compared at six places."""
    def add(fn):
        query(name, sql)(lambda spark, sf: rounded(fn(spark, sf)))
        return fn
    return add


# Projections and predicates.

@register("p1_amount_columns", "SELECT o_orderkey AS id, " + r("ln(1 + o_totalprice)", "log_amount") +
          ", CASE WHEN abs(o_totalprice - round(o_totalprice / 100) * 100) < 1e-6 THEN 1e0 ELSE 0e0 END AS roundness, " +
          r("CASE WHEN o_totalprice <= 5000 THEN (5000 - o_totalprice) / 5000 WHEN o_totalprice <= 25000 THEN (25000 - o_totalprice) / 25000 "
            "WHEN o_totalprice <= 50000 THEN (50000 - o_totalprice) / 50000 WHEN o_totalprice <= 100000 THEN (100000 - o_totalprice) / 100000 ELSE 1 END", "gap") +
          " FROM orders")
def _p1(spark, sf):
    a = F.col("o_totalprice")
    return T.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.log1p(a).alias("log_amount"), C.is_round_hundred(a).alias("roundness"),
        C.threshold_gap(a).alias("gap"))


@register("p2_calendar_columns", "SELECT event_id AS id, " + r("(epoch_us(ts) % 86400000000) / 3.6e9", "hour") +
          ", CAST(isodow(ts) - 1 AS DOUBLE) AS weekday, CAST((epoch_us(ts) // 86400000000) % 7 AS DOUBLE) AS weekday_mod7, "
          "CASE WHEN hour(ts) < 5 OR hour(ts) = 5 AND minute(ts) < 30 OR hour(ts) = 23 THEN 1e0 ELSE 0e0 END AS is_night FROM events")
def _p2(spark, sf):
    us = F.unix_micros("ts")
    return T.read(spark, sf, "events").select(
        F.col("event_id").alias("id"), C.hour_of_day(us).alias("hour"), C.day_index(us).alias("weekday"),
        C.day_index(us, "epoch_mod7").alias("weekday_mod7"), C.is_night(us).alias("is_night"))


@register("p3_default_or_missing", f"WITH {LEDGER_SQL} SELECT txn_id, CAST(coalesce(otp_attempts, 0) AS DOUBLE) AS otp_attempts, "
          "CASE WHEN coalesce(device_sim_count, 0) = 0 THEN 1.0 ELSE CAST(device_sim_count AS DOUBLE) END AS sims, "
          "CAST(screen_share AS DOUBLE) AS screen_share FROM ledger")
def _p3(spark, sf):
    return T.ledger(spark, sf).select(
        "txn_id", C.or_default("otp_attempts").alias("otp_attempts"), C.or_one("device_sim_count").alias("sims"),
        C.observed("screen_share").alias("screen_share"))


@register("p4_ordinal_encode", "SELECT o_orderkey AS id, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE -1 END AS DOUBLE) AS code FROM orders")
def _p4(spark, sf):
    return T.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), C.ordinal(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM"]).alias("code"))


@register("p5_membership_flags", f"WITH {LEDGER_SQL} SELECT txn_id, CASE WHEN category IN ('liquid','cash','highrisk','luxury','financial') THEN 1e0 ELSE 0e0 END AS liquid, "
          "CASE WHEN country IN ('NG','UA','PH','HK') THEN 1e0 ELSE 0e0 END AS risky FROM ledger")
def _p5(spark, sf):
    return T.ledger(spark, sf).select(
        "txn_id", C.flag(F.coalesce("merchant_category", F.lit("unknown")).isin(*K.LIQUID_CATEGORIES)).alias("liquid"),
        C.flag(F.col("country").isin(*K.HIGH_RISK_COUNTRIES)).alias("risky"))


@register("p6_holdout_exclusion", f"{S} SELECT txn_id, vector_id FROM scored WHERE vector_id IS NULL OR vector_id NOT IN {HOLD}")
def _p6(spark, sf):
    held = F.coalesce(F.col("vector_id").isin(*T.HOLDOUT), F.lit(False))
    return scored(spark, sf).filter(~held).select("txn_id", "vector_id")


@register("p7_mask_identifier", "SELECT c_custkey AS id, CASE WHEN length(c_name) > 4 THEN substr(c_name, 1, 2) || '…' || right(c_name, 4) ELSE c_name END AS masked FROM customer")
def _p7(spark, sf):
    return T.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), C.mask_identifier(F.col("c_name")).alias("masked"))


@register("p11_alerts", f"{S} SELECT txn_id, {r('score', 'score')} FROM scored WHERE score >= {TH}")
def _p11(spark, sf):
    return scored(spark, sf).filter(F.col("score") >= TH).select("txn_id", "score")


@register("p12_outcome_label", f"{S} SELECT txn_id, CASE WHEN y = 1 AND score < {TH} THEN 'missed' WHEN y = 1 THEN 'fraud' WHEN score >= {TH} THEN 'false_alert' ELSE 'ok' END AS outcome FROM scored")
def _p12(spark, sf):
    return scored(spark, sf).select("txn_id", decisions.outcome(F.col("y"), F.col("score"), F.lit(TH)).alias("outcome"))


# Joins.

@register("j1_customer_home", f"WITH {LEDGER_SQL}, {CUSTOMERS_SQL} SELECT l.txn_id, " +
          r("CASE WHEN c.customer_id IS NOT NULL THEN c.lat ELSE l.lat END", "home_lat") + ", " +
          r("CASE WHEN c.customer_id IS NOT NULL THEN c.lon ELSE l.lon END", "home_lon") +
          ", CASE WHEN c.customer_id IS NOT NULL THEN c.country ELSE l.country END AS home_country FROM ledger l LEFT JOIN customers c ON l.customer_id = c.customer_id")
def _j1(spark, sf):
    dim = T.customers(spark, sf).select("customer_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"),
                                        F.col("country").alias("c_country"), F.lit(True).alias("known"))
    got = F.col("known").isNotNull()
    return T.ledger(spark, sf).join(dim, "customer_id", "left").select(
        "txn_id", F.when(got, F.col("c_lat")).otherwise(F.col("lat")).alias("home_lat"),
        F.when(got, F.col("c_lon")).otherwise(F.col("lon")).alias("home_lon"),
        F.when(got, F.col("c_country")).otherwise(F.col("country")).alias("home_country"))


@register("j2_merchant_rate", f"WITH {LEDGER_SQL}, {MERCHANTS_SQL} SELECT txn_id, {r('coalesce(chargeback_rate, 0.004)', 'rate')} FROM ledger LEFT JOIN merchants USING (merchant_id)")
def _j2(spark, sf):
    dim = T.merchants(spark, sf).select("merchant_id", "chargeback_rate")
    return T.ledger(spark, sf).join(dim, "merchant_id", "left").select(
        "txn_id", F.coalesce("chargeback_rate", F.lit(K.DEFAULT_CHARGEBACK_RATE)).alias("rate"))


@register("j3_own_account", f"WITH {LEDGER_SQL}, {CUSTOMERS_SQL} SELECT l.txn_id, c.self_account FROM ledger l LEFT JOIN customers c ON l.customer_id = c.customer_id")
def _j3(spark, sf):
    return T.ledger(spark, sf).join(T.customers(spark, sf).select("customer_id", "self_account"), "customer_id", "left").select("txn_id", "self_account")


@register("j4_payment_episode", f"WITH {LEDGER_SQL}, {EPISODES_SQL} SELECT l.txn_id, {n('e.turn_count', 'turns')}, {r('e.duration_s', 'duration')} FROM ledger l LEFT JOIN episodes e ON l.narrative_id = e.episode_id")
def _j4(spark, sf):
    e = T.episode_stats(spark, sf).select(F.col("episode_id").alias("narrative_id"), F.col("turn_count").cast("long").alias("turns"), F.col("duration_s").alias("duration"))
    return T.ledger(spark, sf).join(e, "narrative_id", "left").select("txn_id", "turns", "duration")


SPLIT_SQL = ("ranked AS (SELECT *, row_number() OVER (ORDER BY ts_us, txn_id) - 1 AS i, count(*) OVER () AS total FROM ledger), "
             "splits AS (SELECT *, CASE WHEN i >= CAST(floor(total * (1 - 0.3)) AS BIGINT) THEN 'test' "
             "WHEN i >= CAST(floor(floor(total * (1 - 0.3)) * (1 - 0.18)) AS BIGINT) THEN 'calib' ELSE 'train' END AS split FROM ranked)")


def split_ledger(spark, sf):
    df = T.ledger(spark, sf)
    return ranks.temporal_split(df.withColumn("ts_us", F.unix_micros("ts")))


@register("j5_training_episodes", f"WITH {LEDGER_SQL}, {EPISODES_SQL}, {SPLIT_SQL} SELECT episode_id, is_fraud FROM episodes WHERE episode_id IN (SELECT narrative_id FROM splits WHERE split = 'train' AND narrative_id IS NOT NULL)")
def _j5(spark, sf):
    train = split_ledger(spark, sf).filter("split = 'train'").select(F.col("narrative_id").alias("episode_id"))
    return T.turns(spark, sf).select("episode_id", "is_fraud").distinct().join(train, "episode_id", "left_semi")


@register("j6_heldout_episodes", f"WITH {LEDGER_SQL}, {EPISODES_SQL}, {SPLIT_SQL} SELECT episode_id, is_fraud FROM episodes WHERE episode_id NOT IN (SELECT narrative_id FROM splits WHERE split = 'train' AND narrative_id IS NOT NULL)")
def _j6(spark, sf):
    train = split_ledger(spark, sf).filter("split = 'train'").select(F.col("narrative_id").alias("episode_id"))
    return T.turns(spark, sf).select("episode_id", "is_fraud").distinct().join(train, "episode_id", "left_anti")


@register("j7_episode_score_to_payments", f"WITH {LEDGER_SQL}, {EPISODES_SQL} SELECT l.txn_id, {r('(e.duration_s % 97) / 97.0', 'coercion_score')} FROM ledger l JOIN episodes e ON l.narrative_id = e.episode_id")
def _j7(spark, sf):
    s = T.episode_stats(spark, sf).select(F.col("episode_id").alias("narrative_id"), ((F.col("duration_s") % 97) / 97.0).alias("coercion_score"))
    return T.ledger(spark, sf).join(s, "narrative_id").select("txn_id", s["coercion_score"])


@register("j9_rows_by_candidate", f"{S} SELECT txn_id, c.candidate, {r('CASE c.candidate WHEN $$amount$$ THEN amount WHEN $$score$$ THEN score ELSE novelty END', 'value')} FROM scored, (VALUES ('amount'), ('score'), ('novelty')) c(candidate)")
def _j9(spark, sf):
    names = ["amount", "score", "novelty"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), F.col(c).alias("value")) for c in names]))
    return scored(spark, sf).select("txn_id", pairs.alias("p")).select("txn_id", "p.candidate", "p.value")


GRID_SQL = (
    "ordered AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () - 1 AS last FROM scored), "
    "levels AS (SELECT q * last AS pos, CAST(floor(q * last) AS BIGINT) AS lo, last FROM (SELECT unnest(["
    + ", ".join(f"{q!r}e0" for q in curves.threshold_grid())
    + "]) AS q), (SELECT max(last) AS last FROM ordered)), "
    "grid AS (SELECT DISTINCT a.score + (b.score - a.score) * (pos - lo) AS threshold FROM levels l "
    "JOIN ordered a ON a.i = l.lo JOIN ordered b ON b.i = least(l.lo + 1, l.last))"
)
COST_SQL = ("cost AS (SELECT g.threshold, count(*) FILTER (score >= threshold) AS n, count(*) FILTER (score >= threshold AND y = 1) AS tp, "
            "count(*) FILTER (score < threshold AND y = 1) AS fn, coalesce(sum(amount) FILTER (score < threshold AND y = 1), 0) AS missed, count(*) AS total "
            "FROM scored, grid g GROUP BY g.threshold), "
            "cc AS (SELECT threshold, n / total AS alert_rate, tp, n - tp AS fp, fn, tp / greatest(1, tp + fn) AS recall, tp / greatest(1, n) AS precision, "
            "missed * 0.72 + n * 55.0 + (n - tp) * 0.35 * 420.0 AS expected_cost FROM cost)")
COST_COLS = (f"{r('threshold', 'threshold')}, {r('alert_rate', 'alert_rate')}, {n('tp', 'tp')}, {n('fp', 'fp')}, {n('fn', 'fn')}, "
             f"{r('recall', 'recall')}, {r('precision', 'precision')}, {r('expected_cost', 'expected_cost', 2)}")


def _cost(df):
    return df.withColumn("expected_cost", F.floor(F.col("expected_cost") * 100 + HALF) / 100)


@register("j10_threshold_grid", f"{S}, {GRID_SQL}, {COST_SQL} SELECT {COST_COLS} FROM cc")
def _j10(spark, sf):
    return _cost(curves.cost_curve(scored(spark, sf)))


@register("j11_percentile_in_reference", f"{S}, ref AS (SELECT score FROM scored WHERE y = 0), "
          "rk AS (SELECT s, sum(c) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (SELECT score AS s, count(*) AS c FROM ref GROUP BY 1)), "
          f"tot AS (SELECT count(*) AS n FROM ref) SELECT a.txn_id, {r('coalesce(CASE WHEN rk.s = a.p_model THEN coalesce(rk.below, 0) ELSE coalesce(rk.below, 0) + (SELECT count(*) FROM ref WHERE ref.score = rk.s) END, 0) / (SELECT n FROM tot)', 'percentile')} "
          "FROM scored a ASOF LEFT JOIN rk ON a.p_model >= rk.s")
def _j11(spark, sf):
    df = scored(spark, sf)
    return curves.percentile_in_reference(df.select("txn_id", "p_model"), "p_model", df.filter("y = 0"), "score").select("txn_id", "percentile")


@register("j13_scored_with_ledger", "SELECT o_orderkey AS txn_id, c_mktsegment AS segment, " + r("o_totalprice", "amount", 2) + " FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _j13(spark, sf):
    dim = T.read(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"))
    return scored(spark, sf).join(dim, "customer_id", "left").select("txn_id", "segment", C.from_micro_units(C.to_micro_units(F.col("amount"))).alias("amount"))


@register("j14_nearest_grid_point", f"{S}, {GRID_SQL}, {COST_SQL}, th AS (SELECT quantile_cont(score, 0.98) AS t FROM scored) SELECT {COST_COLS} FROM cc, th ORDER BY abs(threshold - t), threshold LIMIT 1")
def _j14(spark, sf):
    df = scored(spark, sf)
    grid = curves.cost_curve(df)
    t = curves.budget_threshold(df).withColumnRenamed("threshold", "t")
    near = F.min_by(F.struct(*grid.columns), F.struct(F.abs(F.col("threshold") - F.col("t")), "threshold"))
    return _cost(grid.crossJoin(F.broadcast(t)).agg(near.alias("g")).select("g.*"))


# Aggregations.

@register("a1_ledger_summary", f"WITH {LEDGER_SQL} SELECT {n('count(*)', 'transactions')}, {n('sum(is_fraud)', 'fraud_transactions')}, {r('avg(is_fraud)', 'fraud_rate')}, "
          f"{r('sum(amount) FILTER (is_fraud = 1)', 'fraud_value', 2)}, {r('sum(amount)', 'total_value', 2)}, {r('sum(amount) FILTER (is_fraud = 1) / sum(amount)', 'fraud_value_share')}, "
          f"{r('count(benign_anomaly) / count(*) FILTER (is_fraud = 0)', 'benign_anomaly_rate')} FROM ledger")
def _a1(spark, sf):
    df = reports.ledger_summary(T.ledger(spark, sf))
    return df.withColumns({c: F.floor(F.col(c) * 100 + HALF) / 100 for c in ("fraud_value", "total_value")})


@register("a2_counts_by_axis", f"WITH {LEDGER_SQL} SELECT 'vector' AS axis, vector_id AS value, {n('count(*)', 'n')} FROM ledger WHERE is_fraud = 1 GROUP BY vector_id "
          f"UNION ALL SELECT 'rail', rail, count(*) FROM ledger GROUP BY rail UNION ALL SELECT 'fraud_rail', rail, count(*) FROM ledger WHERE is_fraud = 1 GROUP BY rail "
          "UNION ALL SELECT 'benign', benign_anomaly, count(*) FROM ledger WHERE benign_anomaly IS NOT NULL GROUP BY benign_anomaly")
def _a2(spark, sf):
    return reports.counts_by(T.ledger(spark, sf))


@register("a3_entity_stats", f"WITH {CUSTOMERS_SQL}, {MERCHANTS_SQL} SELECT 'persona' AS axis, persona AS value, {n('count(*)', 'n')} FROM customers GROUP BY persona "
          "UNION ALL (SELECT 'city', city, count(*) FROM customers GROUP BY city ORDER BY count(*) DESC, city LIMIT 10) "
          "UNION ALL SELECT 'category', category, count(*) FROM merchants GROUP BY category")
def _a3(spark, sf):
    return reports.entity_stats(T.customers(spark, sf), T.merchants(spark, sf))


@register("a4_group_profile", f"WITH {LEDGER_SQL} SELECT vector_id, {n('count(*)', 'transactions')}, {n('sum(is_fraud)', 'fraud_transactions')}, {r('sum(amount) FILTER (is_fraud = 1)', 'value_extracted', 2)} FROM ledger WHERE vector_id IS NOT NULL GROUP BY vector_id")
def _a4(spark, sf):
    df = reports.group_profile(T.ledger(spark, sf))
    return df.withColumn("value_extracted", F.floor(F.col("value_extracted") * 100 + HALF) / 100)


def point_sql(where="TRUE", th=str(TH), by=""):
    g = f"{by}, " if by else ""
    return (f"SELECT {g}{r(f'max({th})', 'threshold')}, tp, fp, fn, tn, {r('tp / greatest(1, tp + fp)', 'precision')}, {r('tp / greatest(1, tp + fn)', 'recall')}, "
            f"{r('2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(1e-9, tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn))', 'f1')}, "
            f"{r('fp / greatest(1, fp + tn)', 'fpr')}, {r('(tp + fp) / (tp + fp + fn + tn)', 'alert_rate')}, {r('vc', 'value_caught', 2)}, {r('vm', 'value_missed', 2)}, "
            f"{r('vc / greatest(1.0, vc + vm)', 'value_recall')}, {r('(tp + fp) * 55.0', 'review_cost', 2)}, {r('fp * 0.35 * 420.0', 'false_decline_cost', 2)}, "
            f"{r('vm * 0.72 + (tp + fp) * 55.0 + fp * 0.35 * 420.0', 'expected_cost', 2)}, "
            f"{r('CASE WHEN p <= 0 OR p >= 1 THEN p ELSE (p / (1 - p)) * ((1 - o) / o) * (0.0012 / 0.9988) / (1 + (p / (1 - p)) * ((1 - o) / o) * (0.0012 / 0.9988)) END', 'precision_at_real_prevalence')} FROM (")


def confusion_sql(th, src="scored"):
    inner = (f"SELECT *, tp / greatest(1, tp + fp) AS p, (tp + fn) / (tp + fp + fn + tn) AS o FROM (SELECT max({th}) AS th, "
             f"CAST(count(*) FILTER (score >= {th} AND y = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (score >= {th} AND y = 0) AS BIGINT) AS fp, "
             f"CAST(count(*) FILTER (score < {th} AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (score < {th} AND y = 0) AS BIGINT) AS tn, "
             f"coalesce(sum(amount) FILTER (score >= {th} AND y = 1), 0) AS vc, coalesce(sum(amount) FILTER (score < {th} AND y = 1), 0) AS vm FROM {src})")
    return point_sql().replace(f"max({TH})", "th") + inner + ")"


MONEY = ("value_caught", "value_missed", "review_cost", "false_decline_cost", "expected_cost")


def cents(df, cols=MONEY):
    return df.withColumns({c: F.floor(F.col(c) * 100 + HALF) / 100 for c in cols if c in df.columns})


@register("a6_confusion_and_cost", f"{S} {confusion_sql(str(TH))}")
def _a6(spark, sf):
    return cents(reports.at_threshold(scored(spark, sf), TH))


@register("a7_recall_by_group", f"{S} SELECT vector_id, {n('count(*)', 'n')}, {r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END)', 'recall')}, {r('sum(amount)', 'value', 2)}, "
          f"{r('coalesce(sum(amount) FILTER (score >= 0.9), 0) / greatest(1.0, sum(amount))', 'value_recall')}, {r('median(score)', 'median_score')}, vector_id IN {HOLD} AS held_out "
          "FROM scored WHERE vector_id IS NOT NULL GROUP BY vector_id")
def _a7(spark, sf):
    return cents(reports.recall_by_group(scored(spark, sf), TH, holdout=T.HOLDOUT), ("value",))


@register("a8_false_positives_by_anomaly", f"{S} SELECT coalesce(benign_anomaly, '__normal__') AS kind, {n('count(*)', 'n')}, {r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END)', 'false_positive_rate')} FROM scored WHERE y = 0 GROUP BY 1")
def _a8(spark, sf):
    return reports.false_positives_by_anomaly(scored(spark, sf), TH)


@register("a9_rail_report", f"{S} SELECT rail, {n('count(*)', 'n')}, {n('sum(y)', 'fraud')}, {r('count(*) FILTER (score >= 0.9 AND y = 1) / greatest(1, sum(y))', 'recall')}, {r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END)', 'alert_rate')} FROM scored GROUP BY rail")
def _a9(spark, sf):
    return reports.rail_report(scored(spark, sf), TH)


@register("a10_rules_fired", f"SELECT 'R-1' AS code, {n('count(*)', 'n')} FROM orders WHERE o_orderkey % 23 = 0 UNION ALL SELECT 'R-2', count(*) FROM orders WHERE o_orderkey % 29 = 0 UNION ALL SELECT 'R-3', count(*) FROM orders WHERE o_orderkey % 31 = 0")
def _a10(spark, sf):
    return reports.rules_fired(scored(spark, sf))


@register("a11_channel_attribution", f"{S} SELECT {n('count(*) FILTER (rule_score >= 0.7 AND p_model < 0.7 AND y = 1)', 'fraud_caught_only_by_rules')}, "
          f"{n('count(*) FILTER (novelty > 0.985 AND p_model < 0.7 AND y = 1)', 'fraud_caught_only_by_novelty')}, {r('avg(p_model) FILTER (y = 1)', 'mean_model_score_fraud')}, {r('avg(p_model) FILTER (y = 0)', 'mean_model_score_legit')} FROM scored")
def _a11(spark, sf):
    return reports.channel_attribution(scored(spark, sf), 0.7)


@register("a12_score_histogram", f"{S} SELECT {n('least(floor(score * 40), 39)', 'bin')}, {r('least(floor(score * 40), 39) / 40.0', 'low')}, {n('sum(y)', 'fraud')}, {n('sum(1 - y)', 'legit')} FROM scored GROUP BY 1, 2")
def _a12(spark, sf):
    return reports.score_histogram(scored(spark, sf))


@register("a13_quantiles", f"{S} SELECT CAST(q AS DOUBLE) AS q, {r('v', 'value')} FROM (SELECT unnest([0.5, 0.95, 0.99]) AS q, unnest(quantile_cont(novelty, [0.5, 0.95, 0.99])) AS v FROM scored WHERE y = 0)")
def _a13(spark, sf):
    return curves.quantiles(scored(spark, sf).filter("y = 0"), "novelty", [0.5, 0.95, 0.99])


@register("a14_novelty_profile", f"{S}, q AS (SELECT quantile_cont(novelty, 0.5) AS p50, quantile_cont(novelty, 0.99) AS p99 FROM scored WHERE y = 0) SELECT vector_id, {n('count(*)', 'n')}, {r('avg(novelty)', 'mean_novelty_percentile')}, "
          f"{r('avg(CASE WHEN novelty > p99 THEN 1.0 ELSE 0.0 END)', 'share_above_legit_p99')}, {r('max(p50)', 'legit_p50')}, {r('max(p99)', 'legit_p99')}, vector_id IN {HOLD} AS held_out FROM scored, q WHERE y = 1 AND vector_id IS NOT NULL GROUP BY vector_id")
def _a14(spark, sf):
    return reports.novelty_profile(scored(spark, sf), T.HOLDOUT)


@register("a15_column_medians", f"WITH {LEDGER_SQL} SELECT 'amount' AS feature, {r('median(amount)', 'median')} FROM ledger UNION ALL SELECT 'session_duration_s', {r('median(session_duration_s)', 'm')} FROM ledger "
          f"UNION ALL SELECT 'typing_variance', {r('median(typing_variance)', 'm')} FROM ledger UNION ALL SELECT 'mandate_ceiling', {r('median(mandate_ceiling)', 'm')} FROM ledger")
def _a15(spark, sf):
    return reports.column_medians(T.ledger(spark, sf), ["amount", "session_duration_s", "typing_variance", "mandate_ceiling"])


@register("a16_holdout_recall", f"{S}, f AS (SELECT CASE WHEN vector_id IN {HOLD} THEN vector_id ELSE '__known_families__' END AS family, score FROM scored WHERE y = 1), "
          f"names(family) AS (VALUES ('v7'), ('v8'), ('v_unseen'), ('__known_families__')) SELECT names.family, {n('count(score)', 'n')}, {r('avg(CASE WHEN score >= 0.9 THEN 1.0 WHEN score < 0.9 THEN 0.0 END)', 'recall')}, {r('avg(score)', 'mean_score')}, {r('median(score)', 'median_score')} FROM names LEFT JOIN f USING (family) GROUP BY 1")
def _a16(spark, sf):
    return reports.holdout_recall(scored(spark, sf), T.HOLDOUT, TH)


@register("a17_paired_lift", f"{S} SELECT rail, {n('count(*)', 'n')}, {r('avg(amount)', 'mean_amount', 4)}, {r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END)', 'recall_full')}, {r('avg(CASE WHEN p_model >= 0.8 THEN 1.0 ELSE 0.0 END)', 'recall_without')}, "
          f"{r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN p_model >= 0.8 THEN 1.0 ELSE 0.0 END)', 'lift')}, {r('avg(score)', 'mean_score_full')}, {r('avg(p_model)', 'mean_score_without')} FROM scored GROUP BY rail")
def _a17(spark, sf):
    df = reports.paired_lift(scored(spark, sf), "rail", "score", 0.9, "p_model", 0.8)
    return df.withColumn("mean_amount", F.floor(F.col("mean_amount") * 1e4 + HALF) / 1e4)


@register("a20_distinct_payers_24h", f"WITH {LEDGER_SQL} SELECT txn_id, {n('count(DISTINCT customer_id) OVER (PARTITION BY merchant_id ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)', 'payers')} FROM ledger WHERE merchant_id IS NOT NULL")
def _a20(spark, sf):
    from ..operators.causal import Running, causal
    from ..operators.features.account import distinct_payer_steps

    visits = T.ledger(spark, sf).filter("merchant_id IS NOT NULL").select(
        "txn_id", F.col("merchant_id").alias("acct"), F.col("customer_id").alias("payer"), F.unix_micros("ts").alias("ts_us"))
    steps = distinct_payer_steps(visits.drop("txn_id"))
    line = causal(
        visits.select("acct", "ts_us", F.lit(0).cast("long").alias("payer_step")).unionByName(steps),
        ["acct"], "ts_us", [Running("payers", F.col("payer_step"))], collapse=True)
    return visits.join(line, ["acct", "ts_us"]).select("txn_id", "payers")


@register("a21_telemetry_coverage", f"WITH {LEDGER_SQL}, x AS (SELECT 'all' AS label, * FROM ledger UNION ALL SELECT CASE WHEN is_fraud = 1 THEN 'fraud' ELSE 'legit' END, * FROM ledger) "
          + " UNION ALL ".join(f"SELECT label, '{c}' AS \"column\", {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)', 'missing')} FROM x GROUP BY label" for c in K.OPTIONAL_TELEMETRY))
def _a21(spark, sf):
    return reports.telemetry_coverage(T.ledger(spark, sf))


@register("a23_fraud_share_by_rail", f"WITH {LEDGER_SQL} SELECT rail, {n('count(*)', 'n')}, {n('sum(is_fraud)', 'fraud')}, {r('sum(is_fraud) / count(*)', 'share')} FROM ledger GROUP BY rail ORDER BY share DESC, rail")
def _a23(spark, sf):
    return reports.fraud_share_by_rail(T.ledger(spark, sf))


@register("a24_split_counts", f"WITH {LEDGER_SQL}, {SPLIT_SQL} SELECT split, {n('count(*)', 'rows')} FROM splits GROUP BY split")
def _a24(spark, sf):
    return reports.split_counts(split_ledger(spark, sf))


# Decisions.

@register("d3_novelty_tail", f"{S} SELECT txn_id, {r('least(1.0, greatest(0.0, (novelty - 0.985) / 0.015)) * 0.18', 'contrib')} FROM scored")
def _d3(spark, sf):
    return scored(spark, sf).select("txn_id", decisions.novelty_contribution(F.col("novelty")).alias("contrib"))


FUSED = "1 - (1 - p_model) * (1 - least(1.0, greatest(0.0, (novelty - 0.985) / 0.015)) * 0.18) * (1 - rule_score)"


@register("d4_noisy_or", f"{S} SELECT txn_id, {r(FUSED, 'score')} FROM scored")
def _d4(spark, sf):
    return decisions.fuse(scored(spark, sf)).select("txn_id", "score")


@register("d5_decision", f"{S} SELECT txn_id, CASE WHEN score >= 0.95 THEN 'decline' WHEN score >= 0.8 THEN 'step_up' WHEN score >= 0.8 * 0.55 THEN 'review' ELSE 'approve' END AS decision FROM scored")
def _d5(spark, sf):
    return scored(spark, sf).select("txn_id", decisions.decision(F.col("score"), F.lit(0.95), F.lit(0.8)).alias("decision"))


@register("d6_prevalence_adjusted", f"{S}, g AS (SELECT rail, count(*) FILTER (score >= 0.9 AND y = 1) / count(*) FILTER (score >= 0.9) AS p, avg(y) AS o FROM scored GROUP BY rail), "
          f"k AS (SELECT rail, (p / (1 - p)) * ((1 - o) / o) * (0.0012 / 0.9988) AS odds FROM g) SELECT rail, {r('odds / (1 + odds)', 'precision')} FROM k")
def _d6(spark, sf):
    p = reports.at_threshold(scored(spark, sf), TH, by=["rail"])
    return p.select("rail", F.col("precision_at_real_prevalence").alias("precision"))


@register("d7_cost_optimal_threshold", f"{S}, {GRID_SQL}, {COST_SQL} SELECT {COST_COLS} FROM cc ORDER BY round(expected_cost, 2), threshold LIMIT 1")
def _d7(spark, sf):
    return _cost(curves.choose_threshold(curves.cost_curve(scored(spark, sf))))


@register("d8_budget_threshold", f"{S} SELECT {r('quantile_cont(score, 0.98)', 'threshold')} FROM scored")
def _d8(spark, sf):
    return curves.budget_threshold(scored(spark, sf))


@register("d9_expected_cost", f"{S} SELECT rail, {r('coalesce(sum(amount) FILTER (score < 0.9 AND y = 1), 0) * 0.72 + count(*) FILTER (score >= 0.9) * 55.0 + count(*) FILTER (score >= 0.9 AND y = 0) * 0.35 * 420.0', 'expected_cost', 2)} FROM scored GROUP BY rail")
def _d9(spark, sf):
    return cents(reports.at_threshold(scored(spark, sf), TH, by=["rail"]).select("rail", "expected_cost"))


@register("d10_daily_load", f"{S} SELECT rail, {r('round(count(*) FILTER (score >= 0.9) / 30)', 'daily')} FROM scored GROUP BY rail")
def _d10(spark, sf):
    df = reports.rail_report(scored(spark, sf), TH)
    return df.select("rail", decisions.daily_load(F.col("alert_rate"), F.col("n")).alias("daily"))


# Curves.

AUC = "sum(pos * ((an - ap) - (n - tp) + 0.5 * (rows - pos))) / max(ap * (an - ap))"


@register("v1_roc_auc", f"{S} SELECT {r('(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))', 'roc_auc')} "
          "FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)")
def _v1(spark, sf):
    return curves.ranking_metrics(curves.score_curve(scored(spark, sf))).select("roc_auc")


@register("v2_average_precision", f"{S}, {CURVE} SELECT {r('sum((tp / n) * (pos / ap))', 'pr_auc')} FROM cv")
def _v2(spark, sf):
    return curves.ranking_metrics(curves.score_curve(scored(spark, sf))).select("pr_auc")


@register("v3_brier", f"{S} SELECT {r('avg(power(y - score, 2))', 'brier')} FROM scored")
def _v3(spark, sf):
    return reports.brier(scored(spark, sf))


_SPACED = "(points + 1 <= 160 OR rk IN (SELECT CAST(floor(j * points / 159.0) AS BIGINT) FROM range(160) t(j), (SELECT max(points) AS points FROM cv)))"


@register("v4_roc_points", f"{S}, {CURVE}, p AS (SELECT rk, points, (n - tp) / (an - ap) AS x, tp / ap AS y FROM cv UNION ALL SELECT 0, max(points), 0, 0 FROM cv) SELECT {n('rk', 'rank')}, {r('x', 'x')}, {r('y', 'y')} FROM p WHERE {_SPACED}")
def _v4a(spark, sf):
    return curves.roc_points(curves.score_curve(scored(spark, sf)), 160)


@register("v4_pr_points", f"{S}, {CURVE}, p AS (SELECT rk, points, tp / ap AS x, tp / n AS y FROM cv UNION ALL SELECT 0, max(points), 0, 1 FROM cv) SELECT {n('rk', 'rank')}, {r('x', 'x')}, {r('y', 'y')} FROM p WHERE {_SPACED}")
def _v4b(spark, sf):
    return curves.pr_points(curves.score_curve(scored(spark, sf)), 160)


@register("v5_recall_at_fpr", f"{S}, {CURVE} SELECT t.fpr_target, {r('coalesce(max(tp / ap) FILTER ((n - tp) / (an - ap) <= t.fpr_target), 0)', 'recall')} FROM cv, (VALUES (0.001::DOUBLE), (0.005::DOUBLE), (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE)) t(fpr_target) GROUP BY 1")
def _v5(spark, sf):
    return curves.recall_at_fpr(curves.score_curve(scored(spark, sf)))


@register("v6_evaluation_summary", f"{S}, {CURVE} SELECT (SELECT {n('count(*)', 'a')} FROM scored) AS n_test, (SELECT {n('sum(y)', 'a')} FROM scored) AS n_test_fraud, (SELECT {r('avg(y)', 'a')} FROM scored) AS test_fraud_rate, "
          f"{r(AUC, 'roc_auc')}, {r('sum((tp / n) * (pos / ap))', 'pr_auc')}, (SELECT {r('avg(power(y - score, 2))', 'a')} FROM scored) AS brier FROM cv")
def _v6(spark, sf):
    return reports.evaluate(scored(spark, sf), holdout=T.HOLDOUT)["summary"]


@register("v6_operating_point", f"{S}, {BUDGET} " + confusion_sql("(SELECT threshold FROM th)"))
def _v6b(spark, sf):
    return cents(reports.evaluate(scored(spark, sf))["operating_point"])


@register("v8_before_after", f"{S} SELECT rail, {r('avg(CASE WHEN p_model >= 0.9 THEN 1.0 ELSE 0.0 END)', 'alert_rate_before')}, {r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END)', 'alert_rate_after')}, "
          f"{r('avg(CASE WHEN score >= 0.9 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN p_model >= 0.9 THEN 1.0 ELSE 0.0 END)', 'alert_rate_delta')} FROM scored GROUP BY rail")
def _v8(spark, sf):
    df = scored(spark, sf)
    before = reports.rail_report(df.withColumn("score", F.col("p_model")), TH)
    return reports.before_after(before, reports.rail_report(df, TH), ["rail"], ["alert_rate"])
