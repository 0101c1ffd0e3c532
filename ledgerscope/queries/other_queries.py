"""Ranking, catalogue, graph, feedback, quality, file and explanation queries."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import catalogue as CAT
from ..operators import decisions, explain, feedback, graph, quality, ranks, reports, requests
from ..session import ensure_checkpoint_dir, stored
from ..sources import files
from ..sources import tables as T
from .feature_queries import BASE_SQL, FEATURE_SQL, feature_table
from .registry import HALF, CUSTOMERS_SQL, EPISODES_SQL, FLOWS_SQL, LEDGER_SQL, SCORED_SQL, n, query, r
from .report_queries import SPLIT_SQL, cents, confusion_sql, register, scored, split_ledger

S = f"WITH {SCORED_SQL}"
HASH = "(txn_id * 7919 + 17) % 10007"


def shuffle():
    return F.expr(HASH)


# Sorts, limits, samples.

@register("k1_stable_order", f"{S} SELECT txn_id, {n('row_number() OVER (ORDER BY ts_us, txn_id)', 'place')} FROM scored")
def _k1(spark, sf):
    return ranks.place(scored(spark, sf)).select("txn_id", "place").orderBy("place")


@register("k2_temporal_split", f"WITH {LEDGER_SQL}, {SPLIT_SQL} SELECT txn_id, split FROM splits")
def _k2(spark, sf):
    return split_ledger(spark, sf).select("txn_id", "split")


@register("k2_temporal_split_with_ties", "WITH " + SCORED_SQL.replace("scored AS", "ledger AS", 1) + f", {SPLIT_SQL} SELECT txn_id, split FROM splits")
def _k2b(spark, sf):
    return ranks.temporal_split(scored(spark, sf)).select("txn_id", "split")


@register("k3_ledger_tail", f"WITH {LEDGER_SQL} SELECT txn_id FROM (SELECT txn_id, row_number() OVER (ORDER BY ts_us, txn_id) - 1 AS i, count(*) OVER () AS total FROM ledger) WHERE i >= CAST(floor(total * (1 - 0.38)) AS BIGINT)")
def _k3(spark, sf):
    return ranks.tail_fraction(T.ledger(spark, sf).withColumn("ts_us", F.unix_micros("ts")), 0.38).select("txn_id")


@register("k4_top_k", f"{S} SELECT txn_id, {r('score', 'score')} FROM scored ORDER BY score DESC, txn_id LIMIT 100")
def _k4(spark, sf):
    return ranks.top_k(scored(spark, sf), 100, "score").select("txn_id", "score")


@register("k5_best_per_group", f"{S} SELECT vector_id, txn_id, {r('amount', 'amount', 2)} FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY amount DESC, txn_id) AS i FROM scored WHERE vector_id IS NOT NULL) WHERE i = 1")
def _k5(spark, sf):
    df = scored(spark, sf).filter("vector_id IS NOT NULL").select("vector_id", "txn_id", "amount")
    return ranks.best_per_group(df, ["vector_id"], "amount")


@register("k6_review_slice", f"{S}, f AS (SELECT * FROM scored WHERE y = 1 ORDER BY {HASH}, txn_id LIMIT 70), t AS (SELECT * FROM scored WHERE y = 0 ORDER BY score DESC, txn_id LIMIT 44), "
          f"z AS (SELECT * FROM scored WHERE y = 0 ORDER BY {HASH}, txn_id LIMIT 106) SELECT DISTINCT txn_id, y FROM (SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT * FROM z)")
def _k6(spark, sf):
    return ranks.review_slice(scored(spark, sf), shuffle=shuffle()).select("txn_id", "y")


@register("k7_keep_positives", f"{S}, p AS (SELECT count(*) AS c FROM scored WHERE y = 1) SELECT txn_id, y FROM scored WHERE y = 1 UNION ALL SELECT txn_id, y FROM (SELECT *, row_number() OVER (ORDER BY {HASH}, txn_id) AS i FROM scored WHERE y = 0) WHERE i <= greatest(0, 9000 - (SELECT c FROM p))")
def _k7(spark, sf):
    return ranks.keep_positives(scored(spark, sf), 9000, shuffle=shuffle()).select("txn_id", "y")


@register("k8_cap_per_group", f"{S} SELECT rail, txn_id FROM (SELECT *, row_number() OVER (PARTITION BY rail ORDER BY {HASH}, txn_id) AS i FROM scored) WHERE i <= 40")
def _k8(spark, sf):
    return ranks.cap_per_group(scored(spark, sf), ["rail"], 40, shuffle()).select("rail", "txn_id")


@register("k8_cap_overall", f"{S} SELECT txn_id FROM scored WHERE score < 0.9 ORDER BY {HASH}, txn_id LIMIT 2200")
def _k8b(spark, sf):
    return ranks.cap_rows(scored(spark, sf).filter("score < 0.9"), 2200, shuffle()).select("txn_id")


@register("k9_every_third_point", f"{S}, c AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS rk FROM (SELECT DISTINCT score FROM scored)) SELECT {n('rk', 'rank')}, {r('score', 'score')} FROM c WHERE (rk - 1) % 3 = 0")
def _k9(spark, sf):
    from ..operators import curves

    return curves.score_curve(scored(spark, sf)).filter("(rank - 1) % 3 = 0").select("rank", "score")


@register("k11_earliest_per_campaign", f"WITH {FLOWS_SQL} SELECT campaign_id, order_id, layer, dst, {r('amount', 'amount', 2)} FROM (SELECT DISTINCT campaign_id, order_id, layer, dst, amount, ts_us FROM flows) QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY ts_us, order_id, layer, dst, amount) <= 20")
def _k11(spark, sf):
    return earliest_per_campaign(T.flows(spark, sf).select("campaign_id", "order_id", "layer", "dst", "amount", "ts_us"), 20)


def earliest_per_campaign(f, k):
    """The ``k`` first different flows of every campaign, by time."""
    from pyspark.sql import Window

    order = ["ts_us", "order_id", "layer", "dst", "amount"]
    # Each day of a campaign has a flow, so its first k days hold its first k flows; only those are compared.
    # One row a campaign travels to the tasks.
    days = f.select(F.col("campaign_id").alias("c"), F.floor(F.col("ts_us") / F.lit(K.DAY_US)).alias("day")).groupBy("c", "day").agg(F.count(F.lit(1)))
    by_day = Window.partitionBy("c").orderBy("day")
    last = days.withColumn("i", F.row_number().over(by_day)).filter(F.col("i") == k).select("c", ((F.col("day") + 1) * K.DAY_US).alias("end"))
    near = f.join(F.broadcast(last), F.col("campaign_id").eqNullSafe(F.col("c")), "left")
    near = near.filter("end IS NULL OR ts_us IS NULL OR ts_us < end").drop("c", "end").distinct()
    # Salted parts are ranked first, so a campaign of any size is split up.
    part = Window.partitionBy("campaign_id", F.pmod("order_id", F.lit(16))).orderBy(*order)
    whole = Window.partitionBy("campaign_id").orderBy(*order)
    near = near.withColumn("i", F.row_number().over(part)).filter(F.col("i") <= k)
    return near.withColumn("i", F.row_number().over(whole)).filter(F.col("i") <= k).drop("i", "ts_us")


# Set operations.

@register("s1_union_ledgers", f"WITH {LEDGER_SQL} SELECT txn_id, source FROM (SELECT txn_id, ts_us, 'base' AS source FROM ledger WHERE is_fraud = 0 UNION ALL SELECT txn_id, ts_us, 'added' FROM ledger WHERE is_fraud = 1)")
def _s1(spark, sf):
    led = T.ledger(spark, sf)
    base = led.filter("is_fraud = 0").withColumn("source", F.lit("base"))
    return base.unionByName(led.filter("is_fraud = 1").withColumn("source", F.lit("added"))).orderBy("ts", "txn_id").select("txn_id", "source")


@register("s2_weighted_union", f"{S} SELECT txn_id, CASE WHEN y = 1 THEN 6e0 ELSE 1e0 END AS weight FROM scored UNION ALL SELECT txn_id, 18e0 FROM (SELECT txn_id FROM scored WHERE y = 1 AND score < 0.5 ORDER BY {HASH}, txn_id LIMIT 2200)")
def _s2(spark, sf):
    df = scored(spark, sf)
    mined = feedback.mine_evasions(df.filter("y = 1"), 0.5, shuffle=shuffle())
    return feedback.training_set(df, mined).select("txn_id", "weight")


@register("s3_array_union", f"SELECT p_partkey AS id, p_brand || '|' || p_type || '|x|y|' || p_brand || '!' AS merged FROM part")
def _s3(spark, sf):
    a = F.array("p_brand", "p_type", F.lit("x"))
    b = F.array("p_type", F.lit("y"), F.concat("p_brand", F.lit("!")))
    return T.read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_union(a, b), "|").alias("merged"))


@register("s4_array_tests", "SELECT p_partkey AS id, p_brand = 'Brand#2' OR p_type = 'ECONOMY' AS overlaps, "
          "CAST(CASE WHEN p_brand <> 'Brand#2' THEN 1 ELSE 0 END + CASE WHEN p_type <> 'ECONOMY' THEN 1 ELSE 0 END AS INTEGER) AS extra FROM part")
def _s4(spark, sf):
    a, b = F.array("p_brand", "p_type"), F.array(F.lit("Brand#2"), F.lit("ECONOMY"))
    return T.read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.arrays_overlap(a, b).alias("overlaps"), F.size(F.array_except(a, b)).alias("extra"))


@register("s5_distinct_values", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _s5(spark, sf):
    return T.read(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


# Rules and reasons.

X_CANDIDATES = ["amount_to_p95", "is_new_device", "device_customer_count", "amount_to_mandate_ceiling", "merchant_is_liquid"]

FEATS = "feat AS (SELECT txn_id, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in FEATURE_SQL.items() if c != "amount") + ", amount FROM j)"
RULE_SQL = [
    ("R-COERCION-01", 0.88, "screen_share > 0 AND is_new_beneficiary > 0 AND amount_to_p95 > 3"),
    ("R-COERCION-02", 0.82, "call_active > 0 AND is_new_beneficiary > 0 AND benef_age_days < 7 AND amount_to_p95 > 5"),
    ("R-MULE-01", 0.85, "benef_dwell_secs < 300 AND benef_passthrough_ratio > 0.75 AND benef_age_days < 30"),
    ("R-MULE-02", 0.80, "benef_distinct_payers_24h >= 8 AND benef_age_days < 15"),
    ("R-MULE-03", 0.78, "sender_dwell_secs < 900 AND sender_passthrough_ratio > 0.8 AND customer_account_age_days < 60"),
    ("R-TESTING-01", 0.86, "device_customer_count >= 8 AND amount < 250"),
    ("R-TAKEOVER-01", 0.72, "travel_speed_kmh > 900 AND dist_from_last_km > 400"),
    ("R-TAKEOVER-02", 0.80, "is_new_device > 0 AND (device_is_emulator > 0 OR device_attested < 1) AND amount_to_p95 > 4"),
    ("R-TOKEN-01", 0.83, "instrument_age_days < 0.042 AND amount_to_p95 > 2.5"),
    ("R-CLONE-01", 0.74, "typing_variance_ratio < 0.25 AND form_corrections < 1 AND is_new_merchant > 0"),
    ("R-AGENT-01", 0.84, "is_agentic > 0 AND mandate_intent_match < 1 AND amount_to_mandate_ceiling > 0.7"),
    ("R-AGENT-02", 0.80, "is_agentic > 0 AND mandate_ceiling_to_typical > 20 AND human_confirmations < 1 AND mandate_drawdown_ratio > 0.5"),
    ("R-MERCHANT-01", 0.70, "merchant_age_days < 30 AND merchant_repeat_rate < 0.05 AND merchant_distinct_customers > 6 AND amount_to_merchant_mean > 1.6"),
    ("R-DISPUTE-01", 0.68, "cust_prior_disputes_90d >= 3 AND merchant_is_liquid + amount_to_p95 > 2"),
]
RULE_SCORE = "greatest(0.0, " + ", ".join(f"CASE WHEN {p} THEN {c} ELSE 0.0 END" for _, c, p in RULE_SQL) + ")"
FIRED = "concat_ws(',', " + ", ".join(f"CASE WHEN {p} THEN '{code}' END" for code, _, p in RULE_SQL) + ")"


def _rule_inputs() -> set[str]:
    seen: set[str] = set()

    def note(name):
        seen.add(name)
        return F.lit(0.0)

    for rule in decisions.RULES:
        rule.predicate(note)
    return seen


def rule_features(spark, sf):
    """Only the features that rules look at."""
    need = sorted({*X_CANDIDATES, *_rule_inputs()})
    return feature_table(spark, sf, columns=need).select("txn_id", *need)


@register("d1_rule_layer", f"{BASE_SQL}, {FEATS} SELECT txn_id, {r(RULE_SCORE, 'rule_score')}, {FIRED} AS fired FROM feat")
def _d1(spark, sf):
    return decisions.apply_rules(rule_features(spark, sf)).select("txn_id", "rule_score", F.concat_ws(",", "fired").alias("fired"))


@register("d2_rule_fire_by_code", f"{BASE_SQL}, {FEATS} " + " UNION ALL ".join(f"SELECT '{code}' AS code, CAST({c} AS DOUBLE) AS confidence, CAST(count(*) FILTER ({p}) AS BIGINT) AS fired FROM feat" for code, c, p in RULE_SQL))
def _d2(spark, sf):
    hits = reports.rules_fired(decisions.apply_rules(rule_features(spark, sf)))
    return decisions.rule_catalogue(spark).join(hits, "code", "left").select(
        "code", "confidence", F.coalesce("n", F.lit(0)).alias("fired"))


_X_LOGIT = lambda e: f"ln(greatest(1e-6, least(1 - 1e-6, {e})) / (1 - greatest(1e-6, least(1 - 1e-6, {e}))))"


def _x_sql(candidates: list[str]) -> str:
    med = "med AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in candidates) + " FROM feat)"
    swap = ", ".join(f"CASE WHEN candidate = '{c}' THEN m_{c} ELSE {c} END AS {c}" for c in candidates)
    return (
        f"{BASE_SQL}, {FEATS}, {med}, base AS (SELECT *, CAST({RULE_SCORE} AS DOUBLE) AS s0 FROM feat), "
        f"abl AS (SELECT txn_id, s0, candidate, CAST({RULE_SCORE} AS DOUBLE) AS s1 FROM (SELECT base.* REPLACE ({swap}), candidate FROM base, med, "
        "(VALUES " + ", ".join(f"('{c}')" for c in candidates) + ") t(candidate))), "
        f"d AS (SELECT txn_id, candidate, {_X_LOGIT('s0')} - {_X_LOGIT('s1')} AS drop FROM abl), "
        "rk AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY round(drop, 9) DESC, candidate) AS i FROM d WHERE drop > 0.08) "
        f"SELECT b.txn_id, {r('b.s0', 'base_score')}, coalesce(string_agg(rk.candidate, ',' ORDER BY i) FILTER (i <= 4), '') AS reasons FROM base b LEFT JOIN rk ON b.txn_id = rk.txn_id GROUP BY b.txn_id, b.s0"
    )


def rule_reasons(df, candidates):
    """Reasons of the rule score over a table with the features that rules look at."""
    meds = requests.median_row(reports.column_medians(df, candidates), candidates)
    out = explain.explain(df, decisions.RuleScorer(), meds, candidates, k=4)
    return out.select("txn_id", "base_score", F.coalesce(F.array_join(F.transform("reasons", lambda x: x["feature"]), ","), F.lit("")).alias("reasons"))


@register("x1_reason_codes", _x_sql(X_CANDIDATES))
def _x1(spark, sf):
    df = stored(rule_features(spark, sf), "features")  # medians and scores read it, features are made once
    return rule_reasons(df, X_CANDIDATES)


#: Every feature a rule looks at.
X_ALL = sorted({c for _, _, p in RULE_SQL for c in re.findall("[a-z][a-z0-9_]+", p)})


@register("x1_reason_codes_all_inputs", _x_sql(X_ALL))
def _x1_all(spark, sf):
    return rule_reasons(stored(rule_features(spark, sf), "features"), X_ALL)


@register("x4_case_files", f"{S} SELECT vector_id, txn_id, {r('amount', 'amount', 2)}, {n('fn', 'family_n')}, {r('fm', 'family_median_score')} FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY amount DESC, txn_id) AS i, "
          "count(*) OVER (PARTITION BY vector_id) AS fn, median(score) OVER (PARTITION BY vector_id) AS fm FROM scored WHERE vector_id IS NOT NULL) WHERE i = 1")
def _x4(spark, sf):
    df = scored(spark, sf)
    none = df.select("txn_id", F.array().cast("array<string>").alias("reasons"))
    return explain.case_files(df, none).select("vector_id", "txn_id", "amount", "family_n", "family_median_score")


CASE_SQL = (
    f"x AS ({_x_sql(X_CANDIDATES)}), t AS (WITH {LEDGER_SQL} SELECT txn_id, vector_id, amount, narrative_id FROM ledger WHERE vector_id IS NOT NULL), "
    "joint AS (SELECT t.*, x.base_score, x.reasons, row_number() OVER (PARTITION BY vector_id ORDER BY amount DESC, t.txn_id) AS i, count(*) OVER (PARTITION BY vector_id) AS fn, "
    "median(base_score) OVER (PARTITION BY vector_id) AS fm FROM t JOIN x ON t.txn_id = x.txn_id), "
    "talk AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said, CASE WHEN conv_id % 3 = 0 THEN 'coercion' ELSE 'benign' END AS kind FROM conversations GROUP BY conv_id)")


@register("x4_case_files_with_reasons", f"WITH {CASE_SQL} SELECT vector_id, txn_id, {r('amount', 'amount', 2)}, {r('base_score', 'base_score')}, reasons, {n('fn', 'family_n')}, {r('fm', 'family_median_score')}, talk.kind AS episode_kind, said "
          "FROM joint LEFT JOIN talk ON narrative_id = conv_id WHERE i = 1")
def _x4_full(spark, sf):
    """The case file as an analyst gets it: the payment, why it scored, its family, and what was said."""
    told = rule_reasons(stored(rule_features(spark, sf), "features"), X_CANDIDATES)
    scored_ = T.ledger(spark, sf).select("txn_id", "vector_id", "amount", "narrative_id").join(told.select("txn_id", F.col("base_score").alias("score")), "txn_id")
    files_ = explain.case_files(scored_, told, T.episodes(spark, sf))
    said = F.array_join(F.transform("episode.turns", lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n")
    return files_.select("vector_id", "txn_id", "amount", "base_score", "reasons", "family_n", "family_median_score", F.col("episode.kind").alias("episode_kind"), said.alias("said"))


# Requests.

REQ_FEATURES = ["amount", "log_amount", "is_new_beneficiary", "screen_share", "screen_share_and_new_benef", "coercion_score", "has_episode", "cat_rail"]


@register("p9_what_if_requests", "WITH req AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount, CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'upi_p2m' WHEN 1 THEN 'card_cp' ELSE 'nope' END END AS rail, "
          "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 2 AS DOUBLE) END AS is_new_beneficiary, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS screen_share, CASE WHEN o_orderkey % 6 = 1 THEN (o_orderkey % 5) / 5e0 END AS coercion_score FROM orders), "
          "b AS (SELECT l_extendedprice AS amount, ln(1 + l_extendedprice) AS log_amount, CAST(l_linenumber % 2 AS DOUBLE) AS is_new_beneficiary, CAST(l_linenumber % 3 AS DOUBLE) AS screen_share, CAST((l_linenumber % 2) * (l_linenumber % 3) AS DOUBLE) AS ssnb, l_discount AS coercion_score, 1.0 AS has_episode, CAST(l_linenumber AS DOUBLE) AS cat_rail FROM lineitem), "
          "m AS (SELECT median(amount) AS amount, median(log_amount) AS log_amount, median(is_new_beneficiary) AS nb, median(screen_share) AS ss, median(ssnb) AS ssnb, median(coercion_score) AS cs, median(has_episode) AS he, median(cat_rail) AS cr FROM b) "
          f"SELECT request_id, {r('coalesce(req.amount, m.amount)', 'amount', 2)}, {r('coalesce(ln(1 + req.amount), m.log_amount)', 'log_amount')}, {r('coalesce(is_new_beneficiary, nb)', 'is_new_beneficiary')}, {r('coalesce(screen_share, ss)', 'screen_share')}, "
          f"{r('coalesce(screen_share * is_new_beneficiary, ssnb)', 'screen_share_and_new_benef')}, {r('coalesce(coercion_score, cs)', 'coercion_score')}, {r('coalesce(CASE WHEN coercion_score > 0 THEN 1 WHEN coercion_score IS NOT NULL THEN 0 END, he)', 'has_episode')}, "
          + r("coalesce(CASE rail WHEN 'upi_p2m' THEN 0 WHEN 'card_cp' THEN 3 WHEN 'nope' THEN -1 END, cr)", "cat_rail") + " FROM req, m")
def _p9(spark, sf):
    req = T.read(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_id", "CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS amount",
        "CASE WHEN o_orderkey % 4 <> 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'upi_p2m' WHEN 1 THEN 'card_cp' ELSE 'nope' END END AS rail",
        "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 2 AS DOUBLE) END AS is_new_beneficiary",
        "CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey % 3 AS DOUBLE) END AS screen_share",
        "CASE WHEN o_orderkey % 6 = 1 THEN (o_orderkey % 5) / 5e0 END AS coercion_score")
    pop = T.read(spark, sf, "lineitem").selectExpr(
        "l_extendedprice AS amount", "log1p(l_extendedprice) AS log_amount", "l_linenumber % 2 AS is_new_beneficiary",
        "l_linenumber % 3 AS screen_share", "(l_linenumber % 2) * (l_linenumber % 3) AS screen_share_and_new_benef",
        "l_discount AS coercion_score", "1 AS has_episode", "l_linenumber AS cat_rail")
    meds = requests.median_row(reports.column_medians(pop, REQ_FEATURES), REQ_FEATURES)
    return cents(requests.fill_requests(req, meds, REQ_FEATURES), ("amount",))


# Catalogue: one entry per (brand, type) of the part table.

CAT_SQL = (
    "g AS (SELECT p_brand || '/' || p_type AS id, p_brand AS family, p_type, count(*) AS c, sum(p_size) AS s FROM part GROUP BY p_brand, p_type), "
    "cat AS (SELECT id, 'Entry ' || id AS name, family, CASE s % 6 WHEN 0 THEN 'model' WHEN 1 THEN 'onboarding' WHEN 2 THEN 'authentication' WHEN 3 THEN 'authorisation' WHEN 4 THEN 'settlement' ELSE 'dispute' END AS surface, "
    "s % 2 = 0 AS r1, s % 3 = 0 AS r2, c % 2 = 0 AS r3, 1 + s % 5 AS genai_uplift, 1 + c % 5 AS detection_gap, 1 + (s + c) % 5 AS impact, 1 + (s // 5) % 5 AS feasibility, 1 + (s // 7) % 5 AS scale_velocity, "
    "CASE WHEN c % 3 = 0 THEN 'simulated' ELSE 'documented' END AS status, 'About ' || p_type AS summary, 'signal ' || CAST(s AS VARCHAR) AS signal FROM g), "
    "sc AS (SELECT *, round((0.30 * detection_gap + 0.24 * genai_uplift + 0.20 * impact + 0.15 * scale_velocity + 0.11 * feasibility) / 5.0 * 100.0, 1) AS ts FROM cat), "
    "ts AS (SELECT *, CASE WHEN ts >= 82 THEN 'critical' WHEN ts >= 70 THEN 'high' WHEN ts >= 56 THEN 'medium' ELSE 'watch' END AS priority FROM sc)"
)


def cat(spark, sf):
    g = T.read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("c"), F.sum("p_size").alias("s"))
    return g.selectExpr(
        "concat(p_brand, '/', p_type) AS id", "concat('Entry ', p_brand, '/', p_type) AS name", "p_brand AS family",
        "array_compact(array(CASE WHEN s % 2 = 0 THEN 'upi_p2p' END, CASE WHEN s % 3 = 0 THEN 'card_cnp' END, CASE WHEN c % 2 = 0 THEN 'wallet' END)) AS rails",
        "element_at(array('model', 'onboarding', 'authentication', 'authorisation', 'settlement', 'dispute'), CAST(s % 6 + 1 AS INT)) AS surface",
        "concat('About ', p_type) AS summary", "CAST(1 + s % 5 AS INT) AS genai_uplift", "CAST(1 + c % 5 AS INT) AS detection_gap",
        "CAST(1 + (s + c) % 5 AS INT) AS impact", "CAST(1 + floor(s / 5) % 5 AS INT) AS feasibility", "CAST(1 + floor(s / 7) % 5 AS INT) AS scale_velocity",
        "array('start', concat('act ', p_type), 'end') AS kill_chain", "array(concat('signal ', CAST(s AS STRING))) AS observable_signals",
        "array('check') AS mitigations", "CASE WHEN c % 3 = 0 THEN 'simulated' ELSE 'documented' END AS status",
        "CAST(NULL AS STRING) AS injector", "CAST(array() AS ARRAY<STRING>) AS parents")


@register("c1_threat_score", f"WITH {CAT_SQL} SELECT id, {r('ts', 'threat_score', 1)} FROM ts")
def _c1(spark, sf):
    return CAT.with_scores(cat(spark, sf)).select("id", "threat_score")


@register("c2_priority", f"WITH {CAT_SQL} SELECT id, priority FROM ts")
def _c2(spark, sf):
    return CAT.with_scores(cat(spark, sf)).select("id", "priority")


@register("a5_catalogue_summary", f"WITH {CAT_SQL}, x AS (SELECT 'family' AS axis, family AS value, ts FROM ts UNION ALL SELECT 'surface', surface, ts FROM ts UNION ALL SELECT 'priority', priority, ts FROM ts UNION ALL SELECT 'status', status, ts FROM ts UNION ALL SELECT 'all', 'all', ts FROM ts "
          f"UNION ALL SELECT 'rail', 'upi_p2p', ts FROM ts WHERE r1 UNION ALL SELECT 'rail', 'card_cnp', ts FROM ts WHERE r2 UNION ALL SELECT 'rail', 'wallet', ts FROM ts WHERE r3) SELECT axis, value, {n('count(*)', 'n')}, {r('avg(ts)', 'mean_threat_score', 4)} FROM x GROUP BY axis, value")
def _a5(spark, sf):
    df = CAT.with_scores(cat(spark, sf))
    out = CAT.summary(cat(spark, sf)).drop("mean_threat_score")
    one = lambda axis, c: F.struct(F.lit(axis).alias("axis"), c.alias("value"))
    axes = F.concat(F.array(*[one(c, F.col(c)) for c in ("family", "surface", "priority", "status")], one("all", F.lit("all"))),
                    F.transform("rails", lambda x: one("rail", x)))
    mean = df.select("threat_score", F.explode(axes).alias("a")).groupBy("a.axis", "a.value").agg(F.avg("threat_score").alias("m"))
    return out.join(mean, ["axis", "value"]).select("axis", "value", "n", _floor_col("m", 4).alias("mean_threat_score"))


def _floor_col(name, places):
    return F.floor(F.col(name) * 10**places + HALF) / 10**places


@register("p10_catalogue_filter", f"WITH {CAT_SQL} SELECT id FROM ts WHERE r1 AND status = 'documented' AND contains(lower(name || id || summary || signal), 'brand#1')")
def _p10(spark, sf):
    return CAT.search(cat(spark, sf), text=" BRAND#1", rail="upi_p2p", status="documented").select("id")


@register("k12_multi_key_order", f"WITH {CAT_SQL} SELECT id, {n('detection_gap', 'gap')}, {r('ts', 'threat_score', 1)} FROM ts ORDER BY detection_gap DESC, ts DESC, id")
def _k12(spark, sf):
    df = CAT.ordered(CAT.with_scores(cat(spark, sf)), "detection_gap")
    return df.select("id", F.col("detection_gap").cast("long").alias("gap"), "threat_score")


PAIR_SQL = (
    "chains(s, t) AS (VALUES ('model','authorisation'), ('model','authentication'), ('model','settlement'), ('onboarding','settlement'), ('onboarding','authorisation'), ('authentication','authorisation'), "
    "('authorisation','settlement'), ('authorisation','dispute'), ('settlement','dispute')), "
    "pairs AS (SELECT a.id AS a_id, b.id AS b_id, a.ts AS ats, b.ts AS bts, a.family AS af, b.family AS bf, a.surface AS asf, b.surface AS bsf, (a.r1 AND b.r1) OR (a.r2 AND b.r2) OR (a.r3 AND b.r3) AS shared, "
    "greatest(a.genai_uplift, b.genai_uplift) AS gu, greatest(a.detection_gap, b.detection_gap) AS dg, greatest(a.impact, b.impact) AS ih, least(a.impact, b.impact) AS il, least(a.feasibility, b.feasibility) AS fl, least(a.scale_velocity, b.scale_velocity) AS vl "
    "FROM ts a JOIN chains c ON a.surface = c.s JOIN ts b ON b.surface = c.t AND a.id <> b.id WHERE a.family <> b.family OR (a.r1 AND NOT b.r1) OR (a.r2 AND NOT b.r2) OR (a.r3 AND NOT b.r3)), "
    "bon AS (SELECT *, least(1.0, CASE WHEN af <> bf THEN 0.35 ELSE 0 END + CASE WHEN NOT shared THEN 0.45 ELSE 0 END + CASE WHEN asf <> bsf THEN 0.25 ELSE 0 END + CASE WHEN asf = 'model' OR bsf = 'model' THEN 0.3 ELSE 0 END) AS bonus FROM pairs)"
)


@register("j8_chain_pairs", f"WITH {CAT_SQL}, {PAIR_SQL} SELECT a_id, b_id FROM bon")
def _j8(spark, sf):
    return CAT.pair_candidates(cat(spark, sf)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))


@register("c3_seam_bonus", f"WITH {CAT_SQL}, {PAIR_SQL} SELECT a_id, b_id, {r('bonus', 'bonus')} FROM bon")
def _c3(spark, sf):
    return CAT.pair_candidates(cat(spark, sf)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "bonus")


@register("c4_pair_prescore", f"WITH {CAT_SQL}, {PAIR_SQL} SELECT a_id, b_id, {r('0.5 * (ats + bts) / 100.0 + 0.6 * bonus', 'pre_score')} FROM bon")
def _c4(spark, sf):
    return CAT.pair_candidates(cat(spark, sf)).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "pre_score")


def _clip_sql(e):
    return f"CAST(least(5, greatest(1, round_even({e}, 0))) AS BIGINT)"


@register("c5_compose_scales", f"WITH {CAT_SQL}, {PAIR_SQL} SELECT a_id, b_id, {_clip_sql('gu')} AS genai_uplift, {_clip_sql('dg + bonus')} AS detection_gap, {_clip_sql('ih + 0.4 * il / 5.0 * 2')} AS impact, {_clip_sql('fl - 0.8')} AS feasibility, {_clip_sql('vl - 0.3')} AS scale_velocity FROM bon")
def _c5(spark, sf):
    pairs = CAT.pair_candidates(cat(spark, sf)).withColumn("pick", F.lit(1))
    return CAT.composed_scales(pairs).select(
        F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"),
        *[F.col(c).cast("long").alias(c) for c in ("genai_uplift", "detection_gap", "impact", "feasibility", "scale_velocity")])


@query("c6_compose_records")
def _c6(spark, sf):
    return CAT.compose_pairs(cat(spark, sf), 10)


def _greedy_sql(k: int = 10, cap: int = 2) -> str:
    """The walk over all pairs, one step a pick: the best pair not picked whose parents are picked less than ``cap`` times."""
    steps = ["o AS MATERIALIZED (SELECT a_id, b_id, 0.5 * (ats + bts) / 100.0 + 0.6 * bonus AS pre_score FROM bon)"]
    for i in range(1, k + 1):
        before = " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, i))
        if i == 1:
            steps.append("p1 AS MATERIALIZED (SELECT 1 AS pick, * FROM o ORDER BY pre_score DESC, a_id, b_id LIMIT 1)")
            continue
        steps.append(
            f"u{i} AS MATERIALIZED ({before}), f{i} AS MATERIALIZED (SELECT id FROM (SELECT a_id AS id FROM u{i} UNION ALL SELECT b_id FROM u{i}) GROUP BY id HAVING count(*) >= {cap}), "
            f"p{i} AS MATERIALIZED (SELECT {i} AS pick, * FROM o WHERE a_id NOT IN (SELECT id FROM f{i}) AND b_id NOT IN (SELECT id FROM f{i}) "
            f"AND (a_id, b_id) NOT IN (SELECT (a_id, b_id) FROM u{i}) ORDER BY pre_score DESC, a_id, b_id LIMIT 1)")
    return ", ".join(steps) + ", picks AS (" + " UNION ALL ".join(f"SELECT * FROM p{j}" for j in range(1, k + 1)) + ")"


@register("c7_k10_select_pairs", f"WITH {CAT_SQL}, {PAIR_SQL}, {_greedy_sql()} SELECT a_id, b_id, CAST(pick AS INT) AS pick, {r('pre_score', 'pre_score')} FROM picks")
def _c7(spark, sf):
    picked = CAT.select_pairs(CAT.pair_candidates(cat(spark, sf)), 10)
    return picked.select("a_id", "b_id", "pick", "pre_score")


@register("c8_coverage_check", f"WITH {CAT_SQL}, w AS (SELECT id FROM ts WHERE status = 'simulated'), h AS (SELECT DISTINCT p_brand || '/' || p_type AS id FROM part WHERE p_retailprice > 1000) "
          "SELECT coalesce(w.id, h.id) AS id, CASE WHEN w.id IS NULL THEN 'unmarked' ELSE 'unimplemented' END AS problem FROM w FULL OUTER JOIN h ON w.id = h.id WHERE w.id IS NULL OR h.id IS NULL")
def _c8(spark, sf):
    have = T.read(spark, sf, "part").filter("p_retailprice > 1000").select(F.concat("p_brand", F.lit("/"), "p_type").alias("id"))
    return CAT.coverage(cat(spark, sf), have)


# Graph.

ACCOUNTS_SQL = ("accounts AS (SELECT s_suppkey AS account_id, 'bank' || CAST(s_nationkey AS VARCHAR) AS bank, s_acctbal / 10 AS age_days, s_suppkey % 5 = 0 AS is_mule, CAST(s_suppkey % 3 AS INTEGER) AS mule_layer FROM supplier)")
BIG_SQL = ("edge AS (SELECT DISTINCT src, dst, ts_us, amount, layer, campaign_id, order_id FROM flows), big AS (SELECT campaign_id FROM edge GROUP BY 1 ORDER BY count(*) DESC, campaign_id LIMIT 1), "
           "best AS (SELECT * FROM edge WHERE campaign_id = (SELECT campaign_id FROM big)), "
           "deg AS (SELECT id, sum(i) AS din, sum(o) AS dout FROM (SELECT src AS id, 0 AS i, 1 AS o FROM best UNION ALL SELECT dst, 1, 0 FROM best) GROUP BY id)")


def edges(spark, sf):
    return T.flows(spark, sf).select("src", "dst", "ts_us", "amount", "layer", "campaign_id", "order_id").distinct()


def accounts(spark, sf):
    return T.read(spark, sf, "supplier").selectExpr(
        "s_suppkey AS account_id", "concat('bank', s_nationkey) AS bank", "s_acctbal / 10 AS age_days", "s_suppkey % 5 = 0 AS is_mule",
        "CAST(s_suppkey % 3 AS INT) AS mule_layer")


EDGE_ORDER = ["ts_us", "order_id", "layer", "dst", "amount"]


@register("g1_largest_campaign", f"WITH {FLOWS_SQL}, {BIG_SQL} SELECT src, dst, order_id, {r('amount', 'amount', 2)}, layer FROM best")
def _g1(spark, sf):
    best = graph.largest_campaign(edges(spark, sf), accounts(spark, sf), order=EDGE_ORDER)[1]
    return best.select("src", "dst", "order_id", _floor_col("amount", 2).alias("amount"), "layer")


@register("g2_degrees", f"WITH {FLOWS_SQL} SELECT id, {n('sum(i)', 'in_degree')}, {n('sum(o)', 'out_degree')} FROM (SELECT src AS id, 0 AS i, 1 AS o FROM flows UNION ALL SELECT dst, 1, 0 FROM flows) GROUP BY id")
def _g2(spark, sf):
    return graph.degrees(T.flows(spark, sf))


@register("g3_node_table", f"WITH {FLOWS_SQL}, {BIG_SQL}, {ACCOUNTS_SQL} SELECT id, CASE WHEN length(CAST(id AS VARCHAR)) > 4 THEN substr(CAST(id AS VARCHAR), 1, 2) || '…' || right(CAST(id AS VARCHAR), 4) ELSE CAST(id AS VARCHAR) END AS label, "
          f"coalesce(bank, '?') AS bank, {r('age_days', 'age_days', 1)}, coalesce(is_mule, false) AS is_mule, coalesce(mule_layer, 0) AS layer, {n('din', 'in_degree')}, {n('dout', 'out_degree')} FROM deg LEFT JOIN accounts ON id = account_id")
def _g3(spark, sf):
    nodes = graph.largest_campaign(edges(spark, sf), accounts(spark, sf).withColumn("age_days", _floor_col("age_days", 1)), order=EDGE_ORDER)[0]
    return nodes


@register("g4_edges_by_layer", f"WITH {FLOWS_SQL} SELECT layer, {n('count(*)', 'edges')}, {r('sum(amount)', 'amount', 2)} FROM flows GROUP BY layer")
def _g4(spark, sf):
    return cents(graph.edges_by_layer(T.flows(spark, sf)), ("amount",))


@register("g5_account_activity", f"WITH {FLOWS_SQL}, e AS (SELECT dst AS id, src AS other, 1 AS inn, amount FROM flows UNION ALL SELECT src, dst, 0, amount FROM flows), "
          f"t AS (SELECT id, count(DISTINCT other) FILTER (inn = 1) AS payers, count(DISTINCT other) FILTER (inn = 0) AS payees, coalesce(sum(amount) FILTER (inn = 1), 0) AS ai, coalesce(sum(amount) FILTER (inn = 0), 0) AS ao FROM e GROUP BY id) "
          f"SELECT id, {n('payers', 'payers')}, {n('payees', 'payees')}, {r('ai', 'amount_in', 2)}, {r('ao', 'amount_out', 2)}, {r('CASE WHEN ai > 1 THEN ao / ai ELSE 0 END', 'passthrough')} FROM t")
def _g5(spark, sf):
    return cents(graph.account_activity(T.flows(spark, sf)), ("amount_in", "amount_out"))


@register("g6_edges_from_ledger", f"WITH {LEDGER_SQL}, {CUSTOMERS_SQL} SELECT txn_id, self_account AS src, beneficiary_id AS dst, {r('amount', 'amount')} FROM ledger l JOIN customers c ON l.customer_id = c.customer_id WHERE self_account IS NOT NULL AND beneficiary_id IS NOT NULL")
def _g6(spark, sf):
    led = T.ledger(spark, sf).withColumn("ts_us", F.unix_micros("ts"))
    return graph.ledger_edges(led, T.customers(spark, sf)).select("txn_id", "src", "dst", "amount")


@register("j12_edges_with_accounts", f"WITH {FLOWS_SQL}, {ACCOUNTS_SQL} SELECT order_id, layer, src, dst, coalesce(a.bank, '?') AS src_bank, coalesce(b.bank, '?') AS dst_bank FROM (SELECT DISTINCT order_id, layer, src, dst FROM flows) f LEFT JOIN accounts a ON f.src = a.account_id LEFT JOIN accounts b ON f.dst = b.account_id")
def _j12(spark, sf):
    f = T.flows(spark, sf).select("order_id", "layer", "src", "dst").distinct()
    a = accounts(spark, sf).select(F.col("account_id").alias("src"), F.col("bank").alias("sb"))
    b = accounts(spark, sf).select(F.col("account_id").alias("dst"), F.col("bank").alias("db"))
    return f.join(a, "src", "left").join(b, "dst", "left").select(
        "order_id", "layer", "src", "dst", F.coalesce("sb", F.lit("?")).alias("src_bank"), F.coalesce("db", F.lit("?")).alias("dst_bank"))


_D30 = 30 * 86_400_000_000


@register("j15_account_state", f"WITH {FLOWS_SQL}, moves AS (SELECT dst AS acct, ts_us, amount AS ia, 0.0 AS oa, 1 AS i, payer FROM flows UNION ALL SELECT src, ts_us, 0, amount, 0, NULL FROM flows), "
          f"w AS (SELECT acct, ts_us, sum(i) OVER p AS credits, max(CASE WHEN i = 1 THEN ts_us END) OVER p AS last_in, sum(ia) OVER d AS in24, sum(oa) OVER d AS out24, count(DISTINCT payer) OVER d AS payers FROM moves "
          "WINDOW p AS (PARTITION BY acct ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), d AS (PARTITION BY acct ORDER BY ts_us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)) "
          f"SELECT CAST(acct AS VARCHAR) AS acct, ts_us, {n('max(coalesce(credits, 0))', 'credits')}, {n('max(last_in)', 'last_in_us')}, {r('max(coalesce(in24, 0))', 'in_24h', 2)}, {r('max(coalesce(out24, 0))', 'out_24h', 2)}, {n('max(payers)', 'payers_24h')} FROM w GROUP BY acct, ts_us")
def _j15(spark, sf):
    from ..operators.features.account import account_timeline
    from ..operators.hot import tasks_for

    flows = stored(T.flows(spark, sf).select("src", "dst", "payer", "ts_us", "amount"), "flows")  # counted, then read twice
    line = account_timeline(flows, columns=["credits", "last_in_us", "in_amt_24h", "out_amt_24h", "payers_24h"], tasks=tasks_for(flows))
    return line.filter(F.col("ts_us").isNotNull()).select(
        "acct", "ts_us", "credits", "last_in_us", _floor(C.from_micro_units(F.col("in_amt_24h")), 2).alias("in_24h"),
        _floor(C.from_micro_units(F.col("out_amt_24h")), 2).alias("out_24h"), "payers_24h")


def _floor(c, places):
    return F.floor(c * 10**places + HALF) / 10**places


# Feedback.

CAND_SQL = "cand AS (SELECT *, 'g' || CAST(txn_id % 60 AS VARCHAR) AS group_id FROM scored WHERE y = 1)"


def candidates(spark, sf):
    return scored(spark, sf).filter("y = 1").withColumn("group_id", F.concat(F.lit("g"), F.expr("txn_id % 60")))


EV_SQL = ("ev AS (SELECT group_id, count(*) AS n, avg(CASE WHEN score < 0.9 THEN 1.0 ELSE 0.0 END) AS er, avg(score) AS ms, median(score) AS md, sum(amount) AS vx, coalesce(sum(amount) FILTER (score < 0.9), 0) AS ve FROM cand GROUP BY group_id)")


@register("a18_b1_evasion_by_group", f"{S}, {CAND_SQL}, {EV_SQL} SELECT group_id, {n('n', 'n')}, {r('er', 'evasion_rate')}, {r('ms', 'mean_score')}, {r('md', 'median_score')}, {r('vx', 'value_extracted', 2)}, {r('ve', 'value_evaded', 2)} FROM ev")
def _a18(spark, sf):
    return cents(feedback.evasion_by_group(candidates(spark, sf), 0.9), ("value_extracted", "value_evaded"))


@register("a19_evasion_by_family", f"{S}, {CAND_SQL}, g AS (SELECT vector_id, group_id, avg(CASE WHEN score < 0.9 THEN 1.0 ELSE 0.0 END) AS er FROM cand GROUP BY 1, 2) SELECT vector_id, {n('count(*)', 'n')}, {r('avg(er)', 'evasion')} FROM g GROUP BY 1")
def _a19(spark, sf):
    g = candidates(spark, sf).groupBy("vector_id", "group_id").agg(F.avg((F.col("score") < 0.9).cast("double")).alias("evasion_rate"))
    return feedback.evasion_by_family(g)


@register("b2_mined_rows", f"{S} SELECT txn_id, 18e0 AS weight FROM scored WHERE y = 1 AND score < 0.9 ORDER BY {HASH}, txn_id LIMIT 2200")
def _b2(spark, sf):
    return feedback.mine_evasions(candidates(spark, sf), 0.9, shuffle=shuffle()).select("txn_id", "weight")


@register("b3_mined_by_vector", f"{S} SELECT vector_id, {n('count(*)', 'mined')} FROM (SELECT * FROM scored WHERE y = 1 AND score < 0.9 ORDER BY {HASH}, txn_id LIMIT 2200) GROUP BY vector_id")
def _b3(spark, sf):
    return feedback.mined_by_vector(feedback.mine_evasions(candidates(spark, sf), 0.9, shuffle=shuffle()))


@register("b4_frozen_measure", f"{S}, th AS (SELECT quantile_cont(score, 0.98) AS t FROM scored), pt AS ({confusion_sql('(SELECT t FROM th)')}), "
          "auc AS (SELECT (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)) "
          f"SELECT threshold, recall, precision, fpr, alert_rate, value_recall, {r('auc', 'auc')} FROM pt, auc")
def _b4(spark, sf):
    return feedback.frozen_measure(scored(spark, sf))


@register("b5_gain", f"{S}, {CAND_SQL} SELECT group_id, {r('avg(CASE WHEN p_model < 0.9 THEN 1.0 ELSE 0.0 END)', 'evasion_pre')}, {r('avg(CASE WHEN score < 0.9 THEN 1.0 ELSE 0.0 END)', 'evasion_post')}, "
          f"{r('avg(CASE WHEN p_model < 0.9 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN score < 0.9 THEN 1.0 ELSE 0.0 END)', 'gain')}, true AS fpr_within_budget FROM cand GROUP BY group_id")
def _b5(spark, sf):
    c = candidates(spark, sf)
    before = feedback.evasion_by_group(c.withColumn("score", F.col("p_model")), 0.9)
    return feedback.gain(before, feedback.evasion_by_group(c, 0.9), baseline_fpr=0.02, after_fpr=0.0249)


@register("b6_first_round", "SELECT min(l_linenumber) AS first_round FROM (SELECT l_linenumber, avg(l_discount) AS e, avg(l_tax) AS f FROM lineitem GROUP BY 1) WHERE e < 0.0502 AND f < 0.0401")
def _b6(spark, sf):
    rounds = T.read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("round")).agg(F.avg("l_discount").alias("evasion_post"), (F.avg("l_tax") < 0.0401).alias("fpr_within_budget"))
    return feedback.first_round_reaching(rounds, 0.0502)


PARAM_SQL = "params AS (SELECT c_custkey AS group_id, c_mktsegment AS family, 1 + c_custkey % 9 AS n, abs(c_acctbal) * 10 AS value_extracted, (c_custkey * 7 % 21) / 20e0 AS evasion_rate, " + ", ".join(
    f"(c_custkey * {13 + 4 * i} % 101) / 100e0 AS {p}" for i, p in enumerate(K.PARAMETER_NAMES)) + " FROM customer)"


def params(spark, sf):
    return T.read(spark, sf, "customer").selectExpr(
        "c_custkey AS group_id", "c_mktsegment AS family", "1 + c_custkey % 9 AS n", "abs(c_acctbal) * 10 AS value_extracted",
        "(c_custkey * 7 % 21) / 20e0 AS evasion_rate", *[f"(c_custkey * {13 + 4 * i} % 101) / 100e0 AS {p}" for i, p in enumerate(K.PARAMETER_NAMES)])


VIA_SQL = ("via AS (SELECT *, (0.30 * device_hygiene + 0.26 * spread + 0.24 * mimicry + 0.14 * dwell + 0.06 * (1 - velocity) + 0.05 * stealth + 0.04 * (1 - narrative_intensity)) / 1.09 AS oc, value_extracted / n AS vpa, 1 / (1 + exp(-(value_extracted / n - 4000) / 1800)) AS vi FROM params), "
           "fit AS (SELECT *, greatest(0.0, evasion_rate * (0.35 + 0.65 * vi) - 0.55 * oc * evasion_rate) AS fitness FROM via)")


@register("b7_viability", f"WITH {PARAM_SQL}, {VIA_SQL} SELECT group_id, {r('oc', 'operational_cost')}, {r('vpa', 'value_per_attack', 4)}, {r('vi', 'viability')}, {r('fitness', 'fitness')} FROM fit")
def _b7(spark, sf):
    return cents4(feedback.viability(params(spark, sf)).select("group_id", "operational_cost", "value_per_attack", "viability", "fitness"))


def cents4(df):
    return df.withColumn("value_per_attack", _floor_col("value_per_attack", 4))


@register("b7_clip_parameters", f"WITH {PARAM_SQL} SELECT group_id, {r('''least(1.0, CASE WHEN family = 'MACHINERY' THEN 0.55 ELSE 1.0 END, greatest(CASE WHEN family = 'BUILDING' THEN 0.3 ELSE 0 END, aggression))''', 'aggression')}, {r('''greatest(CASE WHEN family = 'MACHINERY' THEN 0.2 ELSE 0 END, velocity)''', 'velocity')} FROM params")
def _b7b(spark, sf):
    bounds = spark.createDataFrame(
        [("BUILDING", "aggression", 0.3, None), ("MACHINERY", "aggression", None, 0.55), ("MACHINERY", "velocity", 0.2, None)],
        "family STRING, parameter STRING, lower DOUBLE, upper DOUBLE")
    return feedback.clip_parameters(params(spark, sf), bounds).select("group_id", "aggression", "velocity")


@register("a22_elite_centroid", f"WITH {PARAM_SQL}, {VIA_SQL}, e AS (SELECT *, row_number() OVER (ORDER BY fitness DESC, group_id) AS i, count(*) OVER () AS c FROM fit) SELECT {n('count(*)', 'n')}, {r('avg(aggression)', 'aggression')}, {r('avg(mimicry)', 'mimicry')} FROM e WHERE i <= greatest(3, floor(c * 0.25))")
def _a22(spark, sf):
    return feedback.elite_centroid(feedback.viability(params(spark, sf)), ["aggression", "mimicry"])


@register("m5_class_weights", f"{S} SELECT txn_id, CASE WHEN y = 1 THEN 6e0 ELSE 1e0 END AS weight FROM scored")
def _m5(spark, sf):
    return feedback.with_class_weight(scored(spark, sf)).select("txn_id", "weight")


# Quality.

DRAW = "(txn_id * 7919 % 10007) / 10007e0"
_NOISY = (f"CASE WHEN split = 'test' THEN is_fraud WHEN is_fraud = 1 AND {DRAW} < {K.MISSED_FRAUD_RATE}e0 THEN 0 "
          f"WHEN is_fraud = 0 AND {DRAW} < {K.FALSE_FRAUD_RATE}e0 THEN 1 ELSE is_fraud END")


@register("q1_label_noise", f"WITH {LEDGER_SQL}, {SPLIT_SQL} SELECT split, {n('count(*)', 'rows')}, {n(f'count(*) FILTER (is_fraud <> {_NOISY})', 'changed')}, {n(f'sum({_NOISY})', 'observed')} FROM splits GROUP BY split")
def _q1(spark, sf):
    df = quality.label_noise(split_ledger(spark, sf).withColumn("y", F.col("is_fraud")), draw=F.expr(DRAW))
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("y") != F.col("y_observed")).cast("int")).alias("changed"), F.sum("y_observed").alias("observed"))


@register("q2_telemetry_masking", f"WITH {LEDGER_SQL}, x AS (SELECT 'all' AS label, * FROM ledger UNION ALL SELECT CASE WHEN is_fraud = 1 THEN 'fraud' ELSE 'legit' END, * FROM ledger) "
          + " UNION ALL ".join(f"SELECT label, '{c}' AS \"column\", {r(f'avg(CASE WHEN {DRAW} < {K.TELEMETRY_COVERAGE}e0 THEN 0.0 ELSE 1.0 END)', 'missing')} FROM x GROUP BY label" for c in K.OPTIONAL_TELEMETRY))
def _q2(spark, sf):
    full = T.ledger(spark, sf).fillna(0, subset=K.OPTIONAL_TELEMETRY)
    return reports.telemetry_coverage(quality.mask_columns(full, draw=F.expr(DRAW)))


@register("q3_split_overlap", f"WITH {LEDGER_SQL}, {SPLIT_SQL} SELECT max(ts_us) FILTER (split = 'train') > min(ts_us) FILTER (split = 'calib') AS train_overlaps_calib, max(ts_us) FILTER (split = 'calib') > min(ts_us) FILTER (split = 'test') AS calib_overlaps_test FROM splits")
def _q3(spark, sf):
    return quality.split_overlap(split_ledger(spark, sf))


Q4 = ["cust_amt_24h", "amount_z_customer", "cust_known_merchants", "device_customer_count", "merchant_repeat_rate", "benef_distinct_payers_24h"]


@register("q4_causality_gap", "SELECT CAST(floor(count(*) * 0.6) AS BIGINT) AS rows, " + ", ".join(f"0e0 AS {c}" for c in Q4) + " FROM events")
def _q4(spark, sf):
    from ..operators.features import features

    names = Q4
    led = T.ledger(spark, sf)
    cut = ranks.at_or_after(led.withColumn("ts_us", F.unix_micros("ts")), int(led.count() * 0.6))
    early = led.withColumn("ts_us", F.unix_micros("ts")).filter(~cut).drop("ts_us")
    dims = (T.customers(spark, sf), T.merchants(spark, sf), None)
    return quality.causality_gap(features(led, *dims, columns=names), features(early, *dims, columns=names), names)


@register("q5_band_checks", f"WITH {LEDGER_SQL} SELECT {r('avg(is_fraud)', 'fraud_rate')}, avg(is_fraud) BETWEEN 0.005 AND 0.05 AS fraud_rate_ok, {r('count(benign_anomaly) / count(*) FILTER (is_fraud = 0)', 'benign_anomaly_rate')}, count(benign_anomaly) / count(*) FILTER (is_fraud = 0) > 0.02 AS benign_anomaly_rate_ok FROM ledger")
def _q5(spark, sf):
    return quality.band_checks(T.ledger(spark, sf))


@register("q6_table_checks", f"SELECT {n('count(*)', 'rows')}, {n('count(DISTINCT (l_orderkey, l_linenumber))', 'keys')}, {n('count(*) - count(DISTINCT (l_orderkey, l_linenumber))', 'duplicates')}, {n('count(*) - count(l_tax)', 'missing_l_tax')} FROM lineitem")
def _q6(spark, sf):
    return quality.table_checks(T.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_tax"])


# Files.

def scratch(spark, name):
    """A new folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


IO_COLS = ["txn_id", "amount", "city", "session_duration_s", "is_fraud"]
IO_SQL = f"WITH {LEDGER_SQL} SELECT txn_id, {r('amount', 'amount')}, city, {r('session_duration_s', 'session_duration_s')}, is_fraud FROM ledger"


@register("io1_io2_ndjson", IO_SQL)
def _io1(spark, sf):
    path = scratch(spark, "ndjson")
    files.write_ndjson(T.ledger(spark, sf).select(*IO_COLS), path)
    return files.read_ndjson(spark, path, "txn_id LONG, amount DOUBLE, city STRING, session_duration_s DOUBLE, is_fraud INT")


@register("io3_csv", IO_SQL)
def _io3(spark, sf):
    path = scratch(spark, "csv")
    files.write_csv(T.ledger(spark, sf).select(*IO_COLS), path, IO_COLS)
    return spark.read.option("header", "true").schema("txn_id LONG, amount DOUBLE, city STRING, session_duration_s DOUBLE, is_fraud INT").csv(path)


@register("io4_json_report", f"WITH {LEDGER_SQL} SELECT rail, {n('count(*)', 'n')}, {n('sum(is_fraud)', 'fraud')}, {r('sum(is_fraud) / count(*)', 'share')} FROM ledger GROUP BY rail")
def _io4(spark, sf):
    path = scratch(spark, "report")
    files.write_report(reports.fraud_share_by_rail(T.ledger(spark, sf)), path)
    return files.read_ndjson(spark, path, "rail STRING, n LONG, fraud LONG, share DOUBLE")


@register("io5_json_safe", f"SELECT event_id, {r('CASE WHEN event_id % 4 >= 2 THEN value / 3 END', 'v')} FROM events")
def _io5(spark, sf):
    v = F.expr("CASE event_id % 4 WHEN 0 THEN double('NaN') WHEN 1 THEN double('Infinity') ELSE value / 3 END")
    return files.normalise(T.read(spark, sf, "events").select("event_id", v.alias("v")))


@register("io6_columnar", f"SELECT user_id, {n('count(*)', 'n')} FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09' GROUP BY user_id")
def _io6(spark, sf):
    path = scratch(spark, "columnar")
    files.write_columnar(T.read(spark, sf, "events"), path)
    return files.read_columnar(spark, path, "2024-01-05", "2024-01-09").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("io7_dump", f"WITH {LEDGER_SQL}, {EPISODES_SQL} SELECT 'ledger' AS part, {n('count(*)', 'n')} FROM ledger UNION ALL SELECT 'episodes', count(*) FROM episodes")
def _io7(spark, sf):
    path = scratch(spark, "dump")
    files.dump(T.ledger(spark, sf), T.episodes(spark, sf), path)
    led = files.read_ndjson(spark, f"{path}/transactions", "txn_id LONG").agg(F.count("txn_id").alias("n")).select(F.lit("ledger").alias("part"), "n")
    eps = files.read_ndjson(spark, f"{path}/episodes", "episode_id LONG").agg(F.count("episode_id").alias("n")).select(F.lit("episodes").alias("part"), "n")
    return led.unionByName(eps)


@register("io6_files_per_day", f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS dt, {n('count(*)', 'n')}, true AS bounded FROM events GROUP BY 1")
def _io6_files(spark, sf):
    """Rows of each day, and whether its files are as few and as large as asked."""
    path, limit = scratch(spark, "days"), 200
    files.write_columnar(T.read(spark, sf, "events"), path, rows_per_file=limit)
    per_file = spark.read.parquet(path).groupBy("dt", F.input_file_name().alias("file")).count()
    days = per_file.groupBy("dt").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("files"), F.max("count").alias("largest"))
    return days.select(F.col("dt").cast("string"), "n", ((F.col("largest") <= limit) & (F.col("files") <= 2 * F.ceil(F.col("n") / limit))).alias("bounded"))


@register("io7_episode_turns", "SELECT conv_id AS episode_id, CASE WHEN conv_id % 3 = 0 THEN 'coercion' ELSE 'benign' END AS kind, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS place, role AS speaker, text FROM conversations")
def _io7_turns(spark, sf):
    """Conversations written as one nested line each and read back turn by turn."""
    path = scratch(spark, "episodes")
    turns = T.read(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.expr("CASE WHEN conv_id % 3 = 0 THEN 'coercion' ELSE 'benign' END").alias("kind"), "turn", F.col("role").alias("speaker"), "text")
    files.write_nested(turns, path, ["episode_id"], ["turn"], ["speaker", "text"], "turns")
    back = files.read_ndjson(spark, path, "episode_id LONG, kind STRING, turns ARRAY<STRUCT<speaker: STRING, text: STRING>>")
    return back.select("episode_id", "kind", F.posexplode("turns").alias("place", "t")).select("episode_id", "kind", F.col("place").cast("long").alias("place"), "t.speaker", "t.text")
