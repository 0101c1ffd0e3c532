"""Causal feature queries: one per feature group, and the whole row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import FORBIDDEN_FEATURES, HIGH_RISK_COUNTRIES, LIQUID_CATEGORIES
from ..constants import AUTH_METHODS, CATEGORIES, DEVICE_OS, PERSONAS, RAILS
from ..operators.causal import seen_since
from ..operators.features import FEATURE_NAMES, Registry, features
from ..session import stored
from ..sources import tables as T
from .registry import CUSTOMERS_SQL, EPISODES_SQL, LEDGER_SQL, MERCHANTS_SQL, fixed, query, r

H, D = 3_600_000_000, 86_400_000_000


def _prev(key: str) -> str:
    return f"(PARTITION BY {key} ORDER BY ts_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _span(key: str, us: int) -> str:
    return f"(PARTITION BY {key} ORDER BY ts_us RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING)"


def _hav(a: str, b: str, c: str, d: str) -> str:
    s = (f"power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * "
         f"power(sin(radians({d} - {b}) / 2), 2)")
    return f"2 * 6371.0 * asin(sqrt(least(1.0, greatest(0.0, {s}))))"


def _ord(col: str, values: list[str], default: int) -> str:
    whens = " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values))
    return f"CASE {col} {whens} ELSE {default} END"


def _in(col: str, values: list[str]) -> str:
    return f"CASE WHEN {col} IN (" + ", ".join(f"'{v}'" for v in values) + ") THEN 1 ELSE 0 END"


_NOVEL = {"merchant": "merchant_id", "beneficiary": "beneficiary_id", "device": "device_id",
          "city": "city", "category": "category"}

_FIRSTS = ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND ts_us = min(ts_us) OVER (PARTITION BY customer_id, {c}) THEN 1 ELSE 0 END AS {k}_new, "
    f"CASE WHEN {c} IS NOT NULL AND row_number() OVER (PARTITION BY customer_id, {c} ORDER BY ts_us, txn_id) = 1 THEN 1 ELSE 0 END AS {k}_first"
    for k, c in _NOVEL.items()
)

_HOUR = f"((ts_us % {D}) / CAST({H} AS DOUBLE))"
_ANGLE = f"(2 * pi() * {_HOUR} / 24.0)"
_NIGHT = f"CASE WHEN {_HOUR} < 5.5 OR {_HOUR} >= 23.0 THEN 1 ELSE 0 END"
_CP = _prev("customer_id")

BASE_SQL = f"""WITH {LEDGER_SQL}, {CUSTOMERS_SQL}, {MERCHANTS_SQL}, {EPISODES_SQL},
led AS (SELECT l.*, c.customer_id IS NOT NULL AS known, c.lat AS home_lat, c.lon AS home_lon, c.country AS dim_country,
    c.self_account, m.chargeback_rate, e.turn_count AS e_turns, e.duration_s AS e_duration,
    greatest(1.0, coalesce(l.customer_balance, 1.0)) AS bal, ln(1 + l.amount) AS logamt
  FROM ledger l LEFT JOIN customers c ON l.customer_id = c.customer_id
  LEFT JOIN merchants m ON l.merchant_id = m.merchant_id
  LEFT JOIN episodes e ON l.narrative_id = e.episode_id),
firsts AS (SELECT *, {_FIRSTS},
    CASE WHEN row_number() OVER (PARTITION BY device_id, customer_id ORDER BY ts_us, txn_id) = 1 THEN 1 ELSE 0 END AS dev_first,
    CASE WHEN row_number() OVER (PARTITION BY merchant_id, customer_id ORDER BY ts_us, txn_id) = 1 THEN 1 ELSE 0 END AS mer_first
  FROM led),
hist AS (SELECT *, count(*) OVER {_CP} AS n, avg(logamt) OVER {_CP} AS log_mean, stddev_samp(logamt) OVER {_CP} AS log_std,
    quantile_cont(amount, 0.95) OVER (PARTITION BY customer_id ORDER BY ts_us, txn_id ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS p95,
    count(*) OVER {_span('customer_id', H)} AS n1, count(*) OVER {_span('customer_id', D)} AS n24, count(*) OVER {_span('customer_id', 7 * D)} AS n7,
    coalesce(sum(amount) OVER {_span('customer_id', H)}, 0) AS a1, coalesce(sum(amount) OVER {_span('customer_id', D)}, 0) AS a24,
    coalesce(sum(amount) OVER {_span('customer_id', 7 * D)}, 0) AS a7,
    max(ts_us) OVER {_CP} AS last_us, min(ts_us) OVER {_CP} AS first_us,
    arg_max(lat, ts_us) OVER {_CP} AS last_lat, arg_max(lon, ts_us) OVER {_CP} AS last_lon,
    coalesce(sum(merchant_first) OVER {_CP}, 0) AS k_m, coalesce(sum(beneficiary_first) OVER {_CP}, 0) AS k_b,
    coalesce(sum(device_first) OVER {_CP}, 0) AS k_d,
    avg(sin({_ANGLE})) OVER {_CP} AS ms, avg(cos({_ANGLE})) OVER {_CP} AS mc,
    coalesce(sum({_NIGHT}) OVER {_CP}, 0) AS nights,
    avg(session_duration_s) OVER {_CP} AS se_mean, count(session_duration_s) OVER {_CP} AS se_n,
    avg(hesitation_ms) OVER {_CP} AS he_mean, avg(typing_variance) OVER {_CP} AS ty_mean,
    coalesce(sum(dispute_filed) OVER {_span('customer_id', 90 * D)}, 0) AS d90,
    coalesce(sum(CASE WHEN is_agentic = 1 AND mandate_ceiling > 0 THEN amount END) OVER {_prev("customer_id, coalesce(agent_id, 'None')")}, 0) AS drawn,
    count(*) OVER {_span('device_id', H)} AS dv1, count(*) OVER {_span('device_id', D)} AS dv24,
    min(ts_us) OVER {_prev('device_id')} AS dv_first, coalesce(sum(dev_first) OVER {_prev('device_id')}, 0) AS dv_cust,
    count(*) OVER {_span('merchant_id', H)} AS m1, count(*) OVER {_span('merchant_id', D)} AS m24,
    count(*) OVER {_prev('merchant_id')} AS mn, avg(amount) OVER {_prev('merchant_id')} AS m_mean,
    min(ts_us) OVER {_prev('merchant_id')} AS m_first, coalesce(sum(mer_first) OVER {_prev('merchant_id')}, 0) AS m_cust
  FROM firsts),
moves AS (SELECT txn_id, 'in' AS side, beneficiary_id AS acct, ts_us, amount, customer_id AS payer FROM led WHERE beneficiary_id IS NOT NULL
  UNION ALL SELECT txn_id, 'out', self_account, ts_us, amount, NULL FROM led WHERE self_account IS NOT NULL),
acct AS (SELECT txn_id, side,
    count(CASE WHEN side = 'in' THEN 1 END) OVER {_span('acct', H)} AS in1, count(CASE WHEN side = 'in' THEN 1 END) OVER {_span('acct', D)} AS in24,
    count(DISTINCT payer) OVER {_span('acct', D)} AS payers,
    coalesce(sum(CASE WHEN side = 'in' THEN amount END) OVER {_span('acct', D)}, 0) AS in_amt,
    count(CASE WHEN side = 'out' THEN 1 END) OVER {_span('acct', H)} AS out1,
    coalesce(sum(CASE WHEN side = 'out' THEN amount END) OVER {_span('acct', D)}, 0) AS out_amt,
    max(CASE WHEN side = 'in' THEN ts_us END) OVER {_prev('acct')} AS last_in,
    min(CASE WHEN side = 'in' THEN ts_us END) OVER {_prev('acct')} AS first_in, ts_us, amount FROM moves),
j AS (SELECT h.*, b.in1, b.in24, b.payers, b.in_amt, b.out1, b.out_amt, b.last_in, b.first_in,
    s.in_amt AS s_in, s.out_amt AS s_out, s.last_in AS s_last,
    CASE WHEN known THEN dim_country ELSE country END AS home_country,
    CASE WHEN is_agentic = 1 AND coalesce(mandate_ceiling, 0) > 0 THEN 1 ELSE 0 END AS mandated
  FROM hist h LEFT JOIN acct b ON h.txn_id = b.txn_id AND b.side = 'in'
  LEFT JOIN acct s ON h.txn_id = s.txn_id AND s.side = 'out')
"""

_LAST_KM = _hav("last_lat", "last_lon", "lat", "lon")

FEATURE_SQL = {
    "amount": "amount", "log_amount": "logamt",
    "amount_z_customer": "CASE WHEN n >= 3 AND log_std > 1e-9 THEN (logamt - log_mean) / log_std ELSE 0 END",
    "amount_to_p95": "coalesce(amount / greatest(50.0, p95), 1.0)",
    "amount_to_balance": "amount / bal",
    "amount_to_merchant_mean": "CASE WHEN merchant_id IS NOT NULL AND mn > 2 THEN amount / greatest(50.0, m_mean) ELSE 1.0 END",
    "amount_round_ness": "CASE WHEN abs(amount - round(amount / 100) * 100) < 1e-6 THEN 1 ELSE 0 END",
    "amount_below_threshold_gap": "CASE WHEN amount <= 5000 THEN (5000 - amount) / 5000 WHEN amount <= 25000 THEN (25000 - amount) / 25000 "
                                  "WHEN amount <= 50000 THEN (50000 - amount) / 50000 WHEN amount <= 100000 THEN (100000 - amount) / 100000 ELSE 1 END",
    "cust_txn_1h": "n1", "cust_txn_24h": "n24", "cust_txn_7d": "n7",
    "cust_amt_1h": "a1", "cust_amt_24h": "a24", "cust_amt_7d": "a7",
    "cust_burst_ratio": "n24 / greatest(1.0, n7 / 7.0)",
    "secs_since_last_txn": "coalesce((ts_us - last_us) / 1e6, 999999.0)",
    "cust_txn_total": "n",
    "cust_amt_24h_to_balance": "a24 / bal",
    "is_new_merchant": "merchant_new", "is_new_beneficiary": "beneficiary_new", "is_new_device": "device_new",
    "is_new_city": "CASE WHEN city IS NULL THEN 1 ELSE city_new END", "is_new_category": "category_new",
    "cust_tenure_days": f"coalesce((ts_us - first_us) / CAST({D} AS DOUBLE), 0)",
    "cust_known_merchants": "k_m", "cust_known_beneficiaries": "k_b", "cust_known_devices": "k_d",
    "hour": _HOUR, "hour_sin": f"sin({_ANGLE})", "hour_cos": f"cos({_ANGLE})", "is_night": _NIGHT,
    "day_of_week": "isodow(ts) - 1", "is_weekend": "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END",
    "hour_deviation": f"CASE WHEN n >= 3 THEN 1 - greatest(-1.0, least(1.0, (sin({_ANGLE}) * ms + cos({_ANGLE}) * mc) / greatest(1e-6, sqrt(ms * ms + mc * mc)))) ELSE 0 END",
    "cust_night_rate": "nights / greatest(1, n)",
    "dist_from_home_km": _hav("CASE WHEN known THEN home_lat ELSE lat END", "CASE WHEN known THEN home_lon ELSE lon END", "lat", "lon"),
    "dist_from_last_km": f"CASE WHEN n > 0 THEN {_LAST_KM} ELSE 0 END",
    "travel_speed_kmh": f"CASE WHEN n > 0 THEN {_LAST_KM} / greatest(1e-3, (ts_us - last_us) / 3.6e9) ELSE 0 END",
    "is_foreign": "CASE WHEN country IS DISTINCT FROM home_country THEN 1 ELSE 0 END",
    "is_high_risk_country": _in("country", HIGH_RISK_COUNTRIES),
    "merchant_is_foreign": "CASE WHEN merchant_country IS NOT NULL AND merchant_country IS DISTINCT FROM home_country THEN 1 ELSE 0 END",
    "device_age_days": "coalesce(device_age_days, 0)", "device_is_emulator": "coalesce(device_is_emulator, 0)",
    "device_is_rooted": "coalesce(device_is_rooted, 0)",
    "device_sim_count": "CASE WHEN coalesce(device_sim_count, 0) = 0 THEN 1 ELSE device_sim_count END",
    "device_attested": "coalesce(device_attested, 0)",
    "device_customer_count": "CASE WHEN device_id IS NULL THEN 0 ELSE dv_cust END",
    "device_txn_1h": "CASE WHEN device_id IS NULL THEN 0 ELSE dv1 END",
    "device_txn_24h": "CASE WHEN device_id IS NULL THEN 0 ELSE dv24 END",
    "device_tenure_days": f"CASE WHEN device_id IS NULL THEN 0 ELSE coalesce((ts_us - dv_first) / CAST({D} AS DOUBLE), 0) END",
    "merchant_age_days": "coalesce(merchant_age_days, 0)",
    "merchant_risk_tier": "CASE WHEN coalesce(merchant_risk_tier, 0) = 0 THEN 1 ELSE merchant_risk_tier END",
    "merchant_is_liquid": _in("category", LIQUID_CATEGORIES),
    "merchant_txn_1h": "CASE WHEN merchant_id IS NULL THEN 0 ELSE m1 END",
    "merchant_txn_24h": "CASE WHEN merchant_id IS NULL THEN 0 ELSE m24 END",
    "merchant_distinct_customers": "CASE WHEN merchant_id IS NULL THEN 0 ELSE m_cust END",
    "merchant_repeat_rate": "CASE WHEN merchant_id IS NULL THEN 0 ELSE (mn - m_cust) / greatest(1, mn) END",
    "merchant_chargeback_rate": "coalesce(chargeback_rate, 0.004)",
    "merchant_tenure_days": f"CASE WHEN merchant_id IS NULL THEN 0 ELSE coalesce((ts_us - m_first) / CAST({D} AS DOUBLE), 0) END",
    "benef_age_days": "CASE WHEN beneficiary_id IS NULL THEN 0 ELSE coalesce(beneficiary_age_days, 0) END",
    "benef_in_count_1h": "coalesce(in1, 0)", "benef_in_count_24h": "coalesce(in24, 0)",
    "benef_distinct_payers_24h": "coalesce(payers, 0)", "benef_in_amt_24h": "coalesce(in_amt, 0)",
    "benef_out_count_1h": "coalesce(out1, 0)",
    "benef_passthrough_ratio": "CASE WHEN in_amt > 1.0 THEN out_amt / in_amt ELSE 0 END",
    "benef_dwell_secs": "coalesce((ts_us - last_in) / 1e6, 999999.0)",
    "benef_tenure_days": f"coalesce((ts_us - first_in) / CAST({D} AS DOUBLE), 0)",
    "sender_passthrough_ratio": "CASE WHEN s_in > 1.0 THEN (s_out + amount) / s_in ELSE 0 END",
    "sender_dwell_secs": "coalesce((ts_us - s_last) / 1e6, 999999.0)", "sender_in_24h": "coalesce(s_in, 0)",
    "session_duration_s": "session_duration_s",
    "session_ratio_customer": "CASE WHEN se_n > 2 THEN session_duration_s / greatest(1.0, se_mean) END",
    "hesitation_ms": "hesitation_ms",
    "hesitation_ratio_customer": "CASE WHEN se_n > 2 THEN hesitation_ms / greatest(1.0, he_mean) END",
    "app_switches": "app_switches", "form_corrections": "form_corrections", "typing_variance": "typing_variance",
    "typing_variance_ratio": "CASE WHEN se_n > 2 THEN typing_variance / greatest(0.0001, ty_mean) END",
    "screen_share": "screen_share", "call_active": "call_active",
    "screen_share_and_new_benef": "screen_share * beneficiary_new",
    "session_per_txn_value": "session_duration_s / greatest(1.0, logamt)",
    "threeds_result": "coalesce(threeds_result, 0)", "otp_attempts": "coalesce(otp_attempts, 0)",
    "step_up_shown": "coalesce(step_up_shown, 0)", "instrument_age_days": "coalesce(instrument_age_days, 0)",
    "customer_account_age_days": "coalesce(customer_account_age_days, 0)", "customer_balance": "bal",
    "cust_prior_disputes_90d": "d90", "cust_prior_dispute_rate": "d90 / greatest(1, n)",
    "is_agentic": "is_agentic", "agent_attested": "coalesce(agent_attested, 0)",
    "mandate_ceiling": "coalesce(mandate_ceiling, 0)", "mandate_age_h": "coalesce(mandate_age_h, 0)",
    "mandate_scope_breadth": "coalesce(mandate_scope_breadth, 0)",
    "mandate_ceiling_to_typical": "CASE WHEN mandated = 1 THEN mandate_ceiling / greatest(100.0, CASE WHEN n > 2 THEN exp(log_mean) - 1 ELSE greatest(200.0, amount) END) ELSE 0 END",
    "mandate_drawdown_ratio": "CASE WHEN mandated = 1 THEN (drawn + amount) / mandate_ceiling ELSE 0 END",
    "mandate_intent_match": "CASE WHEN mandated = 1 THEN CASE WHEN mandate_intent_category = category THEN 1 ELSE 0 END ELSE 1 END",
    "human_confirmations": "coalesce(human_confirmations, 0)",
    "amount_to_mandate_ceiling": "CASE WHEN mandated = 1 THEN amount / mandate_ceiling ELSE 0 END",
    "has_episode": "CASE WHEN e_turns IS NOT NULL THEN 1 ELSE 0 END", "coercion_score": "coercion_score",
    "episode_turns": "coalesce(e_turns, 0)", "episode_duration_s": "coalesce(e_duration, 0)",
    "cat_rail": _ord("rail", RAILS, -1), "cat_auth_method": _ord("auth_method", AUTH_METHODS, -1),
    "cat_merchant_category": _ord("category", CATEGORIES, len(CATEGORIES) - 1),
    "cat_persona": _ord("persona", PERSONAS, -1), "cat_device_os": _ord("device_os", DEVICE_OS, len(DEVICE_OS) - 1),
}

# Ratios of large to tiny numbers keep fewer places.
PLACES = {"benef_passthrough_ratio": 4, "sender_passthrough_ratio": 4, "travel_speed_kmh": 2, "dist_from_last_km": 3, "dist_from_home_km": 3}

GROUPS = {
    "f1_amount": ["amount", "log_amount"],
    "f2_amount_z_customer": ["amount_z_customer"],
    "f3_amount_to_p95": ["amount_to_p95"],
    "f4_balance": ["amount_to_balance", "customer_balance"],
    "f5_amount_to_merchant_mean": ["amount_to_merchant_mean"],
    "f6_amount_roundness": ["amount_round_ness"],
    "f7_threshold_gap": ["amount_below_threshold_gap"],
    "f8_customer_counts": ["cust_txn_1h", "cust_txn_24h", "cust_txn_7d"],
    "f9_customer_sums": ["cust_amt_1h", "cust_amt_24h", "cust_amt_7d"],
    "f10_burst_ratio": ["cust_burst_ratio"],
    "f11_secs_since_last": ["secs_since_last_txn"],
    "f12_customer_total": ["cust_txn_total"],
    "f13_amount_24h_to_balance": ["cust_amt_24h_to_balance"],
    "f14_new_counterparty": ["is_new_merchant", "is_new_beneficiary", "is_new_device"],
    "f15_new_city_category": ["is_new_city", "is_new_category"],
    "f16_customer_tenure": ["cust_tenure_days"],
    "f17_known_counterparties": ["cust_known_merchants", "cust_known_beneficiaries", "cust_known_devices"],
    "f18_hour_of_day": ["hour", "hour_sin", "hour_cos", "is_night"],
    "f19_day_of_week": ["day_of_week", "is_weekend"],
    "f20_hour_deviation": ["hour_deviation"],
    "f21_night_rate": ["cust_night_rate"],
    "f22_distance_from_home": ["dist_from_home_km"],
    "f23_travel": ["dist_from_last_km", "travel_speed_kmh"],
    "f24_countries": ["is_foreign", "is_high_risk_country", "merchant_is_foreign"],
    "f25_device_state": ["device_age_days", "device_is_emulator", "device_is_rooted", "device_sim_count", "device_attested"],
    "f26_device_customers": ["device_customer_count"],
    "f27_device_velocity": ["device_txn_1h", "device_txn_24h", "device_tenure_days"],
    "f28_merchant_profile": ["merchant_age_days", "merchant_risk_tier", "merchant_is_liquid", "merchant_chargeback_rate"],
    "f29_merchant_velocity": ["merchant_txn_1h", "merchant_txn_24h", "merchant_tenure_days"],
    "f30_merchant_customers": ["merchant_distinct_customers", "merchant_repeat_rate"],
    "f31_beneficiary_age": ["benef_age_days"],
    "f32_beneficiary_flows": ["benef_in_count_1h", "benef_in_count_24h", "benef_in_amt_24h", "benef_out_count_1h"],
    "f33_distinct_payers": ["benef_distinct_payers_24h"],
    "f34_passthrough": ["benef_passthrough_ratio"],
    "f35_beneficiary_dwell": ["benef_dwell_secs"],
    "f36_beneficiary_tenure": ["benef_tenure_days"],
    "f37_sender_account": ["sender_in_24h", "sender_passthrough_ratio", "sender_dwell_secs"],
    "f38_session": ["session_duration_s", "hesitation_ms", "app_switches", "form_corrections", "typing_variance", "screen_share", "call_active"],
    "f39_session_ratios": ["session_ratio_customer", "hesitation_ratio_customer", "typing_variance_ratio"],
    "f40_session_products": ["screen_share_and_new_benef", "session_per_txn_value"],
    "f41_auth": ["threeds_result", "otp_attempts", "step_up_shown", "instrument_age_days", "customer_account_age_days"],
    "f42_disputes": ["cust_prior_disputes_90d", "cust_prior_dispute_rate"],
    "f43_agentic": ["is_agentic", "agent_attested", "mandate_ceiling", "mandate_age_h", "mandate_scope_breadth", "human_confirmations"],
    "f44_mandate_ceiling_to_typical": ["mandate_ceiling_to_typical"],
    "f45_mandate_drawdown": ["mandate_drawdown_ratio", "amount_to_mandate_ceiling"],
    "f46_mandate_intent": ["mandate_intent_match"],
    "f47_episode": ["has_episode", "episode_turns", "episode_duration_s", "coercion_score"],
    "f48_categoricals": ["cat_rail", "cat_auth_method", "cat_merchant_category", "cat_persona", "cat_device_os"],
    "feature_row": FEATURE_NAMES,
}


def feature_table(spark, sf_dir, store=False, **options):
    """``store`` writes the computed ledger view once, for jobs that read it for many entities."""
    ledger = T.ledger(spark, sf_dir)
    return features(
        stored(ledger, "ledger") if store else ledger, T.customers(spark, sf_dir), T.merchants(spark, sf_dir),
        T.episode_stats(spark, sf_dir), **options,
    )


def _sql(names: list[str]) -> str:
    cols = ", ".join(
        r(FEATURE_SQL[c], c, PLACES.get(c, 6)) for c in names
    )
    return f"{BASE_SQL} SELECT txn_id, {cols} FROM j"


def _spark(names: list[str]):
    def run(spark, sf_dir):
        df = feature_table(spark, sf_dir, store=len(names) == len(FEATURE_NAMES), columns=names)
        return df.select("txn_id", *[fixed(F.col(c), PLACES.get(c, 6)).alias(c) for c in names])

    return run


assert not FORBIDDEN_FEATURES & set(FEATURE_NAMES)
for _name, _cols in GROUPS.items():
    query(_name, _sql(_cols))(_spark(_cols))


FILED_US = f"CASE WHEN dispute_filed = 1 THEN ts_us + (txn_id % 40) * {D} END"


@query("f42_disputes_on_two_clocks", f"WITH {LEDGER_SQL}, l AS (SELECT *, {FILED_US} AS filed_us FROM ledger) SELECT a.txn_id, CAST(count(d.txn_id) AS BIGINT) AS known_disputes_90d "
       f"FROM l a LEFT JOIN l d ON a.customer_id = d.customer_id AND d.ts_us < a.ts_us AND d.ts_us >= a.ts_us - {90 * D} AND d.filed_us < a.ts_us GROUP BY a.txn_id")
def _f42_two_clocks(spark, sf):
    """Disputes of the last 90 days that had been filed by then; filing takes up to 39 days."""
    led = T.ledger(spark, sf).withColumn("ts_us", F.unix_micros("ts")).withColumn("filed_us", F.expr(FILED_US))
    seen = seen_since(led.select("txn_id", "customer_id", "ts_us", "filed_us"), ["customer_id"], "ts_us", "filed_us", "known_disputes_90d", F.lit(1), 90 * D)
    return seen.select("txn_id", "known_disputes_90d")


def _own_features() -> Registry:
    """Four features of a user: histories of three entities, one over a ratio that is itself built on a history."""
    own = Registry()
    own.history("merchant_mean_30d", "merchant_id", "mean", ["ledger.amount"], 30 * D, default=None)(lambda amount: amount)
    own.history("device_largest", "device_id", "max", ["ledger.amount"])(lambda amount: amount)
    own.row("amount_to_mean_30d", ["ledger.amount", "merchant_mean_30d"], default=1.0)(
        lambda amount, mean: F.when(mean.isNotNull(), amount / F.greatest(F.lit(50.0), mean)))  # greatest passes over nulls
    own.history("customer_nights_7d", "customer_id", "sum", ["is_night"], 7 * D)(lambda night: night)
    own.history("customer_unusual", "customer_id", "count", ["amount_to_mean_30d"])(lambda ratio: ratio > 1.5)
    return own


OWN = ["is_night", "amount_to_mean_30d", "device_largest", "customer_nights_7d", "customer_unusual"]


@query("f0_registered_features", f"""WITH {LEDGER_SQL},
m AS (SELECT *, CASE WHEN merchant_id IS NOT NULL THEN avg(amount) OVER {_span("merchant_id", 30 * D)} END AS mean_30d,
    CASE WHEN device_id IS NOT NULL THEN max(amount) OVER {_prev("device_id")} END AS largest, {_NIGHT} AS night FROM ledger),
q AS (SELECT *, CASE WHEN mean_30d IS NULL OR amount IS NULL THEN 1.0 ELSE amount / greatest(50.0, mean_30d) END AS ratio FROM m),
h AS (SELECT *, CASE WHEN customer_id IS NOT NULL THEN sum(night) OVER {_span("customer_id", 7 * D)} END AS nights,
    CASE WHEN customer_id IS NOT NULL THEN sum(CASE WHEN ratio > 1.5 THEN 1 ELSE 0 END) OVER {_CP} END AS unusual FROM q)
SELECT txn_id, {r("night", "is_night")}, {r("ratio", "amount_to_mean_30d", 4)}, {r("coalesce(largest, 0)", "device_largest", 4)},
    {r("coalesce(nights, 0)", "customer_nights_7d", 4)}, {r("coalesce(unusual, 0)", "customer_unusual", 4)} FROM h""")
def _f0_registered(spark, sf):
    """Features declared here and nowhere else, resolved with built-in ones into one table."""
    table = _own_features().table(OWN, T.ledger(spark, sf), T.customers(spark, sf), T.merchants(spark, sf))
    return table.select("txn_id", *[fixed(F.col(c), 4).alias(c) for c in OWN])
