"""The full feature row: row-local columns plus every history, joined on txn_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ... import constants as K
from ...constants import FEATURE_NAMES
from ...functions import columns as C
from ...sources.schema import conform
from ..causal import AUTO
from ..hot import DEFAULT_LIMIT, hot_entities, tasks_for
from .account import ACCOUNT_FEATURES, account_features
from .counterparty import DEVICE_FEATURES, MERCHANT_FEATURES, device_features, merchant_features
from .customer import CUSTOMER_FEATURES, customer_features, mandate_features

# Carried next to the features for slicing and reporting, never as inputs.
META = ["txn_id", "ts", "ts_us", "customer_id", "is_fraud", "vector_id", "benign_anomaly",
        "campaign_id", "narrative_id", "strain_id"]

# Missing for a payment whose device, merchant, account or mandate is absent.
_ABSENT = {
    "amount_to_merchant_mean": 1.0,
    "benef_dwell_secs": K.NEVER_SECS,
    "sender_dwell_secs": K.NEVER_SECS,
}


def row_columns(weekday_mode: str = "calendar") -> dict[str, Column]:
    """Features that need nothing but the row and its dimension lookups."""
    amount, us = F.col("amount"), F.col("ts_us")
    category = F.coalesce("merchant_category", F.lit("unknown"))
    balance = F.greatest(F.lit(1.0), C.or_one("customer_balance"))
    day = C.day_index(us, weekday_mode)
    angle = C.hour_angle(us)
    lat, lon = F.col("lat").cast("double"), F.col("lon").cast("double")
    home_country = F.when(F.col("__has_home"), F.col("home_country")).otherwise(F.col("country"))
    share, session = C.observed("screen_share"), C.observed("session_duration_s")
    agentic, ceiling = C.or_default("is_agentic"), C.or_default("mandate_ceiling")
    mandated = (agentic != 0) & (ceiling > 0)
    typical = F.coalesce("typical_amount", F.greatest(F.lit(200.0), amount))
    intent = F.coalesce(F.col("mandate_intent_category") == category, F.lit(False))
    cols = {
        "amount": amount,
        "log_amount": F.log1p(amount),
        "amount_to_balance": amount / balance,
        "amount_round_ness": C.is_round_hundred(amount),
        "amount_below_threshold_gap": C.threshold_gap(amount),
        "hour": C.hour_of_day(us),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
        "is_night": C.is_night(us),
        "day_of_week": day,
        "is_weekend": C.flag(day.isin(5.0, 6.0)),
        "dist_from_home_km": F.coalesce(
            C.haversine_km(
                F.when(F.col("__has_home"), F.col("home_lat")).otherwise(lat),
                F.when(F.col("__has_home"), F.col("home_lon")).otherwise(lon), lat, lon),
            F.lit(0.0)),
        "is_foreign": C.flag(~F.col("country").eqNullSafe(home_country)),
        "is_high_risk_country": C.flag(F.col("country").isin(*K.HIGH_RISK_COUNTRIES)),
        "merchant_is_foreign": C.flag(
            F.col("merchant_country").isNotNull() & ~F.col("merchant_country").eqNullSafe(home_country)),
        **{c: C.or_default(c) for c in (
            "device_age_days", "device_is_emulator", "device_is_rooted", "device_attested",
            "merchant_age_days", "threeds_result", "otp_attempts", "step_up_shown",
            "instrument_age_days", "customer_account_age_days", "agent_attested", "mandate_age_h",
            "mandate_scope_breadth", "human_confirmations")},
        "device_sim_count": C.or_one("device_sim_count"),
        "merchant_risk_tier": C.or_one("merchant_risk_tier"),
        "merchant_is_liquid": C.flag(category.isin(*K.LIQUID_CATEGORIES)),
        "merchant_chargeback_rate": F.coalesce("dim_chargeback_rate", F.lit(K.DEFAULT_CHARGEBACK_RATE)),
        "benef_age_days": F.when(F.col("beneficiary_id").isNotNull(), C.or_default("beneficiary_age_days"))
        .otherwise(0.0),
        **{c: C.observed(c) for c in K.OPTIONAL_TELEMETRY},
        "screen_share_and_new_benef": share * F.col("is_new_beneficiary"),
        "session_per_txn_value": session / F.greatest(F.lit(1.0), F.log1p(amount)),
        "customer_balance": balance,
        "is_agentic": agentic,
        "mandate_ceiling": ceiling,
        "mandate_ceiling_to_typical": F.when(mandated, ceiling / F.greatest(F.lit(100.0), typical)).otherwise(0.0),
        "mandate_drawdown_ratio": F.when(
            mandated, (F.coalesce("drawn", F.lit(0.0)) + amount) / ceiling).otherwise(0.0),
        "amount_to_mandate_ceiling": F.when(mandated, amount / ceiling).otherwise(0.0),
        "mandate_intent_match": F.when(mandated, C.flag(intent)).otherwise(1.0),
        "has_episode": C.flag(F.col("episode_turn_count").isNotNull()),
        "episode_turns": F.coalesce(F.col("episode_turn_count").cast("double"), F.lit(0.0)),
        "episode_duration_s": F.coalesce("episode_duration", F.lit(0.0)),
        "coercion_score": C.or_default("coercion_score"),
        "cat_rail": C.ordinal(F.col("rail"), K.RAILS),
        "cat_auth_method": C.ordinal(F.col("auth_method"), K.AUTH_METHODS),
        "cat_merchant_category": C.ordinal(category, K.CATEGORIES, len(K.CATEGORIES) - 1),
        "cat_persona": C.ordinal(F.col("persona"), K.PERSONAS),
        "cat_device_os": C.ordinal(F.col("device_os"), K.DEVICE_OS, len(K.DEVICE_OS) - 1),
    }
    return cols


def _looked_up(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of a dimension. Payments without the key match nothing; they are dealt out
    evenly instead of meeting in one task."""
    alone = F.when(F.col(key).isNull(), F.xxhash64("txn_id", "ts_us")).otherwise(F.lit(0).cast("long"))
    # Zero on this side, but not as a constant: the planner would take that out of the join's keys.
    there = dim.withColumn("__alone", F.pmod(F.xxhash64(key), F.lit(1)).cast("long"))
    return df.withColumn("__alone", alone).join(there, [key, "__alone"], "left").drop("__alone")


def attach_dimensions(
    ledger: DataFrame,
    customers: DataFrame | None = None,
    merchants: DataFrame | None = None,
    episodes: DataFrame | None = None,
) -> DataFrame:
    """Left joins to the customer, merchant and episode tables, each optional.

    Unmatched rows fall back to the payment's own values. Spark picks broadcast
    or sort-merge from the real size of each dimension; none is forced.
    """
    df = ledger
    none = lambda t: F.lit(None).cast(t)
    if customers is not None:
        own = F.col("self_account") if "self_account" in customers.columns else none("string")
        dim = customers.select(
            "customer_id", F.col("lat").alias("home_lat"), F.col("lon").alias("home_lon"),
            F.col("country").alias("home_country"), own.alias("self_account"), F.lit(True).alias("__has_home"),
        )
        df = df.join(dim, "customer_id", "left").withColumn(
            "__has_home", F.coalesce("__has_home", F.lit(False)))
    else:
        df = df.withColumns({
            "home_lat": none("double"), "home_lon": none("double"), "home_country": none("string"),
            "self_account": none("string"), "__has_home": F.lit(False)})
    if merchants is not None:
        df = _looked_up(
            df, merchants.select("merchant_id", F.col("chargeback_rate").alias("dim_chargeback_rate")), "merchant_id")
    else:
        df = df.withColumn("dim_chargeback_rate", none("double"))
    if episodes is not None:
        score = [F.col("coercion_score").alias("__score")] if "coercion_score" in episodes.columns else []
        dim = episodes.select(
            F.col("episode_id").alias("narrative_id"), F.coalesce("turn_count", F.lit(0)).alias("episode_turn_count"),
            F.col("duration_s").cast("double").alias("episode_duration"), *score)
        df = _looked_up(df, dim, "narrative_id")
        if score:
            df = df.withColumn("coercion_score", F.coalesce("__score", "coercion_score")).drop("__score")
    else:
        df = df.withColumns({"episode_turn_count": none("int"), "episode_duration": none("double")})
    return df


def features(
    ledger: DataFrame,
    customers: DataFrame | None = None,
    merchants: DataFrame | None = None,
    episodes: DataFrame | None = None,
    columns: list[str] | None = None,
    weekday_mode: str = "calendar",
    limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Every payment with its reporting columns and the 110 causal features.

    ``columns`` restricts the result to some features; entities none of them
    needs are not computed at all. ``limit`` is the most rows of one key that a
    single task will hold (see ``hot``).
    """
    wanted = list(columns or FEATURE_NAMES)
    unknown = set(wanted) - set(FEATURE_NAMES)
    if unknown:
        raise ValueError(f"not a feature: {sorted(unknown)}")
    base = conform(ledger)
    wide = attach_dimensions(base, customers, merchants, episodes)
    need = set(wanted)
    if "screen_share_and_new_benef" in need:
        need.add("is_new_beneficiary")
    if "mandate_ceiling_to_typical" in need:
        need.add("typical_amount")
    if "mandate_drawdown_ratio" in need:
        need.add("drawn")

    with_account = base
    if customers is not None and "self_account" in customers.columns:
        with_account = base.join(customers.select("customer_id", "self_account"), "customer_id", "left")
    else:
        with_account = base.withColumn("self_account", F.lit(None).cast("string"))
    payments = with_account.select(
        "txn_id", "customer_id", "ts_us", "amount", F.col("beneficiary_id").cast("string").alias("beneficiary_id"),
        F.col("self_account").cast("string").alias("self_account"), "device_id", "merchant_id")

    agent_of = lambda hot: None if hot is None else AUTO
    entities = [
        (CUSTOMER_FEATURES, {"customer_id": ["customer_id"]}, lambda h: customer_features(base, h["customer_id"], tasks)),
        (DEVICE_FEATURES, {"device_id": ["device_id"]}, lambda h: device_features(base, h["device_id"], tasks)),
        (MERCHANT_FEATURES, {"merchant_id": ["merchant_id"]}, lambda h: merchant_features(base, h["merchant_id"], tasks)),
        (ACCOUNT_FEATURES, {"acct": ["beneficiary_id", "self_account"]},
         lambda h: account_features(payments, h["acct"], limit, tasks)),
        (["drawn"], {"customer_id": ["customer_id"]},
         lambda h: mandate_features(base, agent_of(h["customer_id"]), limit)),
    ]
    used = [e for e in entities if need & set(e[0])]
    keys = {k: c for _, ks, _ in used for k, c in ks.items()}
    hot = hot_entities(payments, keys, "ts_us", limit) if keys else {}
    tasks = tasks_for(base) if keys else None
    missing = {}
    for names, _, build in entities:
        if need & set(names):
            wide = wide.join(build(hot), "txn_id", "left")
        else:
            missing |= {c: F.lit(None).cast("double") for c in names}
    wide = wide.withColumns(missing) if missing else wide
    exprs = dict(zip(FEATURE_NAMES, feature_columns(weekday_mode)))
    meta = [c for c in [*META, "rail"] if c in wide.columns]
    return wide.select(*meta, *[exprs[c] for c in wanted])


def feature_columns(weekday_mode: str = "calendar") -> list[Column]:
    """Final expressions of all features over the joined row, in published order."""
    local = row_columns(weekday_mode)
    nullable = {"session_ratio_customer", "hesitation_ratio_customer", "typing_variance_ratio"}
    out = []
    for name in FEATURE_NAMES:
        if name in local:
            out.append(local[name].alias(name))
        elif name in nullable:
            out.append(F.col(name))
        else:
            out.append(F.coalesce(F.col(name), F.lit(_ABSENT.get(name, 0.0))).alias(name))
    return out
