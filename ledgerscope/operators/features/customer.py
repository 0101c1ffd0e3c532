"""What the customer's own past says about a payment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...constants import DAY_US, HOUR_US, NEVER_SECS, QUARTER_US, SECOND_US, WEEK_US
from ...functions import columns as C
from ..causal import AUTO, Running, Trailing, causal
from ..firsts import first_seen, linear_percentile
from ..hot import DEFAULT_LIMIT

RECENT_AMOUNTS = 60

NOVELTY = {
    "merchant": "merchant_id",
    "beneficiary": "beneficiary_id",
    "device": "device_id",
    "city": "city",
    "category": "category",
}

CUSTOMER_FEATURES = [
    "amount_z_customer", "amount_to_p95",
    "cust_txn_1h", "cust_txn_24h", "cust_txn_7d", "cust_amt_1h", "cust_amt_24h", "cust_amt_7d",
    "cust_burst_ratio", "secs_since_last_txn", "cust_txn_total", "cust_amt_24h_to_balance",
    "is_new_merchant", "is_new_beneficiary", "is_new_device", "is_new_city", "is_new_category",
    "cust_tenure_days", "cust_known_merchants", "cust_known_beneficiaries", "cust_known_devices",
    "hour_deviation", "cust_night_rate", "dist_from_last_km", "travel_speed_kmh",
    "session_ratio_customer", "hesitation_ratio_customer", "typing_variance_ratio",
    "cust_prior_disputes_90d", "cust_prior_dispute_rate", "typical_amount",
]


def customer_features(ledger: DataFrame, hot: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """``txn_id`` plus every feature derived from the customer's history.

    Two shuffles on the customer: one for first sightings and the last sixty
    amounts, one for all running and trailing values together. ``hot`` holds the
    time slices of over-full customers, if any; ``tasks`` is how many tasks share the rows.
    """
    us = F.col("ts_us")
    rows = ledger.select(
        "txn_id", "customer_id", "ts_us", "amount", "merchant_id", "beneficiary_id", "device_id",
        "city", F.coalesce("merchant_category", F.lit("unknown")).alias("category"),
        F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        F.greatest(F.lit(1.0), F.coalesce(F.nullif("customer_balance", F.lit(0.0)), F.lit(1.0))).alias("bal"),
        C.observed("session_duration_s").alias("sess"), C.observed("hesitation_ms").alias("hes"),
        C.observed("typing_variance").alias("typ"),
        F.coalesce(F.col("dispute_filed") != 0, F.lit(False)).cast("int").alias("dispute"),
    )
    rows = first_seen(
        rows, ["customer_id"], "ts_us", "txn_id", NOVELTY,
        recent=("recent", "amount", RECENT_AMOUNTS), hot=hot, tasks=tasks,
    )
    rows = rows.withColumn("recent", F.sort_array("recent")).withColumns({
        "p95": linear_percentile(F.col("recent"), 0.95),
        "no_city": F.col("city").isNull().cast("int"),
        "micro": C.to_micro_units(F.col("amount")),
    }).drop("recent", *NOVELTY.values())
    angle = C.hour_angle(us)
    one = F.lit(1).cast("long")
    running = [
        Running("n", one),
        Running("log", F.log1p("amount"), "moments"),
        Running("night", C.is_night(us).cast("long")),
        Running("sin_sum", F.sin(angle)),
        Running("cos_sum", F.cos(angle)),
        Running("first_us", us, "min"),
        Running("last", F.struct("ts_us", "txn_id", "lat", "lon"), "max"),
        *[Running(f"known_{k}", F.col(f"{k}_first").cast("long")) for k in ("merchant", "beneficiary", "device")],
    ]
    for k in ("sess", "hes", "typ"):
        running += [Running(f"{k}_sum", F.col(k)), Running(f"{k}_n", F.col(k).isNotNull().cast("long"))]
    trailing = [Trailing("d90", F.col("dispute").cast("long"), QUARTER_US)]
    for tag, span in (("1h", HOUR_US), ("24h", DAY_US), ("7d", WEEK_US)):
        trailing += [Trailing(f"n_{tag}", one, span), Trailing(f"a_{tag}", F.col("micro"), span)]
    h = causal(rows, ["customer_id"], "ts_us", running, trailing, hot=hot)

    n = F.col("n")
    std = F.when(F.col("log_n") > 1, F.sqrt(F.col("log_m2") / (F.col("log_n") - 1)))
    gap_us = us - F.col("last.ts_us")
    last_km = C.haversine_km(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon"))
    ms, mc = F.col("sin_sum") / n, F.col("cos_sum") / n
    cosine = (F.sin(angle) * ms + F.cos(angle) * mc) / F.greatest(F.hypot(ms, mc), F.lit(1e-6))
    cosine = F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))

    def habit(k: str, floor: float):
        mean = F.col(f"{k}_sum") / F.nullif(F.col(f"{k}_n"), F.lit(0))
        return F.when(F.col(f"{k}_n") > 2, F.col(k) / F.greatest(F.lit(floor), mean))

    out = {
        "amount_z_customer": F.when(
            (F.col("log_n") >= 3) & (std > 1e-9), (F.log1p("amount") - F.col("log_mean")) / std
        ).otherwise(0.0),
        "amount_to_p95": F.coalesce(F.col("amount") / F.greatest(F.lit(50.0), F.col("p95")), F.lit(1.0)),
        **{f"cust_txn_{t}": F.col(f"n_{t}").cast("double") for t in ("1h", "24h", "7d")},
        **{f"cust_amt_{t}": C.from_micro_units(F.col(f"a_{t}")) for t in ("1h", "24h", "7d")},
        "cust_burst_ratio": F.col("n_24h") / F.greatest(F.lit(1.0), F.col("n_7d") / 7.0),
        "secs_since_last_txn": F.coalesce(gap_us / F.lit(float(SECOND_US)), F.lit(NEVER_SECS)),
        "cust_txn_total": n.cast("double"),
        "cust_amt_24h_to_balance": C.from_micro_units(F.col("a_24h")) / F.col("bal"),
        **{f"is_new_{k}": F.col(f"{k}_new").cast("double") for k in NOVELTY if k != "city"},
        # A payment without a city always counts as a new place.
        "is_new_city": F.greatest("city_new", "no_city").cast("double"),
        "cust_tenure_days": F.coalesce((us - F.col("first_us")) / F.lit(float(DAY_US)), F.lit(0.0)),
        "cust_known_merchants": F.col("known_merchant").cast("double"),
        "cust_known_beneficiaries": F.col("known_beneficiary").cast("double"),
        "cust_known_devices": F.col("known_device").cast("double"),
        "hour_deviation": F.when(n >= 3, 1.0 - cosine).otherwise(0.0),
        "cust_night_rate": F.col("night") / F.greatest(n, F.lit(1)),
        "dist_from_last_km": F.when(F.col("last").isNotNull(), F.coalesce(last_km, F.lit(0.0))).otherwise(0.0),
        "travel_speed_kmh": F.coalesce(
            last_km / F.greatest(F.lit(1e-3), gap_us / F.lit(float(HOUR_US))), F.lit(0.0)
        ),
        "session_ratio_customer": habit("sess", 1.0),
        "hesitation_ratio_customer": habit("hes", 1.0),
        "typing_variance_ratio": habit("typ", 1e-4),
        "cust_prior_disputes_90d": F.col("d90").cast("double"),
        "cust_prior_dispute_rate": F.col("d90") / F.greatest(n, F.lit(1)),
        "typical_amount": F.when(F.col("log_n") > 2, F.expm1("log_mean")),
    }
    return h.select("txn_id", *[out[c].alias(c) for c in CUSTOMER_FEATURES])


def mandate_features(ledger: DataFrame, hot: DataFrame | None | object = AUTO, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``txn_id, drawn``: what the same agent already drew for the same customer."""
    rows = ledger.filter((F.col("is_agentic") != 0) & (F.col("mandate_ceiling") > 0)).select(
        "txn_id", "customer_id", "ts_us",
        F.coalesce(F.col("agent_id").cast("string"), F.lit("None")).alias("agent"),
        C.to_micro_units(F.col("amount")).alias("micro"),
    )
    h = causal(rows, ["customer_id", "agent"], "ts_us", [Running("drawn_micro", F.col("micro"))], hot=hot, limit=limit)
    return h.select("txn_id", C.from_micro_units(F.col("drawn_micro")).alias("drawn"))
