"""Views over the generic tables (events, orders, ...) in ledger shape.

Expressions are plain SQL understood by Spark and by ANSI engines alike, so the
same text defines a view for a query and for its check. Fractions are written
with an exponent, which both read as a double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hot import tasks_for


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return wall_clock_utc(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Uses all cores on an input of too few splits; leaves larger inputs alone.

    Joins by the key keep these parts, so a part is bounded in rows, not only as many as cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks_for(df) or cores, key) if df.rdd.getNumPartitions() < cores else df


def wall_clock_utc(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants whose UTC reading is the stored wall clock."""
    zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({
        c: F.from_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone()) for c in zoneless
    })


def pick(index: str, values: list[str]) -> str:
    """CASE expression choosing a literal by position; NULL beyond the list."""
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


# Each payment is one event; ``k`` is the number in its properties.
LEDGER_COLUMNS = {
    "txn_id": "event_id",
    "ts": "ts",
    "customer_id": "user_id",
    "persona": pick("user_id % 8", ["salaried_urban", "student", "senior", "gig_worker", "sme_owner", "hnw", "homemaker", "other"]),
    "rail": pick("(event_id * 5 + user_id) % 7", ["upi_p2m", "upi_p2p", "card_cnp", "card_cp", "wallet", "agentic", "remittance"]),
    "amount": "CASE WHEN event_id % 9 = 0 THEN CAST(100 * (1 + k) AS DOUBLE) WHEN event_id % 10 = 1 THEN value * 97 ELSE value END",
    "merchant_id": "CASE WHEN event_id % 11 <> 0 THEN 'm' || CAST(k AS VARCHAR(20)) END",
    "merchant_category": "CASE WHEN event_id % 12 <> 0 THEN " + pick("(k * 3 + event_id % 3) % 12", ["essentials", "food", "transport", "health", "retail", "digital", "financial", "cash", "highrisk", "travel", "luxury", "liquid"]) + " END",
    "merchant_risk_tier": "CAST(k % 4 AS INT)",
    "merchant_age_days": "CAST(k * 3 AS DOUBLE)",
    "merchant_country": "CASE WHEN event_id % 4 <> 0 THEN " + pick("k % 4", ["IN", "US", "NG", "GB"]) + " END",
    "beneficiary_id": "CASE WHEN event_id % 3 = 0 THEN 'u' || CAST((user_id * 7 + k % 5) % 150 AS VARCHAR(20)) END",
    "beneficiary_age_days": "CAST((k * 7 + event_id) % 45 AS DOUBLE)",
    "device_id": "CASE WHEN event_id % 13 <> 0 THEN 'd' || CAST((user_id + k % 3 * 50) % 160 AS VARCHAR(20)) END",
    "device_os": "CASE WHEN event_id % 14 <> 0 THEN " + pick("user_id % 4", ["android", "ios", "web", "android_tv"]) + " END",
    "device_age_days": "CAST(k * 2 AS DOUBLE)",
    "device_is_emulator": "CASE WHEN event_id % 15 = 0 THEN 1 WHEN event_id % 15 < 12 THEN 0 END",
    "device_is_rooted": "CASE WHEN event_id % 16 = 0 THEN 1 ELSE 0 END",
    "device_sim_count": "CASE WHEN event_id % 18 <> 0 THEN CAST(k % 3 AS INT) END",
    "device_attested": "CASE WHEN event_id % 6 = 0 THEN 0 ELSE 1 END",
    "city": "CASE WHEN event_id % 17 <> 0 THEN 'c' || CAST((user_id + CASE WHEN event_id % 5 = 0 THEN k ELSE 0 END) % 30 AS VARCHAR(20)) END",
    "country": "CASE WHEN event_id % 19 <> 0 THEN " + pick("(user_id + CASE WHEN event_id % 20 = 0 THEN 2 ELSE 0 END) % 4", ["IN", "US", "NG", "GB"]) + " END",
    "lat": "CAST((user_id * 37) % 140 - 60 AS DOUBLE) + (event_id % 7) * 0.05e0 + CASE WHEN event_id % 29 = 0 THEN 8.0e0 ELSE 0.0e0 END",
    "lon": "CAST((user_id * 53) % 300 - 150 AS DOUBLE) + (event_id % 11) * 0.04e0",
    "auth_method": pick("event_id % 8", ["pin", "otp", "3ds", "biometric", "passkey", "mandate", "none", "unheard_of"]),
    "otp_attempts": "CASE WHEN event_id % 8 = 1 THEN CAST(1 + k % 3 AS INT) END",
    "threeds_result": "CASE WHEN event_id % 8 = 2 THEN 1 ELSE 0 END",
    "step_up_shown": "CASE WHEN value > 60 THEN 1 ELSE 0 END",
    "session_duration_s": "CASE WHEN event_id % 8 < 5 THEN CAST((event_id * 37) % 900 AS DOUBLE) + 1.5e0 END",
    "hesitation_ms": "CASE WHEN event_id % 8 < 5 THEN CAST((event_id * 91) % 4000 AS DOUBLE) END",
    "app_switches": "CASE WHEN event_id % 8 < 5 THEN CAST(k % 6 AS INT) END",
    "form_corrections": "CASE WHEN event_id % 8 < 5 THEN CAST(k % 4 AS INT) END",
    "typing_variance": "CASE WHEN event_id % 8 < 5 THEN ((event_id * 17) % 1000) / 5000.0e0 END",
    "screen_share": "CASE WHEN event_id % 8 < 5 THEN CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END END",
    "call_active": "CASE WHEN event_id % 8 < 5 THEN CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END",
    "is_agentic": "CASE WHEN event_id % 6 = 1 THEN 1 ELSE 0 END",
    "agent_id": "CASE WHEN event_id % 6 = 1 AND event_id % 5 <> 0 THEN 'a' || CAST(k % 4 AS VARCHAR(20)) END",
    "agent_attested": "CASE WHEN event_id % 6 = 1 THEN CAST(k % 2 AS INT) END",
    "mandate_ceiling": "CASE WHEN event_id % 6 = 1 AND k % 10 <> 0 THEN CAST(k * 50 AS DOUBLE) END",
    "mandate_age_h": "CASE WHEN event_id % 6 = 1 THEN CAST(k * 2 AS DOUBLE) END",
    "mandate_scope_breadth": "CASE WHEN event_id % 6 = 1 THEN (k % 10) / 10.0e0 END",
    "mandate_intent_category": "CASE WHEN event_id % 6 = 1 THEN " + pick("k * 3 % 12", ["essentials", "food", "transport", "health", "retail", "digital", "financial", "cash", "highrisk", "travel", "luxury", "liquid"]) + " END",
    "human_confirmations": "CASE WHEN event_id % 6 = 1 THEN CAST(k % 3 AS INT) END",
    "instrument_age_days": "CAST(k AS DOUBLE) / 100.0e0",
    "dispute_filed": "CASE WHEN event_id % 19 = 0 THEN 1 ELSE 0 END",
    "customer_balance": "CASE WHEN event_id % 21 <> 0 THEN CAST((user_id * 131) % 5000 AS DOUBLE) END",
    "customer_account_age_days": "CAST((user_id * 11) % 200 AS DOUBLE)",
    "is_fraud": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "vector_id": "CASE WHEN event_type = 'error' THEN 'v' || CAST((event_id * 3 + k) % 6 AS VARCHAR(20)) END",
    "strain_id": "CASE WHEN event_type = 'error' THEN 's' || CAST((event_id + k) % 24 AS VARCHAR(20)) END",
    "campaign_id": "CASE WHEN event_type = 'error' THEN 'g' || CAST(user_id % 40 AS VARCHAR(20)) END",
    "benign_anomaly": "CASE WHEN event_type <> 'error' AND event_id % 31 < 3 THEN " + pick("event_id % 31", ["travel", "big_ticket", "device_upgrade"]) + " END",
    "narrative_id": "CASE WHEN event_id % 5 = 0 THEN CAST(floor(event_id / 100.0e0) AS BIGINT) END",
    "coercion_score": "CAST(0 AS DOUBLE)",
}

CUSTOMER_COLUMNS = {
    "customer_id": "c_custkey",
    "persona": pick("c_custkey % 7", ["salaried_urban", "student", "senior", "gig_worker", "sme_owner", "hnw", "homemaker"]),
    "city": "'c' || CAST(c_custkey % 30 AS VARCHAR(20))",
    "country": pick("c_nationkey % 4", ["IN", "US", "NG", "GB"]),
    "lat": "CAST((c_custkey * 37) % 140 - 60 AS DOUBLE)",
    "lon": "CAST((c_custkey * 53) % 300 - 150 AS DOUBLE)",
    "self_account": "CASE WHEN c_custkey % 12 <> 5 THEN 'u' || CAST(c_custkey AS VARCHAR(20)) END",
    "balance": "c_acctbal",
}

MERCHANT_COLUMNS = {
    "merchant_id": "'m' || CAST(s_suppkey AS VARCHAR(20))",
    "category": pick("s_suppkey % 6", ["essentials", "food", "retail", "digital", "travel", "liquid"]),
    "chargeback_rate": "(s_suppkey % 50) / 1000.0e0",
    "age_days": "CAST(s_suppkey * 3 AS DOUBLE)",
}

# Scored payments for the report operators: orders with an arithmetic score.
SCORED_COLUMNS = {
    "txn_id": "o_orderkey",
    "customer_id": "o_custkey",
    "ts": "o_orderdate",
    "amount": "o_totalprice",
    "y": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "score": "CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 > 0 THEN 0.5e0 + ((o_orderkey * 7919) % 10007) / 20014.0e0 ELSE ((o_orderkey * 7919) % 10007) / 10007.0e0 END",
    "p_model": "((o_orderkey * 6271) % 9973) / 9973.0e0",
    "novelty": "((o_orderkey * 4241) % 1000) / 1000.0e0",
    "rule_score": "CASE WHEN o_orderkey % 23 = 0 THEN 0.88e0 WHEN o_orderkey % 29 = 0 THEN 0.72e0 ELSE 0.0e0 END",
    "rail": "o_orderpriority",
    "vector_id": "CASE WHEN o_orderstatus = 'F' THEN 'v' || CAST(o_custkey % 9 AS VARCHAR(20)) END",
    "benign_anomaly": "CASE WHEN o_orderstatus <> 'F' AND o_orderkey % 7 < 2 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'travel' ELSE 'big_ticket' END END",
}

HOLDOUT = ("v7", "v8", "v_unseen")


def _select(columns: dict[str, str]) -> list[str]:
    return [f"{e} AS {c}" for c, e in columns.items()]


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long").alias("k")
    events = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k)
    return spread(events, "event_id").selectExpr(*_select(LEDGER_COLUMNS))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*_select(CUSTOMER_COLUMNS))


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").selectExpr(*_select(MERCHANT_COLUMNS))


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations folded to one row: ordered turns, full text, duration."""
    turn = F.struct(F.col("turn").alias("at"), F.col("role").alias("speaker"), F.col("text"))
    folded = (
        read(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("ordered"))
    )
    turns = F.transform("ordered", lambda t: F.struct(t["speaker"].alias("speaker"), t["text"].alias("text")))
    return folded.select(
        F.col("conv_id").alias("episode_id"),
        F.expr("CASE WHEN conv_id % 3 = 0 THEN 'coercion' ELSE 'benign' END").alias("kind"),
        F.expr("CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END").alias("is_fraud"),
        turns.alias("turns"),
        F.aggregate("ordered", F.lit(0.0), lambda a, t: a + F.length(t["text"]) * 0.5).alias("duration_s"),
        F.expr("CASE conv_id % 2 WHEN 0 THEN 'voice' ELSE 'chat' END").alias("channel"),
        F.array_join(F.transform("ordered", lambda t: F.concat(t["speaker"], F.lit(": "), t["text"])), "\n").alias("text"),
        F.size("ordered").alias("turn_count"),
    )


def episode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn count and duration per conversation, without gathering its text."""
    return read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("episode_id")).agg(
        F.count(F.lit(1)).alias("turn_count"), (F.sum(F.length("text")) * 0.5).alias("duration_s"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per spoken turn, with the label of its conversation."""
    return read(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("episode_id"), "turn", F.concat("role", F.lit(": "), "text").alias("text"),
        F.expr("CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END").alias("is_fraud"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "orders")
        .selectExpr(*_select(SCORED_COLUMNS))
        .withColumn("ts_us", F.unix_micros("ts"))
        .withColumn("fired", F.expr(
            "filter(array(CASE WHEN txn_id % 23 = 0 THEN 'R-1' END, CASE WHEN txn_id % 29 = 0 THEN 'R-2' END, "
            "CASE WHEN txn_id % 31 = 0 THEN 'R-3' END), x -> x IS NOT NULL)"))
    )


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money edges: each order line pays from the customer to the supplier."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linenumber")
    order = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("o_custkey").alias("payer"),
        F.unix_micros("o_orderdate").alias("ts_us"), F.col("l_extendedprice").alias("amount"),
        F.col("l_linenumber").alias("layer"), (F.col("o_custkey") % 40).alias("campaign_id"),
        F.col("l_orderkey").alias("order_id"),
    )
