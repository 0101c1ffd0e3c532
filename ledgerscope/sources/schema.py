"""Ledger, dimension and episode schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# DDL strings: readers take them as they are.

LEDGER_SCHEMA = """
    txn_id STRING, ts TIMESTAMP, customer_id STRING, persona STRING, rail STRING, amount DOUBLE,
    merchant_id STRING, mcc STRING, merchant_category STRING, merchant_risk_tier INT,
    merchant_age_days DOUBLE, merchant_country STRING,
    beneficiary_id STRING, beneficiary_bank STRING, beneficiary_age_days DOUBLE,
    device_id STRING, device_os STRING, device_age_days DOUBLE, device_is_emulator INT,
    device_is_rooted INT, device_sim_count INT, device_attested INT,
    city STRING, country STRING, lat DOUBLE, lon DOUBLE,
    auth_method STRING, otp_attempts INT, threeds_result INT, step_up_shown INT,
    session_duration_s DOUBLE, hesitation_ms DOUBLE, app_switches INT, form_corrections INT,
    typing_variance DOUBLE, screen_share INT, call_active INT,
    is_agentic INT, agent_id STRING, agent_attested INT, mandate_ceiling DOUBLE,
    mandate_age_h DOUBLE, mandate_scope_breadth DOUBLE, mandate_intent_category STRING,
    human_confirmations INT,
    instrument_age_days DOUBLE, dispute_filed INT, customer_balance DOUBLE,
    customer_account_age_days DOUBLE,
    susceptibility DOUBLE, is_fraud INT, vector_id STRING, strain_id STRING, campaign_id STRING,
    benign_anomaly STRING, narrative_id STRING, coercion_score DOUBLE
"""

CUSTOMER_SCHEMA = """
    customer_id STRING, persona STRING, city STRING, country STRING, lat DOUBLE, lon DOUBLE,
    account_age_days DOUBLE, self_account STRING, balance DOUBLE,
    devices ARRAY<STRUCT<device_id: STRING, os: STRING, age_days: DOUBLE, is_emulator: INT,
                         is_rooted: INT, sim_count: INT, attested: INT>>,
    contacts ARRAY<STRING>, known_merchants ARRAY<STRING>,
    rail_mix MAP<STRING, DOUBLE>, category_affinity MAP<STRING, DOUBLE>
"""

MERCHANT_SCHEMA = """
    merchant_id STRING, name STRING, mcc STRING, label STRING, category STRING, risk_tier INT,
    city STRING, country STRING, lat DOUBLE, lon DOUBLE, online_share DOUBLE, age_days DOUBLE,
    acquirer STRING, chargeback_rate DOUBLE
"""

ACCOUNT_SCHEMA = """
    account_id STRING, bank STRING, age_days DOUBLE, owner_customer STRING, is_mule BOOLEAN,
    mule_layer INT
"""

EPISODE_SCHEMA = """
    episode_id STRING, kind STRING, is_fraud INT,
    turns ARRAY<STRUCT<speaker: STRING, text: STRING>>, duration_s DOUBLE, channel STRING,
    vector_id STRING, text STRING, turn_count INT
"""

EDGE_SCHEMA = """
    src STRING, dst STRING, amount DOUBLE, ts TIMESTAMP, layer INT, campaign_id STRING
"""

LEDGER_TYPES = dict(c.split() for c in LEDGER_SCHEMA.split(","))

IDENTIFIERS = ["merchant_id", "beneficiary_id", "device_id", "city", "agent_id", "narrative_id",
               "merchant_country", "mandate_intent_category", "merchant_category"]


def conform(df: DataFrame) -> DataFrame:
    """A ledger with every expected column: absent ones are NULL, blank ids are NULL.

    Adds ``ts_us``, the event time in whole microseconds.
    """
    have = set(df.columns)
    cols = [
        F.col(name) if name in have else F.lit(None).cast(kind).alias(name)
        for name, kind in LEDGER_TYPES.items()
    ]
    extra = [c for c in df.columns if c not in {*LEDGER_TYPES, "ts_us"}]
    out = df.select(*cols, *extra)
    blanks = {
        c: F.when(F.col(c) != "", F.col(c))
        for c in IDENTIFIERS
        if isinstance(out.schema[c].dataType, T.StringType)
    }
    return out.withColumns({**blanks, "ts_us": F.unix_micros("ts")})
