"""Fixed values shared by features, rules, reports and the catalogue.

Everything in this module is a value that must agree with published results
(category lists, time spans, unit costs), stated as plain text.
"""

# Time spans, in microseconds.
SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 3_600 * SECOND_US
DAY_US = 86_400 * SECOND_US
WEEK_US = 7 * DAY_US
QUARTER_US = 90 * DAY_US

# "Never happened" marker for elapsed seconds.
NEVER_SECS = 999_999.0

# Ordinal category lists: the index in the list is the encoded value.
RAILS = ["upi_p2m", "upi_p2p", "card_cnp", "card_cp", "wallet", "agentic", "remittance"]
AUTH_METHODS = ["pin", "otp", "3ds", "biometric", "passkey", "mandate", "none"]
CATEGORIES = [
    "essentials", "food", "transport", "health", "retail", "digital", "financial", "cash",
    "highrisk", "travel", "luxury", "liquid", "education", "services", "unknown",
]
PERSONAS = ["salaried_urban", "student", "senior", "gig_worker", "sme_owner", "hnw", "homemaker"]
DEVICE_OS = ["android", "ios", "web", "android_tv", "unknown"]

# Membership sets.
LIQUID_CATEGORIES = ["liquid", "cash", "highrisk", "luxury", "financial"]
HIGH_RISK_COUNTRIES = ["NG", "UA", "PH", "HK"]

STEP_UP_THRESHOLDS = [5000.0, 25000.0, 50000.0, 100000.0]
DEFAULT_CHARGEBACK_RATE = 0.004

# Columns that may be absent because the channel did not capture them.
OPTIONAL_TELEMETRY = [
    "session_duration_s", "hesitation_ms", "app_switches", "form_corrections",
    "typing_variance", "screen_share", "call_active",
]

# Identifiers, labels and raw categories: never model inputs.
FORBIDDEN_FEATURES = {
    "is_fraud", "vector_id", "strain_id", "campaign_id", "benign_anomaly", "susceptibility",
    "dispute_filed", "txn_id", "customer_id", "merchant_id", "beneficiary_id", "device_id",
    "narrative_id", "agent_id", "city", "country", "merchant_country", "beneficiary_bank",
    "mcc", "merchant_category", "auth_method", "rail", "persona", "device_os",
    "mandate_intent_category", "lat", "lon", "ts",
}

# Unit economics of a decision.
COSTS = {
    "fraud_loss_ratio": 0.72,
    "review_cost": 55.0,
    "false_decline_cost": 420.0,
    "decline_share": 0.35,
}

# Operating point, splits, fusion.
ALERT_BUDGET = 0.02
TEST_SIZE = 0.30
CALIBRATION_SIZE = 0.18
NOVELTY_WEIGHT = 0.18
NOVELTY_TAIL_START = 0.985
NOVELTY_TAIL_WIDTH = 0.015
REVIEW_FRACTION = 0.55
POSITIVE_CLASS_WEIGHT = 6.0
REALISTIC_PREVALENCE = 0.0012
FPR_TARGETS = [0.001, 0.005, 0.01, 0.02, 0.05]

# Label noise and telemetry coverage.
MISSED_FRAUD_RATE = 0.14
FALSE_FRAUD_RATE = 0.0015
TELEMETRY_COVERAGE = 0.62

# Feedback rounds.
MINED_CAP = 2200
MINED_WEIGHT = 3.0
EVASION_TARGET = 0.05
FPR_BUDGET_MULTIPLIER = 1.25
MIN_VALUE_EXTRACTED = 4000.0
COST_PENALTY_WEIGHT = 0.55
PARAMETER_NAMES = [
    "aggression", "velocity", "device_hygiene", "spread", "mimicry", "dwell", "stealth",
    "narrative_intensity",
]

# Threat score weights and priority cut-offs.
THREAT_WEIGHTS = {
    "detection_gap": 0.30,
    "genai_uplift": 0.24,
    "impact": 0.20,
    "scale_velocity": 0.15,
    "feasibility": 0.11,
}
PRIORITY_CUTS = [("critical", 82), ("high", 70), ("medium", 56)]

# Which surface a stage hands over to.
SURFACE_CHAINS = {
    "model": ["authorisation", "authentication", "settlement"],
    "onboarding": ["settlement", "authorisation"],
    "authentication": ["authorisation"],
    "authorisation": ["settlement", "dispute"],
    "settlement": ["dispute"],
    "dispute": [],
}

# Channel ablations: columns blanked to 0 before a refit.
ABLATIONS = {
    "no_narrative": ["coercion_score", "has_episode", "episode_turns", "episode_duration_s"],
    "no_graph": [
        "benef_age_days", "benef_in_count_1h", "benef_in_count_24h", "benef_distinct_payers_24h",
        "benef_in_amt_24h", "benef_out_count_1h", "benef_passthrough_ratio", "benef_dwell_secs",
        "benef_tenure_days", "sender_passthrough_ratio", "sender_dwell_secs", "sender_in_24h",
        "device_customer_count",
    ],
    "no_session": [
        "session_duration_s", "session_ratio_customer", "hesitation_ms",
        "hesitation_ratio_customer", "app_switches", "form_corrections", "typing_variance",
        "typing_variance_ratio", "screen_share", "call_active", "screen_share_and_new_benef",
        "session_per_txn_value",
    ],
}

# The published feature set, in its published order.
FEATURE_NAMES = [
    "amount",
    "log_amount",
    "amount_z_customer",
    "amount_to_p95",
    "amount_to_balance",
    "amount_to_merchant_mean",
    "amount_round_ness",
    "amount_below_threshold_gap",
    "cust_txn_1h",
    "cust_txn_24h",
    "cust_txn_7d",
    "cust_amt_1h",
    "cust_amt_24h",
    "cust_amt_7d",
    "cust_burst_ratio",
    "secs_since_last_txn",
    "cust_txn_total",
    "cust_amt_24h_to_balance",
    "is_new_merchant",
    "is_new_beneficiary",
    "is_new_device",
    "is_new_city",
    "is_new_category",
    "cust_tenure_days",
    "cust_known_merchants",
    "cust_known_beneficiaries",
    "cust_known_devices",
    "hour",
    "hour_sin",
    "hour_cos",
    "is_night",
    "day_of_week",
    "is_weekend",
    "hour_deviation",
    "cust_night_rate",
    "dist_from_home_km",
    "dist_from_last_km",
    "travel_speed_kmh",
    "is_foreign",
    "is_high_risk_country",
    "merchant_is_foreign",
    "device_age_days",
    "device_is_emulator",
    "device_is_rooted",
    "device_sim_count",
    "device_attested",
    "device_customer_count",
    "device_txn_1h",
    "device_txn_24h",
    "device_tenure_days",
    "merchant_age_days",
    "merchant_risk_tier",
    "merchant_is_liquid",
    "merchant_txn_1h",
    "merchant_txn_24h",
    "merchant_distinct_customers",
    "merchant_repeat_rate",
    "merchant_chargeback_rate",
    "merchant_tenure_days",
    "benef_age_days",
    "benef_in_count_1h",
    "benef_in_count_24h",
    "benef_distinct_payers_24h",
    "benef_in_amt_24h",
    "benef_out_count_1h",
    "benef_passthrough_ratio",
    "benef_dwell_secs",
    "benef_tenure_days",
    "sender_passthrough_ratio",
    "sender_dwell_secs",
    "sender_in_24h",
    "session_duration_s",
    "session_ratio_customer",
    "hesitation_ms",
    "hesitation_ratio_customer",
    "app_switches",
    "form_corrections",
    "typing_variance",
    "typing_variance_ratio",
    "screen_share",
    "call_active",
    "screen_share_and_new_benef",
    "session_per_txn_value",
    "threeds_result",
    "otp_attempts",
    "step_up_shown",
    "instrument_age_days",
    "customer_account_age_days",
    "customer_balance",
    "cust_prior_disputes_90d",
    "cust_prior_dispute_rate",
    "is_agentic",
    "agent_attested",
    "mandate_ceiling",
    "mandate_age_h",
    "mandate_scope_breadth",
    "mandate_ceiling_to_typical",
    "mandate_drawdown_ratio",
    "mandate_intent_match",
    "human_confirmations",
    "amount_to_mandate_ceiling",
    "has_episode",
    "coercion_score",
    "episode_turns",
    "episode_duration_s",
    "cat_rail",
    "cat_auth_method",
    "cat_merchant_category",
    "cat_persona",
    "cat_device_os",
]
