"""What each feature measures, in a few words: the text of a reason."""

FEATURE_TEXT = {
    "amount": "payment amount",
    "log_amount": "size of the amount on a log scale",
    "amount_z_customer": "amount in standard deviations from the customer's mean",
    "amount_to_p95": "amount against the 95th percentile of the customer's last sixty",
    "amount_to_balance": "share of the balance being paid",
    "amount_to_merchant_mean": "amount against the merchant's mean so far",
    "amount_round_ness": "how round the amount is",
    "amount_below_threshold_gap": "distance to the next reporting or step-up threshold",
    "cust_txn_1h": "customer's payments in the past hour",
    "cust_txn_24h": "customer's payments in the past 24 hours",
    "cust_txn_7d": "customer's payments in the past seven days",
    "cust_amt_1h": "customer's spending in the past hour",
    "cust_amt_24h": "customer's spending in the past 24 hours",
    "cust_amt_7d": "customer's spending in the past seven days",
    "cust_burst_ratio": "last day's pace against the week's",
    "secs_since_last_txn": "seconds since the customer's previous payment",
    "cust_txn_total": "payments of the customer so far",
    "cust_amt_24h_to_balance": "last day's spending against the balance",
    "is_new_merchant": "first payment of this customer to the merchant",
    "is_new_beneficiary": "first payment of this customer to the beneficiary",
    "is_new_device": "first payment of this customer from the device",
    "is_new_city": "first payment of this customer in the city",
    "is_new_category": "first payment of this customer in the category",
    "cust_tenure_days": "days since the customer's first payment",
    "cust_known_merchants": "merchants the customer has paid before",
    "cust_known_beneficiaries": "beneficiaries the customer has paid before",
    "cust_known_devices": "devices the customer has used before",
    "hour": "hour of the day",
    "hour_sin": "hour of the day, sine part",
    "hour_cos": "hour of the day, cosine part",
    "is_night": "made at night",
    "day_of_week": "day of the week",
    "is_weekend": "made on a weekend",
    "hour_deviation": "hours away from the customer's mean hour",
    "cust_night_rate": "share of the customer's payments made at night",
    "dist_from_home_km": "kilometres from the customer's home",
    "dist_from_last_km": "kilometres from the previous payment",
    "travel_speed_kmh": "speed needed since the previous payment",
    "is_foreign": "made outside the home country",
    "is_high_risk_country": "made in a country on the risk list",
    "merchant_is_foreign": "merchant sits in another country",
    "device_age_days": "days the device has been known",
    "device_is_emulator": "device reports an emulator",
    "device_is_rooted": "device reports root access",
    "device_sim_count": "SIM cards in the device",
    "device_attested": "device passed attestation",
    "device_customer_count": "customers seen on the device so far",
    "device_txn_1h": "device's payments in the past hour",
    "device_txn_24h": "device's payments in the past 24 hours",
    "device_tenure_days": "days since the device's first payment",
    "merchant_age_days": "days the merchant has existed",
    "merchant_risk_tier": "risk tier of the merchant",
    "merchant_is_liquid": "merchant sells goods as good as cash",
    "merchant_txn_1h": "merchant's payments in the past hour",
    "merchant_txn_24h": "merchant's payments in the past 24 hours",
    "merchant_distinct_customers": "customers the merchant has served so far",
    "merchant_repeat_rate": "payments per customer of the merchant",
    "merchant_chargeback_rate": "chargeback rate of the merchant",
    "merchant_tenure_days": "days since the merchant's first payment",
    "benef_age_days": "days the beneficiary account has existed",
    "benef_in_count_1h": "credits of the beneficiary in the past hour",
    "benef_in_count_24h": "credits of the beneficiary in the past 24 hours",
    "benef_distinct_payers_24h": "different payers of the beneficiary in 24 hours",
    "benef_in_amt_24h": "money received by the beneficiary in 24 hours",
    "benef_out_count_1h": "debits of the beneficiary in the past hour",
    "benef_passthrough_ratio": "share of its receipts the beneficiary sent on",
    "benef_dwell_secs": "seconds since the beneficiary was last credited",
    "benef_tenure_days": "days since the beneficiary's first movement",
    "sender_passthrough_ratio": "share of its receipts the sending account sent on",
    "sender_dwell_secs": "seconds since the sending account was last credited",
    "sender_in_24h": "credits of the sending account in 24 hours",
    "session_duration_s": "length of the session in seconds",
    "session_ratio_customer": "session length against the customer's mean",
    "hesitation_ms": "pause before confirming",
    "hesitation_ratio_customer": "pause against the customer's mean",
    "app_switches": "switches between apps in the session",
    "form_corrections": "corrections while filling the form",
    "typing_variance": "variance of the typing rhythm",
    "typing_variance_ratio": "typing variance against the customer's mean",
    "screen_share": "screen sharing active",
    "call_active": "phone call active",
    "screen_share_and_new_benef": "screen sharing active and beneficiary new",
    "session_per_txn_value": "session seconds per unit of value",
    "threeds_result": "outcome of the card scheme check",
    "otp_attempts": "attempts at the one-time password",
    "step_up_shown": "additional authentication shown",
    "instrument_age_days": "days since the instrument was added",
    "customer_account_age_days": "days since the account was opened",
    "customer_balance": "balance of the account",
    "cust_prior_disputes_90d": "disputes of the customer in 90 days",
    "cust_prior_dispute_rate": "share of the customer's payments disputed",
    "is_agentic": "started by a software agent",
    "agent_attested": "agent proved its identity",
    "mandate_ceiling": "most the mandate allows",
    "mandate_age_h": "hours since the mandate was given",
    "mandate_scope_breadth": "breadth of the mandate's scope",
    "mandate_ceiling_to_typical": "mandate's ceiling against the customer's typical amount",
    "mandate_drawdown_ratio": "share of the mandate already used",
    "mandate_intent_match": "category agrees with the mandate",
    "human_confirmations": "confirmations by a person",
    "amount_to_mandate_ceiling": "amount against the mandate's ceiling",
    "has_episode": "a conversation is linked",
    "coercion_score": "pressure score of the conversation",
    "episode_turns": "turns of the conversation",
    "episode_duration_s": "length of the conversation",
    "cat_rail": "payment rail",
    "cat_auth_method": "authentication method",
    "cat_merchant_category": "merchant category",
    "cat_persona": "customer persona",
    "cat_device_os": "operating system of the device",
}
