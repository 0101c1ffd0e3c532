"""Rules, channel fusion and the decision taken on a score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import holds, noisy_or


@dataclass(frozen=True)
class Rule:
    """A named predicate over feature columns with the confidence it lends."""

    code: str
    confidence: float
    hint: str
    description: str
    predicate: Callable[[Callable[[str], Column]], Column]


# Codes, confidences and thresholds of the published rule set.
# ``f`` maps a feature name to its column.
RULES = [
    Rule("R-COERCION-01", 0.88, "AV-DIGITAL-ARREST", "Shared screen, first payment to this payee, over 3x the usual high ticket",
         lambda f: (f("screen_share") > 0) & (f("is_new_beneficiary") > 0) & (f("amount_to_p95") > 3.0)),
    Rule("R-COERCION-02", 0.82, "AV-DIGITAL-ARREST", "On a call, new payee with a week-old account, over 5x the usual high ticket",
         lambda f: (f("call_active") > 0) & (f("is_new_beneficiary") > 0) & (f("benef_age_days") < 7.0)
         & (f("amount_to_p95") > 5.0)),
    Rule("R-MULE-01", 0.85, "AV-MULE-LAYER", "Payee account under a month old forwards money within five minutes",
         lambda f: (f("benef_dwell_secs") < 300.0) & (f("benef_passthrough_ratio") > 0.75) & (f("benef_age_days") < 30.0)),
    Rule("R-MULE-02", 0.80, "AV-QR-SWAP", "Payee account under 15 days old paid by eight or more customers in a day",
         lambda f: (f("benef_distinct_payers_24h") >= 8.0) & (f("benef_age_days") < 15.0)),
    Rule("R-MULE-03", 0.78, "AV-MULE-LAYER", "Young sender passes on what arrived less than 15 minutes ago",
         lambda f: (f("sender_dwell_secs") < 900.0) & (f("sender_passthrough_ratio") > 0.80)
         & (f("customer_account_age_days") < 60.0)),
    Rule("R-TESTING-01", 0.86, "AV-BIN-ENUM", "Small amount from a device used by eight or more customers",
         lambda f: (f("device_customer_count") >= 8.0) & (f("amount") < 250.0)),
    Rule("R-TAKEOVER-01", 0.72, "AV-AITM-OTP", "Over 400 km from the last payment at more than 900 km/h",
         lambda f: (f("travel_speed_kmh") > 900.0) & (f("dist_from_last_km") > 400.0)),
    Rule("R-TAKEOVER-02", 0.80, "AV-AITM-OTP", "New device, emulated or without attestation, over 4x the usual high ticket",
         lambda f: (f("is_new_device") > 0) & ((f("device_is_emulator") > 0) | (f("device_attested") < 1))
         & (f("amount_to_p95") > 4.0)),
    Rule("R-TOKEN-01", 0.83, "AV-TOKEN-PROV", "Instrument about an hour old spends over 2.5x the usual high ticket",
         lambda f: (f("instrument_age_days") < 0.042) & (f("amount_to_p95") > 2.5)),
    Rule("R-CLONE-01", 0.74, "AV-BIO-CLONE", "Typing far steadier than this customer, no corrections, new merchant",
         lambda f: (f("typing_variance_ratio") < 0.25) & (f("form_corrections") < 1.0) & (f("is_new_merchant") > 0)),
    Rule("R-AGENT-01", 0.84, "AV-AGENT-INJECT", "Agent buys outside its stated purpose, close to its ceiling",
         lambda f: (f("is_agentic") > 0) & (f("mandate_intent_match") < 1.0) & (f("amount_to_mandate_ceiling") > 0.7)),
    Rule("R-AGENT-02", 0.80, "AV-AGENT-MANDATE", "Ceiling over 20x normal spending, half drawn, never confirmed by a person",
         lambda f: (f("is_agentic") > 0) & (f("mandate_ceiling_to_typical") > 20.0) & (f("human_confirmations") < 1.0)
         & (f("mandate_drawdown_ratio") > 0.5)),
    Rule("R-MERCHANT-01", 0.70, "AV-FAKE-MERCH", "Merchant under a month old, many customers, none returning, high tickets",
         lambda f: (f("merchant_age_days") < 30.0) & (f("merchant_repeat_rate") < 0.05)
         & (f("merchant_distinct_customers") > 6.0) & (f("amount_to_merchant_mean") > 1.6)),
    Rule("R-DISPUTE-01", 0.68, "AV-FRIENDLY-FRAUD", "Three or more disputes in 90 days; resale category and ticket multiple sum above 2",
         lambda f: (f("cust_prior_disputes_90d") >= 3.0) & (f("merchant_is_liquid") + f("amount_to_p95") > 2.0)),
]


def apply_rules(
    df: DataFrame, rules: list[Rule] = RULES, feature: Callable[[str], Column] = F.col
) -> DataFrame:
    """Adds ``rule_score`` (highest confidence that fired) and ``fired`` (codes).

    A rule over a missing value does not fire.
    """
    fires = [(r, holds(r.predicate(feature))) for r in rules]
    score = F.greatest(F.lit(0.0), *[F.when(p, r.confidence).otherwise(0.0) for r, p in fires])
    codes = F.array_compact(F.array(*[F.when(p, r.code) for r, p in fires]))
    return df.withColumns({"rule_score": score, "fired": codes})


@dataclass(frozen=True)
class RuleScorer:
    """Adds ``score``, that of the rules alone; also for one feature replaced at a time, without a copy of the row."""

    rules: tuple[Rule, ...] = tuple(RULES)
    LOWEST = 0.0  # no score is below

    def __call__(self, df: DataFrame) -> DataFrame:
        return apply_rules(df, list(self.rules)).withColumn("score", F.col("rule_score"))

    def replaced(self, df: DataFrame, instead: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
        """The table with what every rule gives, and from it the score with each feature replaced by its column.

        Only the rules that look at a feature are tried anew.
        """
        gives = lambda r, f: F.when(holds(r.predicate(f)), r.confidence).otherwise(0.0)
        looks_at = [set() for _ in self.rules]
        for r, seen in zip(self.rules, looks_at, strict=True):
            r.predicate(lambda name, seen=seen: (seen.add(name), F.col(name))[1])
        out = df.withColumns({f"__r{i}": gives(r, F.col) for i, r in enumerate(self.rules)})
        scores = {
            c: F.greatest(F.lit(0.0), *[
                gives(r, lambda name, c=c: instead[c] if name == c else F.col(name)) if c in looks_at[i] else F.col(f"__r{i}")
                for i, r in enumerate(self.rules)])
            for c in instead}
        return out.withColumn("score", F.greatest(F.lit(0.0), *[F.col(f"__r{i}") for i in range(len(self.rules))])), scores


def rule_catalogue(spark: SparkSession, rules: list[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(
        [(r.code, r.description, r.confidence, r.hint) for r in rules],
        "code STRING, description STRING, confidence DOUBLE, vector_hint STRING",
    )


def novelty_contribution(novelty: Column, weight: float = K.NOVELTY_WEIGHT) -> Column:
    """Only the extreme tail of the anomaly percentile counts."""
    tail = (novelty - K.NOVELTY_TAIL_START) / K.NOVELTY_TAIL_WIDTH
    return F.least(F.greatest(tail, F.lit(0.0)), F.lit(1.0)) * weight


def fuse(df: DataFrame) -> DataFrame:
    """``p_model``, ``novelty`` and ``rule_score`` become ``novelty_contrib`` and ``score``."""
    return df.withColumn("novelty_contrib", novelty_contribution(F.col("novelty"))).withColumn(
        "score", noisy_or(F.col("p_model"), F.col("novelty_contrib"), F.col("rule_score")))


def decision(score: Column, cost_threshold: Column, budget_threshold: Column) -> Column:
    high, low = F.greatest(cost_threshold, budget_threshold), F.least(cost_threshold, budget_threshold)
    return (
        F.when(score >= high, "decline").when(score >= low, "step_up")
        .when(score >= low * K.REVIEW_FRACTION, "review").otherwise("approve")
    )


def outcome(y: Column, score: Column, threshold: Column) -> Column:
    """What became of a payment at a threshold."""
    alert = score >= threshold
    return (
        F.when((y == 1) & ~alert, "missed").when(y == 1, "fraud")
        .when(alert, "false_alert").otherwise("ok")
    )


def prevalence_adjusted(precision: Column, observed: Column, target: float = K.REALISTIC_PREVALENCE) -> Column:
    """Precision restated at another base rate, by Bayes odds."""
    odds = (precision / (1 - precision)) * ((1 - observed) / observed) * (target / (1 - target))
    return F.when((precision <= 0) | (precision >= 1), precision).otherwise(odds / (1 + odds))


def daily_load(alert_rate: Column, rows: Column, days: int = 30) -> Column:
    return F.round(alert_rate * rows / days)
