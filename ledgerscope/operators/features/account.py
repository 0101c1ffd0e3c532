"""Money in and out of an account before a payment touches it.

A payment credits the beneficiary's account and debits the sender's own. Both
sides become events on one timeline per account; the payment then looks up the
timeline at its own instant, once as beneficiary and once as sender. No range
join is needed, because every lookup falls on an event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...constants import DAY_US, HOUR_US, NEVER_SECS, SECOND_US
from ...functions import columns as C
from ..causal import AUTO, Running, Trailing, causal, next_after
from ..hot import DEFAULT_LIMIT, dealt, hot_slices

ACCOUNT_FEATURES = [
    "benef_in_count_1h", "benef_in_count_24h", "benef_distinct_payers_24h", "benef_in_amt_24h",
    "benef_out_count_1h", "benef_passthrough_ratio", "benef_dwell_secs", "benef_tenure_days",
    "sender_passthrough_ratio", "sender_dwell_secs", "sender_in_24h",
]


def distinct_payer_steps(
    credits: DataFrame, span: int = DAY_US, hot: DataFrame | None | object = AUTO, limit: int = DEFAULT_LIMIT,
    tasks: int | None = None,
) -> DataFrame:
    """Up and down steps whose running sum is the distinct payers of a trailing span.

    A payer is counted from a credit until the span runs out or the payer's next
    credit takes over, so the intervals of one payer never overlap.
    """
    if hot is None:
        credits = dealt(credits, ["acct", "payer"], tasks)  # once for the visits and for what follows each of them
    visits = credits.groupBy("acct", "payer", "ts_us").agg(F.lit(1).alias("__one"))
    visits = next_after(visits, ["acct", "payer"], "ts_us", "next_us", hot, limit)
    ends = F.least(F.col("ts_us") + F.lit(span), F.col("next_us"))
    steps = F.array(
        F.struct(F.col("ts_us").alias("at"), F.lit(1).cast("long").alias("step")),
        F.struct(ends.alias("at"), F.lit(-1).cast("long").alias("step")),
    )
    return visits.select("acct", F.explode(steps).alias("s")).select(
        "acct", F.col("s.at").alias("ts_us"), F.col("s.step").alias("payer_step")
    )


def account_timeline(
    flows: DataFrame, hot: DataFrame | None | object = AUTO, limit: int = DEFAULT_LIMIT,
    columns: list[str] | None = None, tasks: int | None = None,
) -> DataFrame:
    """State of every account just before each instant at which it moves money.

    ``flows(src, dst, payer, ts_us, amount)``; either end may be NULL. One row
    per (acct, ts_us). ``columns`` restricts the result to some values;
    ``tasks`` is how many tasks share the rows.
    """
    micro = C.to_micro_units(F.col("amount"))
    us = F.col("ts_us")
    side = lambda acct, inn: F.struct(
        F.col(acct).cast("string").alias("acct"), F.lit(inn).cast("long").alias("inn")
    )
    moves = flows.select(
        us, micro.alias("micro"), F.explode(F.array(side("dst", 1), side("src", 0))).alias("e")
    ).select("ts_us", "micro", F.col("e.acct").alias("acct"), F.col("e.inn").alias("inn")).filter(
        F.col("acct").isNotNull()
    )
    credits = flows.filter(F.col("dst").isNotNull()).select(
        F.col("dst").cast("string").alias("acct"), F.col("payer").cast("string").alias("payer"), "ts_us"
    )
    if hot is AUTO:
        hot = hot_slices(moves, ["acct"], "ts_us", limit)
    # Only an over-full account can contain an over-full (account, payer) pair.
    steps = distinct_payer_steps(credits, hot=None if hot is None else AUTO, limit=limit, tasks=tasks)
    zero = F.lit(0).cast("long")
    outn = 1 - F.col("inn")
    events = moves.select(
        "acct", "ts_us",
        F.col("inn").alias("in_n"), (F.col("inn") * F.col("micro")).alias("in_amt"),
        outn.alias("out_n"), (outn * F.col("micro")).alias("out_amt"),
        F.when(F.col("inn") == 1, us).alias("in_us"), zero.alias("payer_step"),
        F.lit(True).alias("moves"),
    ).unionByName(
        steps.select(
            "acct", "ts_us", zero.alias("in_n"), zero.alias("in_amt"), zero.alias("out_n"),
            zero.alias("out_amt"), F.lit(None).cast("long").alias("in_us"), "payer_step",
            F.lit(False).alias("moves"),
        )
    )
    wanted = lambda aggs: [a for a in aggs if columns is None or a.name in columns]
    return causal(
        events, ["acct"], "ts_us",
        wanted([
            Running("credits", F.col("in_n")),
            Running("payers_24h", F.col("payer_step")),
            Running("last_in_us", F.col("in_us"), "max"),
            Running("first_in_us", F.col("in_us"), "min"),
        ]),
        wanted([
            Trailing("in_n_1h", F.col("in_n"), HOUR_US),
            Trailing("in_n_24h", F.col("in_n"), DAY_US),
            Trailing("in_amt_24h", F.col("in_amt"), DAY_US),
            Trailing("out_n_1h", F.col("out_n"), HOUR_US),
            Trailing("out_amt_24h", F.col("out_amt"), DAY_US),
        ]),
        hot=hot,
        collapse=True,
        asks=F.col("moves"),
        tasks=tasks,
    )


def account_features(
    payments: DataFrame, hot: DataFrame | None | object = AUTO, limit: int = DEFAULT_LIMIT, tasks: int | None = None
) -> DataFrame:
    """``txn_id`` plus beneficiary and sender account features.

    ``payments(txn_id, customer_id, ts_us, amount, beneficiary_id, self_account)``.
    """
    flows = payments.select(
        F.col("self_account").alias("src"), F.col("beneficiary_id").alias("dst"),
        F.col("customer_id").alias("payer"), "ts_us", "amount",
    )
    line = account_timeline(flows, hot, limit, tasks=tasks)
    # Each payment asks twice; one narrow shuffle on (account, time) answers both.
    asks = payments.select(
        "txn_id", "amount", "ts_us",
        F.explode(F.array(
            F.struct(F.lit("benef").alias("role"), F.col("beneficiary_id").cast("string").alias("acct")),
            F.struct(F.lit("sender").alias("role"), F.col("self_account").cast("string").alias("acct")),
        )).alias("a"),
    ).select("txn_id", "amount", "ts_us", "a.role", "a.acct").filter(F.col("acct").isNotNull())
    seen = asks.join(line, ["acct", "ts_us"])
    us, sec = F.col("ts_us"), F.lit(float(SECOND_US))
    in24, out24 = C.from_micro_units(F.col("in_amt_24h")), C.from_micro_units(F.col("out_amt_24h"))
    dwell = F.coalesce((us - F.col("last_in_us")) / sec, F.lit(NEVER_SECS))
    benef = {
        "benef_in_count_1h": F.col("in_n_1h").cast("double"),
        "benef_in_count_24h": F.col("in_n_24h").cast("double"),
        "benef_distinct_payers_24h": F.col("payers_24h").cast("double"),
        "benef_in_amt_24h": in24,
        "benef_out_count_1h": F.col("out_n_1h").cast("double"),
        "benef_passthrough_ratio": F.when(in24 > 1.0, out24 / in24).otherwise(0.0),
        "benef_dwell_secs": dwell,
        "benef_tenure_days": F.coalesce((us - F.col("first_in_us")) / F.lit(float(DAY_US)), F.lit(0.0)),
    }
    sender = {
        "sender_passthrough_ratio": F.when(in24 > 1.0, (out24 + F.col("amount")) / in24).otherwise(0.0),
        "sender_dwell_secs": dwell,
        "sender_in_24h": in24,
    }
    aggs = [F.max(F.when(F.col("role") == "benef", e)).alias(c) for c, e in benef.items()]
    aggs += [F.max(F.when(F.col("role") == "sender", e)).alias(c) for c, e in sender.items()]
    return seen.groupBy("txn_id").agg(*aggs).select("txn_id", *ACCOUNT_FEATURES)
