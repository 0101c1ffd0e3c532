"""Money-flow graph extracts: campaigns, degrees, node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import mask_identifier


def ledger_edges(ledger: DataFrame, customers: DataFrame) -> DataFrame:
    """Payer account to beneficiary, one edge per payment that has both ends."""
    own = customers.select("customer_id", F.col("self_account").alias("src"))
    return ledger.join(own, "customer_id").filter(
        F.col("src").isNotNull() & F.col("beneficiary_id").isNotNull()
    ).select("src", F.col("beneficiary_id").alias("dst"), "amount", "ts_us", "campaign_id", "txn_id")


def largest_campaign_id(edges: DataFrame) -> DataFrame:
    """The campaign with most edges; the smallest id wins a tie."""
    sizes = edges.filter(F.col("campaign_id").isNotNull()).groupBy("campaign_id").agg(F.count(F.lit(1)).alias("edges"))
    return sizes.orderBy(F.desc("edges"), "campaign_id").limit(1)


def earliest_edges(edges: DataFrame, n: int, order: list[str]) -> DataFrame:
    return edges.orderBy(*order).limit(n)


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree of every account, from one exploded aggregate."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return edges.select(F.explode(ends).alias("e")).groupBy(F.col("e.id").alias("id")).agg(
        F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def node_table(edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Degrees with account attributes and a masked label; unknown accounts stay."""
    dim = accounts.select(
        F.col("account_id").alias("id"), "bank", "age_days", "is_mule", "mule_layer")
    return degrees(edges).join(dim, "id", "left").select(
        "id", mask_identifier(F.col("id").cast("string")).alias("label"),
        F.coalesce("bank", F.lit("?")).alias("bank"), F.round("age_days", 1).alias("age_days"),
        F.coalesce("is_mule", F.lit(False)).alias("is_mule"), F.coalesce("mule_layer", F.lit(0)).alias("layer"),
        "in_degree", "out_degree")


def edges_by_layer(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("layer", F.lit(0)).alias("layer")).agg(
        F.count(F.lit(1)).alias("edges"), F.sum("amount").alias("amount"))


def largest_campaign(
    edges: DataFrame, accounts: DataFrame, max_edges: int | None = None, order: list[str] = ("ts_us",)
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the biggest campaign, or of its ``max_edges`` earliest edges.

    Edges without a campaign belong to none and are left out.
    """
    best = edges.join(F.broadcast(largest_campaign_id(edges).select("campaign_id")), "campaign_id")
    if max_edges is not None:
        best = earliest_edges(best, max_edges, list(order))
    return node_table(best, accounts), best


def account_activity(flows: DataFrame) -> DataFrame:
    """Whole-period fan-in, fan-out, totals and pass-through per account."""
    ends = F.array(
        F.struct(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(1).alias("inn"), F.col("amount")),
        F.struct(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(0).alias("inn"), F.col("amount")))
    # Two steps keep a hot account's counterparties out of a single task.
    pairs = flows.select(F.explode(ends).alias("e")).groupBy("e.id", "e.other", "e.inn").agg(
        F.count(F.lit(1)).alias("n"), F.sum("e.amount").alias("amount"))
    inn = F.col("inn") == 1
    total = pairs.groupBy("id").agg(
        F.sum(F.when(inn, 1).otherwise(0)).alias("payers"), F.sum(F.when(inn, 0).otherwise(1)).alias("payees"),
        F.coalesce(F.sum(F.when(inn, F.col("amount"))), F.lit(0.0)).alias("amount_in"),
        F.coalesce(F.sum(F.when(~inn, F.col("amount"))), F.lit(0.0)).alias("amount_out"))
    return total.withColumn(
        "passthrough", F.when(F.col("amount_in") > 1.0, F.col("amount_out") / F.col("amount_in")).otherwise(0.0))
