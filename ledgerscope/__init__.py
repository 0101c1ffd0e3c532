"""Payment-ledger analytics on Spark: causal features, scoring, reports and feedback."""

__version__ = "0.1.0"
