"""Named queries over the generic tables, each with the SQL that checks it."""

from .registry import ORACLES, QUERIES
from . import feature_queries, model_queries, other_queries, report_queries, stream_queries  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
