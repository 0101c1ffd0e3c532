"""Causal per-payment features, one module per entity."""

from .assemble import FEATURE_NAMES, feature_columns, features
from .registry import Registry

__all__ = ["FEATURE_NAMES", "feature_columns", "features", "Registry"]
