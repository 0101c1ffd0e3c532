"""Structured Streaming jobs over a payment stream."""

from .keyed import KeyedFeatures, assembled
from .monitors import ClosedWindows, alerts, deduplicated, panes, running_counters, sliding_velocity, windows
from .online import OnlineFeatures

__all__ = ["ClosedWindows", "KeyedFeatures", "OnlineFeatures", "alerts", "assembled", "deduplicated", "panes", "running_counters", "sliding_velocity", "windows"]
