"""Column builders used across operators. All stay inside JVM code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import DAY_US, HOUR_US, STEP_UP_THRESHOLDS


def blank_to_null(c: Column) -> Column:
    """Empty identifiers count as absent."""
    return F.when(c.cast("string") == "", None).otherwise(c)


def or_default(name: str, default: float = 0.0) -> Column:
    """Missing becomes the default."""
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def or_one(name: str) -> Column:
    """Missing and zero both become one."""
    c = F.col(name).cast("double")
    return F.when(c.isNull() | (c == 0), 1.0).otherwise(c)


def observed(name: str) -> Column:
    """Optional telemetry: NaN is normalised to NULL, NULL stays NULL."""
    c = F.col(name).cast("double")
    return F.when(F.isnan(c), None).otherwise(c)


def flag(cond: Column) -> Column:
    """1.0 where the condition holds, 0.0 where it fails or is unknown."""
    return F.when(cond, 1.0).otherwise(0.0)


def holds(cond: Column) -> Column:
    """Two-valued predicate: unknown is False."""
    return F.coalesce(cond, F.lit(False))


def ts_micros(name: str = "ts") -> Column:
    return F.unix_micros(F.col(name))


def to_micro_units(c: Column) -> Column:
    """Money as whole millionths, so additions and expiries cancel exactly."""
    return F.round(c * 1_000_000).cast("long")


def from_micro_units(c: Column) -> Column:
    return c / F.lit(1_000_000.0)


def is_round_hundred(amount: Column) -> Column:
    return flag(F.abs(amount - F.round(amount / 100) * 100) < 1e-6)


def threshold_gap(amount: Column, thresholds=STEP_UP_THRESHOLDS) -> Column:
    """Relative distance to the nearest threshold at or above the amount; 1 above all of them."""
    above = F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: t >= amount)
    gaps = F.transform(above, lambda t: (t - amount) / t)
    return F.coalesce(F.array_min(gaps), F.lit(1.0))


def hour_of_day(ts_us: Column) -> Column:
    return F.pmod(ts_us, F.lit(DAY_US)) / F.lit(float(HOUR_US))


def hour_angle(ts_us: Column) -> Column:
    return hour_of_day(ts_us) * F.lit(2 * math.pi / 24.0)


def is_night(ts_us: Column) -> Column:
    h = hour_of_day(ts_us)
    return flag((h < 5.5) | (h >= 23.0))


def day_index(ts_us: Column, mode: str = "calendar") -> Column:
    """Day of week 0-6.

    ``calendar``: Monday is 0. ``epoch_mod7``: days since 1970-01-01 modulo 7
    (Thursday is 0), the published behaviour.
    """
    days = F.floor(ts_us / F.lit(DAY_US))
    shift = {"calendar": 3, "epoch_mod7": 0}[mode]
    return F.pmod(days + F.lit(shift), F.lit(7)).cast("double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def ordinal(c: Column, values: list[str], default: int = -1) -> Column:
    """Index of the value in a fixed list, the default when absent."""
    pos = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(pos > 0, pos - 1).otherwise(F.lit(default)).cast("double")


def mask_identifier(c: Column, keep: int = 4) -> Column:
    """First two characters, an ellipsis, the last ``keep``; short ids are left alone."""
    masked = F.concat(F.substring(c, 1, 2), F.lit("…"), F.substring(c, -keep, keep))
    return F.when(F.length(c) > keep, masked).otherwise(c)


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def noisy_or(*ps: Column) -> Column:
    keep = F.lit(1.0)
    for p in ps:
        keep = keep * (1.0 - p)
    return F.least(F.greatest(1.0 - keep, F.lit(0.0)), F.lit(1.0))


def uniform(seed: int, *cols: Column) -> Column:
    """Replay-stable uniform in [0, 1) from a row key; rand() would change on a task retry."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def json_safe(c: Column) -> Column:
    """NaN and infinities become NULL, the rest is rounded to six places."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, None).otherwise(F.round(c, 6))
