"""History before each row: running and trailing aggregates that see only the past.

Every value at time t is computed from rows strictly before t. A trailing span
keeps rows with ``ts >= t - span``.

Trailing sums are a sweep: a row adds its value at ``ts`` and takes it back just
after ``ts + span``. That turns every span into the same running sum, so the cost
per row does not depend on how many rows a window holds, and one shuffle serves
all spans.

Hot keys are cut into time slices (see ``hot``). Each slice runs on its own; a
small table of slice totals supplies what earlier slices contribute.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hot import DEFAULT_LIMIT, SLICE, dealt, hot_slices, with_slice


AUTO = object()


@dataclass(frozen=True)
class Running:
    """Aggregate over the whole past of the key.

    ``kind``: ``sum`` (0 when empty), ``min`` / ``max`` (NULL when empty, structs
    allowed) or ``moments`` (yields ``<name>_n``, ``<name>_mean``, ``<name>_m2``
    over non-NULL values).
    """

    name: str
    value: Column
    kind: str = "sum"


@dataclass(frozen=True)
class Trailing:
    """Sum over ``[t - span, t)``. Give whole numbers: they cancel exactly."""

    name: str
    value: Column
    span: int


def _expire(df: DataFrame, trailing: list[Trailing], order: str, payload: list[str]) -> DataFrame:
    """One row per event, plus one per span in which it has something to take back."""
    shifts = [F.lit(0).cast("long")]
    for span in sorted({t.span for t in trailing}):
        gives = [F.coalesce(F.col(f"__v_{t.name}") != 0, F.lit(False)) for t in trailing if t.span == span]
        shifts.append(F.when(reduce(or_, gives), F.lit(span).cast("long")))
    df = df.withColumn("__shift", F.explode(F.array_compact(F.array(*shifts))))
    live = F.col("__shift") == 0
    cols = [(F.col(order) + F.col("__shift")).alias(order), (live & F.col("__live")).alias("__live")]
    cols += [F.when(live, F.col(c)).alias(c) for c in payload]
    for t in trailing:
        v = F.col(f"__v_{t.name}")
        cols.append(
            F.when(live, v).when(F.col("__shift") == t.span, -v).otherwise(F.lit(0)).alias(f"__v_{t.name}")
        )
    keep = [c for c in df.columns if c not in {order, "__shift", "__live", *payload} and not c.startswith("__v_")]
    return df.select(*keep, *cols)


def causal(
    df: DataFrame,
    key: list[str],
    order: str,
    running: list[Running] = (),
    trailing: list[Trailing] = (),
    limit: int = DEFAULT_LIMIT,
    hot: DataFrame | None | object = AUTO,
    collapse: bool = False,
    asks: Column | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Adds the requested history columns to every row of ``df``.

    ``hot`` is the slice table of the key; by default it is looked up here.

    ``collapse=True`` first sums rows that share key and time, so that even a
    pile of rows at one instant is a single entry; the result then has one row
    per (key, time) and is meant to be joined back on those columns. Only
    ``sum``, ``min`` and ``max`` are available there. ``asks`` then marks the rows
    whose times are wanted, the others only count; ``tasks`` is how many tasks share
    the rows (Spark's choice by default).
    """
    running, trailing = list(running), list(trailing)
    if hot is AUTO:
        hot = hot_slices(df, key, order, limit)
    if running and trailing and not collapse:
        # Running values first, on the plain rows: the copies that end trailing
        # spans would only slow them down. The shuffle on the key is shared.
        df = causal(df, key, order, running, hot=hot)
        running = []
    payload = [] if collapse else [c for c in df.columns if c not in {*key, order}]
    values = [a.value.alias(f"__v_{a.name}") for a in [*running, *trailing]]
    live = F.lit(True) if asks is None else asks
    events = df.select(*key, order, *payload, *values, live.alias("__live"))
    if collapse and hot is None:
        # No key is over-full, so its events travel once, before the copies that end spans
        # are made; sums per time and the windows then find them in place.
        events = dealt(events, key, tasks)
    if trailing:
        events = _expire(events, trailing, order, [*payload, *[f"__v_{a.name}" for a in running]])
    group = list(key)
    if hot is not None:
        events = with_slice(events, hot, key, order)
        group.append(SLICE)
    if collapse:
        merged = [F.max("__live").alias("__live")]
        if hot is not None:
            merged.append(F.max("__hot").alias("__hot"))
        for a in running:
            fold = {"sum": F.sum, "min": F.min, "max": F.max}[a.kind]
            merged.append(fold(f"__v_{a.name}").alias(f"__v_{a.name}"))
        merged += [F.sum(f"__v_{t.name}").alias(f"__v_{t.name}") for t in trailing]
        events = events.groupBy(*group, order).agg(*merged)

    past = Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    own = {}
    for a in [*running, *trailing]:
        v, n = F.col(f"__v_{a.name}"), a.name
        if _kind(a) == "sum":
            own[n] = F.coalesce(F.sum(v).over(past), F.lit(0))
        elif _kind(a) == "moments":
            own[f"{n}_n"] = F.count(v).over(past)
            own[f"{n}_mean"] = F.avg(v).over(past)
            own[f"{n}_m2"] = F.coalesce(F.var_pop(v).over(past) * F.count(v).over(past), F.lit(0.0))
        else:
            own[n] = (F.min if a.kind == "min" else F.max)(v).over(past)
    kept = [*key, order, *payload]
    out = events.select(*group, order, *payload, "__live", *[c.alias(n) for n, c in own.items()])
    if hot is None:
        return out.filter("__live").select(*kept, *own)
    carry = _carry(events.filter("__hot"), key, [*running, *trailing])
    out = out.filter("__live").join(carry, group, "left")
    return out.select(*kept, *_merge([*running, *trailing]))


def _kind(a: Running | Trailing) -> str:
    return getattr(a, "kind", "sum")


def _carry(events: DataFrame, key: list[str], aggs: list) -> DataFrame:
    """What all earlier slices of a hot key contribute, one row per slice."""
    totals = []
    for a in aggs:
        v, n = F.col(f"__v_{a.name}"), a.name
        if _kind(a) == "moments":
            totals += [F.count(v).alias(f"__tn_{n}"), F.avg(v).alias(f"__tm_{n}"), F.var_pop(v).alias(f"__tv_{n}")]
        else:
            fold = {"sum": F.sum, "min": F.min, "max": F.max}[_kind(a)]
            totals.append(fold(v).alias(f"__t_{n}"))
    slices = events.groupBy(*key, SLICE).agg(*totals)
    by_slice = Window.partitionBy(*key).orderBy(SLICE)
    earlier = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    every = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moments = [a.name for a in aggs if _kind(a) == "moments"]
    # Means are taken relative to the first slice's, which keeps the sums of
    # squares free of cancellation.
    slices = slices.withColumns({
        f"__b_{n}": F.coalesce(F.first(f"__tm_{n}", ignorenulls=True).over(every), F.lit(0.0)) for n in moments
    }) if moments else slices
    cols = []
    for a in aggs:
        n = a.name
        if _kind(a) == "moments":
            size, d = F.col(f"__tn_{n}"), F.coalesce(F.col(f"__tm_{n}") - F.col(f"__b_{n}"), F.lit(0.0))
            cnt = F.sum(size).over(earlier)
            s1 = F.sum(size * d).over(earlier)
            s2 = F.sum(size * (F.coalesce(F.col(f"__tv_{n}"), F.lit(0.0)) + d * d)).over(earlier)
            cols += [
                cnt.alias(f"__cn_{n}"),
                F.when(cnt > 0, F.col(f"__b_{n}") + s1 / cnt).alias(f"__cm_{n}"),
                F.when(cnt > 0, F.greatest(s2 - s1 * s1 / cnt, F.lit(0.0))).alias(f"__cv_{n}"),
            ]
        else:
            fold = {"sum": F.sum, "min": F.min, "max": F.max}[_kind(a)]
            cols.append(fold(f"__t_{n}").over(earlier).alias(f"__c_{n}"))
    return slices.select(*key, SLICE, *cols)


def _merge(aggs: list) -> list[Column]:
    """Own slice plus carry."""
    out = []
    for a in aggs:
        n = a.name
        if _kind(a) == "sum":
            out.append((F.col(n) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))).alias(n))
        elif _kind(a) == "moments":
            na, ma = F.col(f"{n}_n"), F.coalesce(F.col(f"{n}_mean"), F.lit(0.0))
            nb, mb = F.coalesce(F.col(f"__cn_{n}"), F.lit(0)), F.coalesce(F.col(f"__cm_{n}"), F.lit(0.0))
            share = F.when(na + nb > 0, nb / (na + nb)).otherwise(0.0)
            gap = F.when((na > 0) & (nb > 0), mb - ma).otherwise(0.0)
            mean = F.when(na == 0, mb).otherwise(ma + gap * share)
            m2 = F.col(f"{n}_m2") + F.coalesce(F.col(f"__cv_{n}"), F.lit(0.0)) + gap * gap * na * share
            out += [
                (na + nb).alias(f"{n}_n"),
                F.when(na + nb > 0, mean).alias(f"{n}_mean"),
                m2.alias(f"{n}_m2"),
            ]
        else:
            out.append((F.least if a.kind == "min" else F.greatest)(n, f"__c_{n}").alias(n))
    return out


def next_after(
    df: DataFrame, key: list[str], order: str, name: str,
    hot: DataFrame | None | object = AUTO, limit: int = DEFAULT_LIMIT,
) -> DataFrame:
    """Time of the key's next row strictly after this one; NULL for the last."""
    back = df.withColumn("__back", -F.col(order))
    out = causal(back, key, "__back", running=[Running("__next", F.col("__back"), "max")], hot=hot, limit=limit)
    return out.withColumn(name, -F.col("__next")).drop("__back", "__next")


def seen_since(
    df: DataFrame, key: list[str], order: str, visible: str, name: str, value: Column, span: int,
    limit: int = DEFAULT_LIMIT, hot: DataFrame | None | object = AUTO,
) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the key's rows of ``[t - span, t)`` that were visible before t.

    Two clocks: a row happens at ``order`` and its value becomes known at ``visible`` (never
    known where NULL). It counts from the later of both until the span from when it
    happened has passed, so a dispute filed weeks after its payment is not seen by the
    payments in between. Both ends are steps on the key's one timeline.
    """
    payload = [c for c in df.columns if c not in {*key, order}]
    start = F.greatest(F.col(order), F.col(visible))
    end = F.col(order) + F.lit(span)
    v = value.cast("long")
    counted = df.filter(F.col(visible).isNotNull() & (v != 0) & (start <= end))
    ends = F.array(F.struct(start.alias("at"), v.alias("step")), F.struct(end.alias("at"), (-v).alias("step")))
    steps = counted.select(*key, F.explode(ends).alias("__s")).select(
        *key, F.col("__s.at").alias(order), F.col("__s.step").alias("__step"), F.lit(False).alias("__ask"))
    asks = df.select(*key, order, F.lit(0).cast("long").alias("__step"), F.lit(True).alias("__ask"), F.struct(*payload).alias("__row"))
    line = asks.unionByName(steps, allowMissingColumns=True)
    out = causal(line, key, order, [Running(name, F.col("__step"))], limit=limit, hot=hot).filter("__ask")
    return out.select(*key, order, *[F.col(f"__row.{c}").alias(c) for c in payload], name)
