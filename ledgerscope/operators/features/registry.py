"""Features of a user's own, declared next to the 110 built-in ones and resolved into one plan.

A feature names what it needs and how it is built; nothing else has to be edited. Inputs
are names of features (built-in or registered, in any order) or ``ledger.<column>`` for a
column of the payment itself. A *row* feature is an expression over its inputs; a
*history* is a sum, count, mean, minimum or maximum over what the payment's entity did
strictly before it, in the whole past or a trailing span.

``table`` finds what the wanted names need, drops the rest, and works in steps. All
histories of one entity that can run together share one shuffle on the entity; an entity
waits while histories of its own still miss an input, unless all entities do. Hot entities
are found in one counting job and cut along time as everywhere (see ``hot``).

Nulls: a payment without the entity gets the default of its histories; null values are
not counted. Payments of one instant do not see each other. Names that are taken, unknown
inputs, cycles and inputs that give the label away raise ``ValueError``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...constants import FEATURE_NAMES, FORBIDDEN_FEATURES
from ...session import stored
from ...sources.schema import conform
from ..causal import Running, Trailing, causal
from ..hot import DEFAULT_LIMIT, hot_entities
from .assemble import features

LEDGER = "ledger."
KINDS = ("sum", "count", "mean", "min", "max")
#: Values are added as whole millionths, so that what a span takes back cancels exactly.
MILLIONTHS = 1_000_000


@dataclass(frozen=True)
class Feature:
    """One declared feature; a row feature has no entity."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., Column]
    default: float | None
    entity: str | None = None
    kind: str = "row"
    span: int | None = None


@dataclass(frozen=True)
class Step:
    """Features that are computed together: row features, or histories of one entity."""

    entity: str | None
    features: tuple[Feature, ...]


class Registry:
    """Declared features by name."""

    def __init__(self) -> None:
        self._features: dict[str, Feature] = {}

    def _add(self, feature: Feature) -> None:
        if feature.name in self._features or feature.name in FEATURE_NAMES:
            raise ValueError(f"feature {feature.name} is there already")
        known = {i.removeprefix(LEDGER) for i in feature.inputs}
        if leaks := FORBIDDEN_FEATURES & {feature.name, *known}:
            raise ValueError(f"gives the label away: {sorted(leaks)}")
        self._features[feature.name] = feature

    def row(self, name: str, inputs: list[str], default: float | None = None):
        """Declares an expression over ``inputs``; the function gets one column for each."""

        def add(build):
            self._add(Feature(name, tuple(inputs), build, default))
            return build

        return add

    def history(self, name: str, entity: str, kind: str, inputs: list[str] = (), span: int | None = None, default: float | None = 0.0):
        """Declares ``kind`` over the entity's earlier values; ``span`` in microseconds, None for the whole past.

        ``entity`` is a column of the ledger. The function gets one column for each input
        and returns the value of one payment (for ``count``, whether it counts).
        """
        if kind not in KINDS or (span is not None and kind in ("min", "max")):
            raise ValueError(f"no such history: {kind} with span {span}")

        def add(build):
            self._add(Feature(name, tuple(inputs), build, default, entity, kind, span))
            return build

        return add

    def steps(self, names: list[str]) -> tuple[list[str], list[Step]]:
        """Built-in features that ``names`` need, and the steps that compute the registered ones."""
        needed: dict[str, Feature] = {}
        builtin: set[str] = set()
        left = list(names)
        while left:
            name = left.pop()
            if name in FEATURE_NAMES:
                builtin.add(name)
            elif name in self._features:
                if name not in needed:
                    needed[name] = self._features[name]
                    left += [i for i in needed[name].inputs if not i.startswith(LEDGER)]
            else:
                raise ValueError(f"not a feature: {name}")
        done, steps = set(builtin), []
        while len(done) < len(builtin) + len(needed):
            waiting = [f for f in needed.values() if f.name not in done]
            ready = [f for f in waiting if all(i.startswith(LEDGER) or i in done for i in f.inputs)]
            if not ready:
                raise ValueError(f"features need each other: {sorted(f.name for f in waiting)}")
            rows = [f for f in ready if f.entity is None]
            if rows:
                chosen = Step(None, tuple(rows))
            else:
                # The entity that fewest of its own histories still keep waiting.
                late = {f.entity: sum(w.entity == f.entity for w in waiting) - sum(r.entity == f.entity for r in ready) for f in ready}
                entity = min(late, key=lambda e: (late[e], e))
                chosen = Step(entity, tuple(f for f in ready if f.entity == entity))
            steps.append(chosen)
            done |= {f.name for f in chosen.features}
        return [n for n in FEATURE_NAMES if n in builtin], steps

    def table(
        self, names: list[str], ledger: DataFrame, customers: DataFrame | None = None, merchants: DataFrame | None = None,
        episodes: DataFrame | None = None, limit: int = DEFAULT_LIMIT,
    ) -> DataFrame:
        """``txn_id`` and the wanted features, one row for each payment."""
        builtin, steps = self.steps(names)
        base = conform(ledger)
        used = [f for s in steps for f in s.features]
        raw = {i.removeprefix(LEDGER) for f in used for i in f.inputs if i.startswith(LEDGER)}
        entities = {s.entity for s in steps if s.entity}
        if unknown := (raw | entities) - set(base.columns):
            raise ValueError(f"not in the ledger: {sorted(unknown)}")
        carried = base.select("txn_id", *[F.col(c).alias(LEDGER + c) for c in sorted(raw | entities | {"ts_us"})])
        out = carried
        if builtin:
            out = out.join(features(ledger, customers, merchants, episodes, columns=builtin, limit=limit).select("txn_id", *builtin), "txn_id")
        hot = hot_entities(base, {e: [e] for e in sorted(entities)}, "ts_us", limit) if entities else {}
        for step in steps:
            if step.entity is None:
                out = out.withColumns({f.name: _filled(f.build(*_inputs(f)), f) for f in step.features})
                continue
            from_ledger = all(i.startswith(LEDGER) for f in step.features for i in f.inputs)
            if not from_ledger:
                out = stored(out, "registered")  # it is read twice from here on
            past = _histories(carried if from_ledger else out, step, hot[step.entity], limit)
            out = out.join(past, "txn_id", "left").withColumns({f.name: _filled(F.col(f"`{f.name}`"), f) for f in step.features})
        return out.select("txn_id", *names)


def _inputs(feature: Feature) -> list[Column]:
    return [F.col(f"`{i}`") for i in feature.inputs]


def _filled(value: Column, feature: Feature) -> Column:
    return value if feature.default is None else F.coalesce(value, F.lit(feature.default))


def _histories(rows: DataFrame, step: Step, hot: DataFrame | None, limit: int) -> DataFrame:
    """``txn_id`` and the step's histories, for payments that have the entity."""
    values, running, trailing, results = [], [], [], []
    for k, f in enumerate(step.features):
        value = f.build(*_inputs(f))
        if f.kind in ("min", "max"):
            values.append(value.cast("double").alias(f"__x{k}"))
            running.append(Running(f"__h{k}", F.col(f"__x{k}"), f.kind))
            results.append(F.col(f"__h{k}").alias(f.name))
            continue
        counted = F.coalesce(value.cast("boolean"), F.lit(False)) if f.kind == "count" else value.isNotNull()
        values += [counted.cast("long").alias(f"__n{k}")]
        wanted = [f"__n{k}"] if f.kind != "sum" else []
        if f.kind != "count":
            values.append(F.coalesce(F.round(value.cast("double") * MILLIONTHS).cast("long"), F.lit(0).cast("long")).alias(f"__x{k}"))
            wanted.append(f"__x{k}")
        for w in wanted:
            name = w.replace("__", "__h_")
            (running.append(Running(name, F.col(w))) if f.span is None else trailing.append(Trailing(name, F.col(w), f.span)))
        n, total = F.col(f"__h_n{k}"), F.col(f"__h_x{k}") / MILLIONTHS
        made = {"count": lambda: n.cast("double"), "sum": lambda: total, "mean": lambda: total / F.nullif(n, F.lit(0))}[f.kind]()
        results.append(made.alias(f.name))
    entity, at = F.col(f"`{LEDGER}{step.entity}`").alias("__entity"), F.col(f"`{LEDGER}ts_us`").alias("ts_us")
    events = rows.select("txn_id", entity, at, *values).filter("__entity IS NOT NULL")
    slices = None if hot is None else hot.withColumnRenamed(step.entity, "__entity")
    return causal(events, ["__entity"], "ts_us", running, trailing, limit=limit, hot=slices).select("txn_id", *results)
