"""Online features from keyed state, evicted by event time.

Every payment becomes rows for the entities it touches: it tells an entity that something
happened, asks it what happened before, or both. Each entity has its state in RocksDB:
lifetime totals, which stay, and its recent events, which go when the longest span that
looks at them has passed. The entities of a kind are kept in ``buckets`` by hash, so that
Spark is asked for state once a bucket. A micro-batch reads the new payments and the state
of the buckets they touch, however long the history is. The answers of a payment are
merged by its id in the same micro-batch.

* *Busy entities.* ``busy`` names entities to be held in several parts: events are dealt to
  parts by what is counted apart (or by payment), questions go to all of them, and the
  answers add up.
* *Late payments.* Payments behind the watermark are dropped and counted by the engine
  where deliveries are deduplicated, before they reach any entity.
* *Order.* A payment sees what is strictly before it among all that has arrived with its
  own micro-batch or earlier. A stream in order gives exactly the batch features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..constants import DAY_US, HOUR_US, NEVER_SECS
from ..functions.columns import from_micro_units, to_micro_units

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 256  # groups of entities of a kind that are kept and answered together
_LATEST = np.int64(1 << 62)


@dataclass(frozen=True)
class Entity:
    """One kind of entity: the columns that name it, and what is kept about it.

    ``spans`` are the trailing spans counted (the longest is how long events stay),
    ``apart`` a column whose distinct values are counted over ``apart_span``. ``lifetime``
    keeps totals for ever; ``known`` also every value of ``apart`` ever seen. ``told_by``
    names the column of the id that an event is kept under, ``asked_by`` (role to column)
    those whose state a payment looks up. ``when`` restricts the events that count.
    """

    kind: str
    told_by: str
    asked_by: dict[str, str]
    spans: tuple[int, ...]
    apart: str | None = None
    apart_span: int = 0
    lifetime: bool = False
    known: bool = False
    when: str = "true"


ENTITIES = (
    Entity("customer", "customer_id", {"customer": "customer_id"}, (HOUR_US, DAY_US, 7 * DAY_US), "merchant_id", lifetime=True, known=True),
    Entity("dispute", "customer_id", {"dispute": "customer_id"}, (90 * DAY_US,), when="dispute_filed = 1"),
    Entity("device", "device_id", {"device": "device_id"}, (HOUR_US, DAY_US)),
    Entity("merchant", "merchant_id", {"merchant": "merchant_id"}, (HOUR_US, DAY_US), lifetime=True),
    Entity("account", "beneficiary_id", {"benef": "beneficiary_id", "sender": "self_account"}, (HOUR_US, DAY_US), "customer_id", DAY_US),
)


def _name(span: int) -> str:
    return f"{span // HOUR_US}h"


def _sum(role: str, column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("role") == role, F.col(column))), F.lit(0))


#: What each feature makes of a payment's answers, by role. Built when asked for: workers import this module too.
FEATURES: dict[str, Callable[[], Column]] = {
    "cust_txn_1h": lambda: _sum("customer", "n_1h"), "cust_txn_24h": lambda: _sum("customer", "n_24h"), "cust_txn_7d": lambda: _sum("customer", "n_168h"),
    "cust_amt_1h": lambda: from_micro_units(_sum("customer", "sum_1h")), "cust_amt_24h": lambda: from_micro_units(_sum("customer", "sum_24h")),
    "cust_amt_7d": lambda: from_micro_units(_sum("customer", "sum_168h")),
    "cust_txn_total": lambda: _sum("customer", "n_all"),
    "secs_since_last_txn": lambda: F.coalesce(F.min(F.when(F.col("role") == "customer", (F.col("ts_us") - F.col("last_us")) / 1e6)), F.lit(NEVER_SECS)),
    "is_new_merchant": lambda: F.coalesce(F.min(F.when((F.col("role") == "customer") & F.col("seen").isNotNull(), 1 - F.col("seen").cast("int"))), F.lit(0)),
    "cust_prior_disputes_90d": lambda: _sum("dispute", "n_2160h"),
    "device_txn_1h": lambda: _sum("device", "n_1h"), "device_txn_24h": lambda: _sum("device", "n_24h"),
    "merchant_txn_1h": lambda: _sum("merchant", "n_1h"), "merchant_txn_24h": lambda: _sum("merchant", "n_24h"),
    "benef_in_count_1h": lambda: _sum("benef", "n_1h"), "benef_in_count_24h": lambda: _sum("benef", "n_24h"),
    "benef_in_amt_24h": lambda: from_micro_units(_sum("benef", "sum_24h")),
    "benef_distinct_payers_24h": lambda: _sum("benef", "n_apart"),
    "sender_in_24h": lambda: from_micro_units(_sum("sender", "sum_24h")),
}


def questions(payments: DataFrame, entities: tuple[Entity, ...] = ENTITIES, busy: DataFrame | None = None) -> DataFrame:
    """One row for each payment, entity it touches and part of that entity.

    Needs txn_id, ts, amount and the columns the entities name. ``busy`` has kind, entity and parts.
    """
    us = F.unix_micros("ts")
    touched = []
    for e in entities:
        apart = F.col(e.apart).cast("string") if e.apart else F.lit(None).cast("string")
        for role, column in e.asked_by.items():
            tells = F.expr(e.when) if column == e.told_by else F.lit(False)
            touched.append(F.when(F.col(column).isNotNull(), F.struct(
                F.lit(e.kind).alias("kind"), F.col(column).cast("string").alias("entity"), F.lit(role).alias("role"),
                F.coalesce(tells, F.lit(False)).alias("tells"), F.xxhash64(apart).alias("apart"), apart.isNotNull().alias("has_apart"))))
    rows = payments.select("txn_id", "ts", us.alias("ts_us"), to_micro_units(F.col("amount")).alias("micro"), F.explode(F.filter(F.array(*touched), lambda t: t.isNotNull())).alias("t")).select("txn_id", "ts", "ts_us", "micro", "t.*")
    if busy is None:
        return rows.withColumn("part", F.lit(0))
    b = busy.select(F.col("kind").alias("_kind"), F.col("entity").cast("string").alias("_entity"), F.col("parts").cast("int").alias("_parts"))
    cut = rows.join(b, (F.col("kind") == F.col("_kind")) & (F.col("entity") == F.col("_entity")), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.when(F.col("has_apart"), F.col("apart")).otherwise(F.xxhash64("txn_id")), F.col("_parts")).cast("int")
    dealt = cut.withColumns({"_own": own, "part": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
    return dealt.withColumn("tells", F.col("tells") & (F.col("part") == F.col("_own"))).drop("_kind", "_entity", "_parts", "_own")


def _before(codes: np.ndarray, at: np.ndarray, asked: np.ndarray, when: np.ndarray) -> np.ndarray:
    """For each question, how many (code, time) pairs are smaller than its own; all at once, by one sort."""
    is_event = np.concatenate([np.zeros(len(asked), np.int8), np.ones(len(codes), np.int8)])
    order = np.lexsort((is_event, np.concatenate([when, at]), np.concatenate([asked, codes])))
    passed = np.empty(len(order), np.int64)
    passed[order] = np.cumsum(is_event[order])
    return passed[: len(asked)]


class EntityHistory(StatefulProcessor):
    """The states of the entities (or parts of busy ones) of one kind that share a bucket.

    All questions to a bucket in a micro-batch are answered together, in time that grows with
    their number and that of the events held, however many entities they are spread over and
    however many events fall into a span.
    """

    def __init__(self, entities: tuple[Entity, ...], late_ms: int = 0):
        self.entities = {e.kind: e for e in entities}
        self.late_ms = late_ms
        self.spans = sorted({s for e in entities for s in e.spans})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        named = "entities array<string>, parts array<int>, sizes binary"
        # Totals of an entity: payments, micro units, first and last time. Known: value and first time.
        self.life = handle.getValueState("life", f"{named}, totals binary, known binary")
        # Events of an entity: time, micro units and value counted apart.
        self.recent = handle.getValueState("recent", f"{named}, events binary")

    def _held(self, state, widths: tuple[int, ...]) -> tuple:
        """Names, parts, sizes and the tables of a state; all empty without one."""
        got = state.get() if state is not None else None
        got = got or ((), (), b"", *(b"" for _ in widths))
        tables = [np.frombuffer(x, np.int64).reshape(-1, w) for x, w in zip(got[3:], widths, strict=True)]
        return np.array(got[0], object), np.array(got[1], np.int64), np.frombuffer(got[2], np.int64), *tables

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        e = self.entities[key[0]]
        asked = pd.concat(list(rows), ignore_index=True)
        old, old_parts, sizes, events = self._held(self.recent, (3,))
        life, life_parts, known_sizes, totals, known = self._held(self.life if e.lifetime else None, (4, 2))
        names = pd.factorize(np.concatenate([old, life, asked["entity"].to_numpy(object)]))[0]
        parts = np.concatenate([old_parts, life_parts, asked["part"].to_numpy(np.int64)])
        codes, kinds = pd.factorize(names * (parts.max() + 1) + parts)
        first = np.unique(codes, return_index=True)[1]
        n, at_old, at_life = len(kinds), len(old), len(old) + len(life)
        named = np.concatenate([old, life, asked["entity"].to_numpy(object)])[first], parts[first]
        code, t = codes[at_life:], asked["ts_us"].to_numpy(np.int64)
        micro, apart = asked["micro"].to_numpy(np.int64), asked["apart"].to_numpy(np.int64)
        tells = asked["tells"].to_numpy(bool)
        has_apart = asked["has_apart"].to_numpy(bool)

        owner = np.concatenate([np.repeat(codes[:at_old], sizes), code[tells]])
        events = np.concatenate([events, np.stack([t[tells], micro[tells], apart[tells]], axis=1)])
        order = np.lexsort((events[:, 0], owner))
        owner, events = owner[order], events[order]
        at, money = events[:, 0], np.concatenate([[0], np.cumsum(events[:, 1])])
        begin, end = np.searchsorted(owner, np.arange(n)), np.searchsorted(owner, np.arange(n), side="right")
        now = {"n": np.zeros(n, np.int64), "micro": np.zeros(n, np.int64), "first": np.full(n, _LATEST), "last": np.full(n, -_LATEST)}
        for i, name in enumerate(now):
            now[name][codes[at_old:at_life]] = totals[:, i]
        last_known = now["last"].copy()
        np.add.at(now["n"], code[tells], 1)
        np.add.at(now["micro"], code[tells], micro[tells])
        np.minimum.at(now["first"], code[tells], t[tells])
        np.maximum.at(now["last"], code[tells], t[tells])

        before = _before(owner, at, code, t)
        out = {"txn_id": asked["txn_id"], "ts_us": t, "role": asked["role"], "part": asked["part"]}
        for span in self.spans:
            low = _before(owner, at, code, t - span) if span in e.spans else before
            out[f"n_{_name(span)}"] = before - low
            out[f"sum_{_name(span)}"] = money[before] - money[low]
        # Those at this instant or later are in the totals.
        out["n_all"] = now["n"][code] - (end[code] - before) if e.lifetime else 0
        out["sum_all"] = now["micro"][code] - (money[end[code]] - money[before]) if e.lifetime else 0
        some = before > begin[code]
        last = np.where(some, at[np.maximum(before - 1, 0)] if len(at) else -_LATEST, last_known[code])
        out["last_us"] = pd.array(last, "Int64")
        out["last_us"][~some & ~((last != -_LATEST) & (last < t))] = pd.NA
        out["n_apart"] = self._distinct(owner, at, events[:, 2], code, t, before, e.apart_span) if e.apart_span else 0
        out["seen"] = pd.array(np.zeros(len(t), bool), "boolean")
        if e.known:
            # The first time of each entity's value: from the state, and from what this micro-batch tells.
            table = pd.DataFrame({
                "code": np.concatenate([np.repeat(codes[at_old:at_life], known_sizes), code]), "apart": np.concatenate([known[:, 0], apart]),
                "us": np.concatenate([known[:, 1], np.where(tells & has_apart, t, _LATEST)])})
            earliest = table.groupby(["code", "apart"])["us"].transform("min").to_numpy()
            out["seen"] = pd.array(earliest[len(known):] < t, "boolean")
            out["seen"][~has_apart] = pd.NA
            table = table.assign(us=earliest).drop_duplicates(["code", "apart"])
            known = table[table["us"] != _LATEST].sort_values("code", kind="stable")
        else:
            out["seen"][:] = pd.NA
        yield pd.DataFrame(out)
        if tells.any():
            if e.lifetime:
                alive = np.flatnonzero(now["n"] > 0)
                held = np.bincount(known["code"], minlength=n)[alive] if e.known else np.zeros(len(alive), np.int64)
                self.life.update((
                    named[0][alive].tolist(), named[1][alive].tolist(), held.astype(np.int64).tobytes(), np.stack([now[c][alive] for c in now], axis=1).tobytes(),
                    known[["apart", "us"]].to_numpy(np.int64).tobytes() if e.known else b""))
            self._keep(named, owner, events, timerValues.getCurrentWatermarkInMs(), e)

    @staticmethod
    def _distinct(owner, at, apart, code, t, before, span) -> np.ndarray:
        """Distinct values in the span before each question. An event stands for its value until the
        value comes again or the span has passed."""
        order = np.lexsort((at, apart, owner))
        again = np.full(len(at), _LATEST)
        follows = (owner[order][1:] == owner[order][:-1]) & (apart[order][1:] == apart[order][:-1])
        again[order[:-1][follows]] = at[order[1:][follows]]
        return before - _before(owner, np.minimum(again, at + span), code, t)

    def _keep(self, named: tuple, owner: np.ndarray, events: np.ndarray, watermark_ms: int, e: Entity) -> None:
        """Drops the events that no payment still to come can see; wakes when the next entity has none left."""
        stay = events[:, 0] >= watermark_ms * 1000 - max(e.spans)
        owner, events = owner[stay], events[stay]
        if not len(owner):
            self.recent.clear()
            return
        held, sizes = np.unique(owner, return_counts=True)
        newest = events[np.cumsum(sizes) - 1, 0]
        self.recent.update((named[0][held].tolist(), named[1][held].tolist(), sizes.astype(np.int64).tobytes(), events.tobytes()))
        self.handle.registerTimer(int(newest.min() + max(e.spans)) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names, parts, sizes, events = self._held(self.recent, (3,))
        if len(events):
            self._keep((names, parts), np.repeat(np.arange(len(names)), sizes), events, timerValues.getCurrentWatermarkInMs(), self.entities[key[0]])
        yield from ()

    def close(self) -> None:
        pass


def answers(asked: DataFrame, entities: tuple[Entity, ...] = ENTITIES, buckets: int = BUCKETS) -> DataFrame:
    """The stream of what each entity (or part of one) says to each payment."""
    spans = sorted({s for e in entities for s in e.spans})
    counts = ", ".join(f"n_{_name(s)} long, sum_{_name(s)} long" for s in spans)
    rest = f"ts_us long, role string, part int, {counts}, n_all long, sum_all long, last_us long, n_apart long, seen boolean"
    schema = T.StructType([asked.schema["txn_id"], *T._parse_datatype_string(rest).fields])
    bucket = F.pmod(F.xxhash64("entity", "part"), F.lit(buckets)).cast("int")
    return asked.withColumn("bucket", bucket).groupBy("kind", "bucket").transformWithStateInPandas(
        statefulProcessor=EntityHistory(entities), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    ).withColumn("ts", F.timestamp_micros("ts_us"))


def merged_answers(partial: DataFrame, names: list[str]) -> DataFrame:
    """One row of features for each payment from all the answers to it; a table, not a stream."""
    return partial.groupBy("txn_id").agg(F.first("ts").alias("ts"), *[FEATURES[c]().cast("double").alias(c) for c in names])


@dataclass
class KeyedFeatures:
    """Use ``start`` on a ledger stream, read results with ``results``.

    ``customers`` brings the account a customer pays from. ``busy`` is a table of kind,
    entity and parts.
    """

    store: str
    columns: list[str] = field(default_factory=lambda: list(FEATURES))
    customers: DataFrame | None = None
    busy: DataFrame | None = None
    delay: str = "1 hour"
    entities: tuple[Entity, ...] = ENTITIES
    buckets: int = BUCKETS  # stays the same for the life of a store

    def start(self, stream: DataFrame, **trigger) -> StreamingQuery:
        first = stream.withWatermark("ts", self.delay).dropDuplicatesWithinWatermark(["txn_id"])
        if self.customers is None:
            told = first.withColumn("self_account", F.lit(None).cast("string"))
        else:
            c = self.customers.select(F.col("customer_id").alias("_c"), "self_account")
            told = first.join(c, F.col("customer_id") == F.col("_c"), "left").drop("_c")
        spark = stream.sparkSession
        with rocksdb(spark):
            return (
                answers(questions(told, self.entities, self.busy), self.entities, self.buckets)
                .writeStream.foreachBatch(self._write).outputMode("append")
                .option("checkpointLocation", f"{self.store}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start()
            )

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        merged_answers(batch, self.columns).write.mode("overwrite").parquet(f"{self.store}/features/batch={batch_id}")

    def results(self, spark: SparkSession, keep_batch: bool = False) -> DataFrame:
        found = spark.read.parquet(f"{self.store}/features")
        return found if keep_batch else found.drop("batch")

    def state(self, spark: SparkSession, name: str = "recent") -> DataFrame:
        """(kind, entity, part) of the entities that hold a state now: ``recent`` or ``life``."""
        held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", name).load(f"{self.store}/checkpoint")
        return held.select("key.kind", F.explode(F.arrays_zip("value.entities", "value.parts")).alias("e")).select("kind", F.col("e.entities").alias("entity"), F.col("e.parts").alias("part"))


def assembled(left: DataFrame, right: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Joins two streams of answers by payment: (txn_id, ts, the columns of both).

    Both have txn_id and ts. The event time is part of the key, so each side waits for the
    other only until the watermark has passed it; answers that come later are dropped and
    counted by the engine (``dropped_late``, operator ``symmetricHashJoin``).
    """
    a, b = left.withWatermark("ts", delay).alias("a"), right.withWatermark("ts", delay).alias("b")
    same = (F.col("a.txn_id") == F.col("b.txn_id")) & (F.col("a.ts") == F.col("b.ts"))
    own = [F.col(f"b.{c}") for c in right.columns if c not in ("txn_id", "ts")]
    return a.join(b, same).select(*[F.col(f"a.{c}") for c in left.columns], *own)


class rocksdb:  # noqa: N801
    """Streams started inside keep their state in RocksDB."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self):
        self.before = self.spark.conf.get(self.KEY)
        self.spark.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *_):
        self.spark.conf.set(self.KEY, self.before)


def dropped_late(query: StreamingQuery, operator: str = "dedupeWithinWatermark") -> int:
    """Rows behind the watermark that the engine dropped at an operator, over all micro-batches still reported."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators if op.operatorName == operator)
