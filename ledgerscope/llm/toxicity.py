"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes, in 2^18 places, of its words (lower case,
outer punctuation removed), of adjacent pairs and of pairs with one word between. FTRL
keeps a rate per coordinate, and its L1 term leaves few weights that are not zero, so
the model is a short pair of arrays (2^18 entries at most) that every task is given.

Fitting uses at most ``FIT_ROWS`` labelled rows, those with the smallest hash of the id
(the documented bound). They are dealt to ``SHARDS`` tasks; each task runs FTRL over its
rows from the common state, and the states are averaged per coordinate over the tasks
that touched it, for ``ROUNDS`` rounds. Scoring is a map over all texts with no shuffle.

Nulls and odd input: null or empty texts have the bias as their only feature. Labels
that are null are not used; several labels of one id count as toxic if one is. With no
labelled rows every score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, settle

BITS = 18
FIT_ROWS = 20_000
SHARDS = 2
ROUNDS = 4
HELD = 100_000  # words whose hashes a task keeps
TOLD = 1_000  # rows that leave a task at once
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 1.0
BIAS = 0  # the place of the intercept
_EDGE = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
_MASK = np.uint64((1 << BITS) - 1)
_PAIR, _SKIP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    """Hash of a word as it stands in a text, worked out once; starts anew at ``HELD`` words and with each task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:
            self.clear()
        bare = word.lower().strip(_EDGE).encode()
        value = self[word] = (zlib.crc32(bare) << 32 | zlib.adler32(bare)) if bare else 0
        return value


_HASHES = _WordHashes()


def places(text: str) -> np.ndarray:
    """Distinct feature places of a text, the bias among them."""
    found = text.split()
    h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
    h = h[h != 0]
    with np.errstate(over="ignore"):
        h = h * _MIX
        h ^= h >> np.uint64(29)
        mixed = [h, h[:-1] * _PAIR + h[1:], h[:-2] * _SKIP + h[2:] if len(h) > 2 else h[:0]]
        every = np.concatenate(mixed)
        every = (every * _PAIR) >> np.uint64(64 - BITS)
    return np.unique(np.append(every & _MASK, np.uint64(BIAS))).astype(np.int64)


def _packed(at: np.ndarray) -> bytes:
    """Ascending places in little more than two bytes each: how many have each top part, then the low 16 bits of all."""
    tops = np.bincount(at >> 16, minlength=1 << (BITS - 16))
    return tops.astype("<u4").tobytes() + (at & 0xFFFF).astype("<u2").tobytes()


def _unpacked(told: memoryview) -> np.ndarray:
    n = 1 << (BITS - 16)
    tops = np.repeat(np.arange(n) << 16, np.frombuffer(told, "<u4", n))
    return tops | np.frombuffer(told, "<u2", offset=4 * n)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fold(doc_id: Column) -> Column:
    """Remainder by five of the checksum of the id as text; 0 is held out."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Text and label of at most ``fit_rows`` labelled documents outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # Bounded: fit_rows pairs of an id and a label.
    return docs.select("doc_id", F.col("text").alias("_text")).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])


def fit(training: DataFrame, rounds: int = ROUNDS, shards: int = SHARDS) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero. ``training`` holds doc_id, _text and _label."""
    spark = training.sparkSession
    size = 1 << BITS
    schema = T.StructType([training.schema["doc_id"], *T._parse_datatype_string("_label int, _places binary").fields])

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for start in range(0, batch.num_rows, TOLD):
                part = batch.slice(start, TOLD)
                found = [_packed(places(text.as_py() or "")) for text in part.column("_text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label"), pa.array(found, pa.binary())], names=["doc_id", "_label", "_places"])
        _HASHES.clear()  # the worker goes on to other stages
        settle()

    dealt = training.select("doc_id", "_text", "_label").mapInArrow(featured, schema)
    dealt = dealt.repartition(shards, F.xxhash64("doc_id")).sortWithinPartitions(F.xxhash64("doc_id", F.lit(1)))
    dealt = dealt.persist()
    z, n = np.zeros(size), np.zeros(size)
    try:
        for _ in range(rounds):
            state = spark.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))

            def learned(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                z, n = (x.astype(np.float64) for x in state.value)
                touched = np.zeros(size, bool)
                for batch in batches:
                    labels = batch.column("_label").to_pylist()
                    for i, label in enumerate(labels):
                        at = _unpacked(batch.column("_places")[i].as_buffer())
                        w = _weights(z[at], n[at])
                        g = _sigmoid(w.sum()) - label
                        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                        z[at] += g - sigma * w
                        n[at] += g * g
                        touched[at] = True
                at = np.flatnonzero(touched)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(z[at]), pa.array(n[at])], names=["place", "z", "n"])

            # At most 2^18 rows come back.
            new = dealt.mapInArrow(learned, "place long, z double, n double").groupBy("place").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toArrow()
            at = new["place"].to_numpy()
            z[at], n[at] = new["z"].to_numpy(), new["n"].to_numpy()
            state.destroy()
            release(spark)  # a round's shuffle files go before the next one's come
    finally:
        dealt.unpersist()
    w = _weights(z, n)
    kept = np.flatnonzero(w)
    return kept, w[kept]


def score(docs: DataFrame, kept: np.ndarray, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` between 0 and 1 for every row. A text that is kept travels once."""
    shared = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int64), weights))
    told = [c for c in keep if c != "text"]
    source = docs.select(*told, "text")
    names = [*told, "text"] if "text" in keep else told
    schema = T.StructType([*source.select(*names).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, weights = shared.value
        dense = np.zeros(1 << BITS)
        dense[kept] = weights
        settle()
        for batch in batches:
            for start in range(0, batch.num_rows, TOLD):
                part = batch.slice(start, TOLD)
                scores = [_sigmoid(dense[places(t.as_py() or "")].sum()) if len(kept) else 0.0 for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, "score"])
        _HASHES.clear()
        settle()

    return source.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), fit_rows: int = FIT_ROWS) -> DataFrame:
    """Fits on the labelled documents and scores ``docs``."""
    return score(docs, *fit(training_rows(labelled_docs, labels, fit_rows)), keep)
