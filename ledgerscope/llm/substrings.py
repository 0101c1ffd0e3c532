"""Substring dedup by difference-cover anchors.

A word is removed when a window of ``window`` words that covers it starts anywhere else
too, in the same document or another.

* *Cover.* With a difference cover D of the residues modulo ``period``, any two places i, j
  have a shift s < period with (i + s) and (j + s) both in D. So only windows of
  ``window - period + 1`` words that start at places in D (about a quarter of all) are
  hashed, and any long match still has an anchor that both sides hold at the same place.
* *Shared anchors.* Anchors are counted by hash with map-side combining; those seen twice
  set a bit in a bitmap of fixed size, which every task gets.
* *Extension.* In a second pass, windows around a possibly shared anchor are hashed in
  full (128 bits); only hashes seen twice are repeats. A false "shared" is thus corrected;
  a full bitmap would only send more windows.

Repeats inside one batch are known at once: one window stands for them under the hash
itself, the others travel as one list for each document. A passage in a third of all
documents never gathers in one task.

Nulls and odd input: null and empty texts have no words. Repeated rows are each other's
repeats. Rows with the same id and different texts are told apart by a checksum of the
text. Very long texts are handled in one piece, in memory proportional to the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bitmap
from .common import saved

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)  # every residue modulo 21 is a difference of two of these
BITS = 26
CHUNK = 8_000_000


def covers(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


class _Text:
    """Words of a text, joined by single spaces, with where each one starts and ends."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.joined = b" ".join(self.words)

    def windows(self, at: np.ndarray, size: int) -> Iterator[bytes]:
        joined = self.joined
        for a, b in zip(self.starts[at].tolist(), self.ends[at + size - 1].tolist(), strict=True):
            yield joined[a:b]


def _anchor_places(n_words: int, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Places in the cover that lie in at least one full window."""
    size = window - period + 1
    if n_words < window:
        return np.zeros(0, np.int64)
    at = np.concatenate([np.arange(c, n_words - size + 1, period) for c in cover])
    return np.sort(at)


def _anchors(text: _Text, window: int, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    at = _anchor_places(len(text.words), window, period, cover)
    digest = xxhash.xxh3_64_intdigest
    return at, np.fromiter(map(digest, text.windows(at, window - period + 1)), np.uint64, len(at))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with a bounded amount of text (in the last column)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t)
            if size >= CHUNK or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0


def shared_anchors(docs: DataFrame, window: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """``h`` of every anchor that occurs at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            hashes = [_anchors(_Text(t), window, period, cover)[1] for t in texts]
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["h", "n"])

    counted = docs.select("text").mapInArrow(run, "h long, n byte").groupBy("h").agg(F.sum("n").alias("n"))
    return counted.where("n > 1").select("h")


def _candidate_starts(text: _Text, shared: np.ndarray, window: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Starts of the windows that hold a possibly shared anchor where the method would find it."""
    at, hashes = _anchors(text, window, period, cover)
    at = at[bitmap.holds(shared, hashes)] if len(at) else at
    last = len(text.words) - window
    marks = np.zeros(max(last, -1) + 2, np.int32)
    if len(at):  # a window starting up to period - 1 places before an anchor holds it
        np.add.at(marks, np.maximum(at - period + 1, 0), 1)
        np.add.at(marks, np.minimum(at, last) + 1, -1)
    return np.flatnonzero(np.cumsum(marks)[:-1] > 0)


_KEY = ["doc_id", "_sum"]
_SPREAD = 0x5851F42D4C957F2D  # an odd number


def repeated_windows(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, bits: int = BITS) -> DataFrame:
    """(doc_id, _sum, starts) of each document with repeats: the sorted starts of its repeated windows."""
    if not covers(cover, period) or period > window:
        raise ValueError("the cover must reach every difference modulo the period, and the period fit the window")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bitmap.build(shared_anchors(docs, window, period, cover), bits))
    source = docs.select("doc_id", "text")
    id_type = source.schema["doc_id"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            rows, starts, sums, digests, sums_of = [], [], [], [], {}
            for i, t in enumerate(texts):
                text = _Text(t)
                at = _candidate_starts(text, shared.value, window, period, cover)
                if len(at):
                    rows.append(np.full(len(at), i))
                    starts.append(at)
                    sums_of[i] = zlib.crc32(t.encode())
                    sums.append(np.full(len(at), sums_of[i], np.int64))
                    digests.extend(map(xxhash.xxh3_128_digest, text.windows(at, window)))
            if not rows:
                continue
            row, start, check = np.concatenate(rows), np.concatenate(starts), np.concatenate(sums)
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            order = np.lexsort((pair[:, 1], pair[:, 0]))
            same = np.append(False, (pair[order][1:] == pair[order][:-1]).all(axis=1))
            known = np.zeros(len(row), bool)
            known[order] = same | np.append(same[1:], False)
            spread = np.zeros(len(row), bool)  # all but the first of a run
            spread[order] = same
            alone = np.flatnonzero(~spread)
            owners, first = np.unique(row[spread], return_index=True)
            lists = np.split(start[spread], first[1:]) if len(owners) else []
            own = np.array([sums_of[i] for i in owners.tolist()], np.int64)
            ids = batch.column(0).take(pa.array(np.concatenate([row[alone], owners])))
            none = len(owners)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.concatenate([check[alone], own])), pa.array(start[alone].tolist() + [None] * none, pa.int32()),
                 pa.array([None] * len(alone) + lists, pa.list_(pa.int32())),
                 pa.array(np.concatenate([pair[alone, 0], own * _SPREAD])), pa.array(np.concatenate([pair[alone, 1], owners])),
                 pa.array(np.concatenate([known[alone], np.ones(none, bool)]))],
                names=["doc_id", "_sum", "start", "more", "h1", "h2", "known"])

    schema = T.StructType([id_type, *T._parse_datatype_string("_sum long, start int, more array<int>, h1 long, h2 long, known boolean").fields])
    candidates = source.mapInArrow(hashed, schema)
    same = Window.partitionBy("h1", "h2").orderBy("h1")
    others = F.lag("h1").over(same).isNotNull() | F.lead("h1").over(same).isNotNull()
    repeated = candidates.withColumn("_r", F.col("known") | others).where("_r")
    # A document's own starts only: bounded by its length.
    starts = F.flatten(F.collect_list(F.coalesce("more", F.array("start"))))
    return repeated.groupBy(*_KEY).agg(F.sort_array(F.array_distinct(starts)).alias("starts"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, bits: int = BITS) -> DataFrame:
    """``row`` (all columns but the text), text, ``kept`` (kept words joined by a space), n_words and n_removed."""
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    # Stored, so that the shuffle files of the windows are gone before the texts are shuffled.
    repeats = saved(repeated_windows(docs, window, period, cover, bits), "repeats")
    checked = docs.select("doc_id", row, "text", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("_sum"))
    found = repeats.select(F.col("doc_id").alias("_id"), F.col("_sum").alias("_check"), "starts")
    joined = checked.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_check")), "left")
    ordered = joined.select("row", "starts", "text")
    schema = T.StructType([ordered.schema["row"], ordered.schema["text"], *T._parse_datatype_string("kept string, n_words long, n_removed long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, total, removed = [], [], []
            for starts, t in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (t or "").encode().split()
                total.append(len(words))
                if starts.is_valid:
                    marks = np.zeros(len(words) + 1, np.int32)
                    at = starts.values.to_numpy()
                    np.add.at(marks, at, 1)
                    np.add.at(marks, at + window, -1)
                    words = [w for w, covered in zip(words, np.cumsum(marks)[:-1].tolist(), strict=True) if not covered]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                names=["row", "text", "kept", "n_words", "n_removed"])

    return ordered.mapInArrow(run, schema)
