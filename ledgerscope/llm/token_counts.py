"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where it is proven safe.

A long text is encoded in overlapping chunks with offsets. Two neighbours are joined at a
place inside their overlap where both have a token boundary and that is *proven* stable: a
space after a character that is none. No piece of the vocabulary holds a space mark after
another character (checked when the model is loaded), so no merge ever crosses such a
place, and what is on either side cannot change the other. If the overlap has no such
place, the left chunk is encoded anew with the overlap doubled, in the end to the end of
the text. A vocabulary without the property is never spliced.

Each text is worked on by itself: no shuffle, and memory is bounded by a chunk (or by the
longest stretch of a text without a stable place). Null counts as empty: no tokens.
Repeated rows are counted each. Only the named ``keep`` columns are carried along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 50_000
OVERLAP = 500
MARK = "▁"  # fixed: the library writes a space so


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.safe = not any(MARK in p.lstrip(MARK) for p in pieces)

    def _starts(self, text: str, a: int, b: int) -> list[int]:
        """Where the tokens of text[a:b] start, in characters of the whole text."""
        marked = self.model.encode(text[a:b], return_type="offset_mapping")
        return [a + s for s, _ in marked["offsets"]]

    def count(self, text: str) -> int:
        if len(text) <= self.chunk or not self.safe:
            return len(self.model.encode(text))
        total, start, begin, end = 0, 0, 0, self.chunk  # begin: tokens before it are counted already
        left = self._starts(text, start, end)
        while end < len(text):
            overlap, place = self.overlap, None
            while place is None:
                low = max(begin + 1, end - overlap)
                next_end = min(len(text), low + self.chunk)
                right = self._starts(text, low, next_end)
                place = self._splice(text, left, right, low + 1, end)
                if place is None:  # widen: the left chunk grows, and with it the overlap
                    overlap *= 2
                    end = min(len(text), end + overlap)
                    left = self._starts(text, start, end)
                    if end == len(text):
                        break
            if place is None:
                break
            total += bisect_left(left, place) - bisect_left(left, begin)
            start, begin, end, left = low, place, next_end, right
        return total + len(left) - bisect_left(left, begin)

    @staticmethod
    def _splice(text: str, left: list[int], right: list[int], low: int, high: int) -> int | None:
        """The last place from low up to, not including, high where both have a boundary that is stable."""
        here, space = set(right), (" ", MARK)
        for place in reversed(left[bisect_left(left, low) : bisect_left(left, high)]):
            if place in here and text[place] == " " and text[place - 1] not in space:
                return place
        return None


@lru_cache(2)
def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Counter:
    return Counter(path, chunk, overlap)


def token_counts(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096,
                 chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, chunk, overlap).count
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [*batch.columns[:-1], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([count(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
