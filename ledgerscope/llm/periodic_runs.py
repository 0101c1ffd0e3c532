"""Periodic runs of words, found on a grammar of the text.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) and at least ``max(6, 4 q)`` words that no neighbouring word extends.

* *Grammar.* The word ids of a batch of documents are compressed by Re-Pair: the pairs of
  neighbours that are frequent become one new symbol each, round by round. Where two
  pairs compete for a word the more frequent one wins, which is the order in which Re-Pair
  takes them one at a time. What is left of each document is paired up until one symbol
  stands for it, so copies of a document, or of a passage, share their symbols.
* *Crossing runs.* Every run crosses the boundary of the lowest symbol that holds it. So
  for each symbol, once, the runs that cross its boundary are computed, on the first place
  in the batch where it stands for words.
* *Periods to try.* For periods from k to 2k - 1 the words k at a time are hashed. A run
  of four periods holds places whose k words next occur exactly one period later (a cyclic
  word has more than k different stretches of k), at most 6k words before or 2k behind the
  boundary. Each period found so is tried against the words themselves.
* *Translation.* Runs go from symbols to all places they are derived at; of those of one
  period the ones that lie inside another are parts of it.

Works on whole texts, batch by batch, without a shuffle. Memory is bounded by the batch or
by the longest text.

Nulls and odd input: null, empty and blank texts have no words and no runs. A null id has
no number to alter words by. Repeated rows give equal results. Other columns of any name
travel in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_WORDS = 6
LEAST_PERIODS = 4
CHUNK = 4_000_000  # characters looked at together
_STALE = 64  # Re-Pair ends when a round replaces less than one place in so many

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _C[1]
    h = (h ^ (h >> np.uint64(27))) * _C[2]
    return h ^ (h >> np.uint64(31))


def least_length(period):
    return np.maximum(LEAST_WORDS, LEAST_PERIODS * period)


class Grammar:
    """Rules of two symbols each over the words of several documents.

    Symbols are numbered with the words first; ``left``, ``right``, ``first`` (the place
    in the joined words where the symbol first stands) are those of the rules, in an order
    in which rules come after what they are made of. ``length`` covers all symbols and
    ``roots`` names one symbol for each document that has words.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.n_words = int(words.max()) + 1 if len(words) else 0
        self._rules: list[tuple[np.ndarray, ...]] = []
        self._lengths = [np.ones(self.n_words, np.int64)]
        self._next = self.n_words
        seq, at, doc = words.astype(np.int64), np.arange(len(words)), doc.astype(np.int64)
        repeats = True
        while True:
            same = doc[1:] == doc[:-1]
            if not same.any():
                break
            key = np.where(same, seq[:-1] * self._next + seq[1:], -1)
            if repeats:
                chosen = self._dominant(key)
                if chosen.sum() * _STALE < len(seq):
                    repeats = False
                    continue
            else:
                starts = np.flatnonzero(np.append(True, ~same))
                inside = np.arange(len(seq)) - starts[np.cumsum(np.append(False, ~same))]
                chosen = same & (inside[:-1] % 2 == 0)
            seq, at, doc = self._replace(seq, at, doc, key, np.flatnonzero(chosen))
        self.left, self.right, self.first = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*self._rules, strict=True)) if self._rules else [np.zeros(0, np.int64)] * 3
        self.length = np.concatenate(self._lengths)
        self.roots, self.root_at = seq, at

    @staticmethod
    def _dominant(key: np.ndarray) -> np.ndarray:
        """Places of repeated pairs that are at least as frequent as the pairs they overlap; of a pair that
        overlaps itself every second place."""
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(1, len(counts) + 1)
        rank[counts < 2] = 0
        rank = np.where(key >= 0, rank[inverse], 0)
        before, after = np.append(0, rank[:-1]), np.append(rank[1:], 0)
        where = np.arange(len(rank))
        stretch = np.maximum.accumulate(np.where(rank != before, where, 0))
        return (rank > 0) & (rank >= before) & (rank >= after) & ((where - stretch) % 2 == 0)

    def _replace(self, seq, at, doc, key, where):
        _, some, inverse = np.unique(key[where], return_index=True, return_inverse=True)
        left, right = seq[where[some]], seq[where[some] + 1]
        lengths = np.concatenate(self._lengths)
        self._lengths = [lengths, lengths[left] + lengths[right]]
        self._rules.append((left, right, at[where[some]]))
        seq = seq.copy()
        seq[where] = self._next + inverse
        self._next += len(some)
        keep = np.ones(len(seq), bool)
        keep[where + 1] = False
        return seq[keep], at[keep], doc[keep]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges low..high-1, and which range each is of."""
    n = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + low[owner], owner


def _near(size: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the places 0..size-1 lie in any of the ranges."""
    edge = np.bincount(low, minlength=size + 1) - np.bincount(high, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def periods_to_try(grammar: Grammar, words: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (rule, period): every run that crosses the boundary of a rule's symbol is among them.

    ``ends`` is for each word the place after its document's last one.
    """
    size = len(words)
    first, total = grammar.first, grammar.length[grammar.n_words :]
    middle = first + grammar.length[grammar.left]
    longest = int(total.max()) if len(total) else 0
    hashes = _mixed(words.astype(np.uint64) * _C[0] + doc.astype(np.uint64) * _C[3] + np.uint64(1))
    alive, found, k = None, [], 1
    while longest >= int(least_length(k)):
        rules = np.flatnonzero(total >= least_length(k))
        rules = rules[np.argsort(middle[rules], kind="stable")]
        low, high = np.maximum(first[rules], middle[rules] - 6 * k), np.minimum(first[rules] + total[rules], middle[rules] + 5 * k)
        wanted = _near(size, low, high)
        if k == 1:
            here = np.flatnonzero(wanted[:-1] & (words[1:] == words[:-1]) & (doc[1:] == doc[:-1]))
            period = np.ones(len(here), np.int64)
        else:
            half = k // 2
            hashes = _mixed(hashes[: len(hashes) - half] * _C[3] + hashes[half:])
            inside = np.arange(len(hashes)) + k <= ends[: len(hashes)]
            if alive is None:  # places whose two words occur again in their document
                places = np.flatnonzero(inside)
                order = places[np.argsort(hashes[places], kind="stable")]
                again = hashes[order][1:] == hashes[order][:-1]
                alive = np.zeros(size, bool)
                alive[order[1:][again]] = alive[order[:-1][again]] = True
            places = np.flatnonzero(wanted[: len(hashes)] & alive[: len(hashes)] & inside)
            order = places[np.argsort(hashes[places], kind="stable")]
            gap = order[1:] - order[:-1]
            next_ = (hashes[order][1:] == hashes[order][:-1]) & (gap >= k) & (gap < 2 * k)
            here, period = order[:-1][next_], gap[next_]
        place, anchor = _ranges(np.searchsorted(middle[rules], here - 2 * k, "right"), np.searchsorted(middle[rules], here + 6 * k, "right"))
        rule, i, q = rules[place], here[anchor], period[anchor]
        fits = (first[rule] <= i) & (i + q + k <= first[rule] + total[rule]) & (total[rule] >= least_length(q))
        found.append(np.unique(np.stack([rule[fits], q[fits]], 1), axis=0))
        k *= 2
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + ([n] if n > 1 else [])


def _stretches(equal: np.ndarray, middle: int, period: int) -> set[tuple[int, int]]:
    """The stretches of equal words around a boundary: the at most two that hold an end of the period before it."""
    breaks = np.flatnonzero(~equal)
    out = set()
    for j in (max(middle - period, 0), min(middle - 1, len(equal) - 1)):
        if equal[j]:
            k = int(np.searchsorted(breaks, j))
            out.add((int(breaks[k - 1]) + 1 if k else 0, int(breaks[k]) if k < len(breaks) else len(equal)))
    return out


def crossing_runs(grammar: Grammar, words: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """Rows (rule, start, end, period): the runs inside a rule's symbol that cross its boundary, from its first word."""
    runs = []
    total = grammar.length[grammar.n_words :]
    half = grammar.length[grammar.left]
    for rule, q in tries.tolist():
        f, n, middle = int(grammar.first[rule]), int(total[rule]), int(half[rule])
        seg = words[f : f + n]
        for s, e in _stretches(seg[:-q] == seg[q:], middle, q):
            e += q
            if e - s < least_length(q) or s >= middle or e <= middle:
                continue
            if any((seg[s : e - q // p] == seg[s + q // p : e]).all() for p in _factors(q)):
                continue  # a smaller period
            runs.append((rule, s, e, q))
    return np.array(runs, np.int64).reshape(-1, 4)


def derived_runs(grammar: Grammar, runs: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) at every place of the joined words that a symbol with runs is derived at, whole ones only."""
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    n, n_words = len(grammar.left), grammar.n_words
    low, high = np.searchsorted(runs[:, 0], np.arange(n)), np.searchsorted(runs[:, 0], np.arange(n), "right")
    holds = np.append(np.zeros(n_words, bool), high > low)
    start = 0
    for left, right, _ in grammar._rules:  # round by round: what a rule is made of comes before it
        stop = start + len(left)
        holds[n_words + start : n_words + stop] |= holds[left] | holds[right]
        start = stop
    symbol, at, out = grammar.roots, grammar.root_at, []
    while True:
        on = holds[symbol]
        rule, at = symbol[on] - n_words, at[on]
        if not len(rule):
            break
        which, owner = _ranges(low[rule], high[rule])
        out.append(runs[which, 1:] + np.stack([at[owner], at[owner], np.zeros(len(owner), np.int64)], 1))
        symbol = np.concatenate([grammar.left[rule], grammar.right[rule]])
        at = np.concatenate([at, at + grammar.length[grammar.left[rule]]])
    if not out:
        return np.zeros((0, 3), np.int64)
    all_ = np.unique(np.concatenate(out), axis=0)
    all_ = all_[np.lexsort((-all_[:, 1], all_[:, 0], all_[:, 2]))]
    keep, period, reach = np.zeros(len(all_), bool), -1, 0
    for i, (_, e, q) in enumerate(all_.tolist()):
        if q != period or e > reach:
            keep[i], period, reach = True, q, e
    return all_[keep]


def runs_of(documents: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of word ids its runs (start, length, period), by start, then period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    begins = np.cumsum(sizes) - sizes
    words = np.concatenate([*documents, np.zeros(0, np.int64)])
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if not len(words):
        return [np.zeros((0, 3), np.int64)] * len(documents)
    grammar = Grammar(words, doc)
    tries = periods_to_try(grammar, words, doc, (begins + sizes)[doc])
    found = derived_runs(grammar, crossing_runs(grammar, words, tries))
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    owner = np.searchsorted(begins, found[:, 0], "right") - 1
    # documents without words begin where the next one does: the last of them has the words
    cuts = np.searchsorted(owner, np.arange(len(sizes) + 1))
    found = np.stack([found[:, 0] - begins[owner], found[:, 1] - found[:, 0], found[:, 2]], 1)
    return [found[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def periodic_copy(n: int, number: int) -> np.ndarray | None:
    """Which word takes each of n places in a document altered by ``number``; None where nothing changes."""
    if number % 10 or not n:
        return None
    g = number // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def find_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """``row`` (all columns but the text), n_words, ``runs`` (array of start, length, period) and ``collapsed``:
    the words that no run repeats, joined by a space.

    With ``altered``, documents whose number asks for it are made periodic first
    (``periodic_copy``), which plants runs to find.
    """
    row = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    number = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) if altered else F.lit(None).cast("long")
    source = docs.select(row, number.alias("number"), "text")
    run_type = "array<struct<start: bigint, length: bigint, period: bigint>>"
    schema = T.StructType([source.schema["row"], *T._parse_datatype_string(f"n_words long, runs {run_type}, collapsed string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            start, size = 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK or i == len(texts) - 1:
                    yield _worked(batch.column(0).slice(start, i + 1 - start), texts[start : i + 1], numbers[start : i + 1])
                    start, size = i + 1, 0

    return source.mapInArrow(run, schema)


def _worked(rows: pa.Array, texts: list[str | None], numbers: list[int | None]) -> pa.RecordBatch:
    split = [(t or "").encode().split() for t in texts]
    ids = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words))}
    documents = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in split]
    for i, number in enumerate(numbers):
        at = None if number is None else periodic_copy(len(documents[i]), number)
        if at is not None:
            documents[i], split[i] = documents[i][at], [split[i][j] for j in at.tolist()]
    found = runs_of(documents)
    collapsed = []
    for words, runs in zip(split, found, strict=True):
        if len(runs):
            edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(words) + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=len(words) + 1)
            words = [w for w, more in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not more]
        collapsed.append(b" ".join(words).decode())
    flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [rows, pa.array([len(d) for d in documents], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), pa.array(collapsed, pa.string())],
        names=["row", "n_words", "runs", "collapsed"])
