"""Personal data by candidate gradient boosting.

Two layers, both within one pass over the texts:

* Base spans: email, ip, card and phone numbers by fixed patterns and checks.
* Candidates: generators with high recall propose overlapping spans (written-out
  addresses, numbers with other separators, long dotted or coloned groups). Boosted trees
  score each one from its format (digits, separators, groups, checks) and its context
  (neighbouring characters, words before it). Those at or above the threshold of their
  kind are added, best first, where they overlap nothing chosen before. Base spans stay.

Labels do not come from the base patterns, which would teach the trees to reject all that
the generators add. Examples for are values that are known to be personal data: the base
spans, each base span written another way in its own place (``+`` left out or ``00``,
``@`` and dots written out, other separators, fewer digits with a right check digit, IPv6),
and one made-up value a document, put between two of its words, so that a kind is learned
also where the corpus has none of its base spans. Examples against are those same spans
with a failed check, and candidates that fail one (check digit, octets, number of groups
or digits, dates, domains) or lie in a base span of another kind. All other candidates
have no label. An equal example counts once, and all of them are used. A fifth, by the
hash of the document, does not train but sets each kind's threshold: the lowest score down to
which at least ``PRECISION`` of what is taken is right (those of one score stand evenly mixed,
and all are taken). Kinds without such a score add nothing.

Fitting is a Spark job over every example. The features are cut at quantiles of all training
examples, examples alike in all cuts become one row with a count, and each level of each tree
is one pass that sums gradients by node, feature and cut (whole numbers, so the order of
adding does not matter). Only those sums, of fixed size, come to the driver.

Nulls and odd input: null counts as empty, with no spans. All patterns take time in
proportion to the text, also on very long runs of digits or letters. Rows are judged one
by one, so ties and repeated rows each get their own answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.995
TREES, DEPTH, RATE, BINS = 20, 3, 0.3, 16
CONTEXT = 24
UNIT = 1 << 20  # gradients are added in whole parts of this
STEPS = 1024  # of the log odds in which thresholds are set

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # index of the kind, start, end (code points, end exclusive)


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        tail = _DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            done = tail.end()
            yield 0, start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Checked matches, leftmost and without overlap per kind, by kind and start."""
    found = list(_emails(text))
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
            found.append((2, *m.span()))
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m.group())) <= 15]
    return found


# Generators: more than is wanted, each with bounded repeats.
_GENERATORS = (
    (0, re.compile(r"[^\s@]{1,64}@[^\s@]{1,64}")),
    (0, re.compile(r"(?<![\w.+-])[\w.+-]{1,40} ?[\[(]at[\])] ?[\w-]{1,40}(?: ?[\[(]dot[\])] ?[\w-]{1,20}|\.[\w-]{1,20}){1,3}", re.I)),
    (0, re.compile(r"(?<![\w.+-])[\w.+-]{1,40} at [\w-]{1,40}(?: dot [\w-]{1,20}){1,3}", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,4}(?:[.,·][0-9]{1,4}){3,5}(?![0-9])")),
    (1, re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    (2, re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])\+?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])00[0-9](?:[ ().-]{0,2}[0-9]){7,14}(?![0-9])")),
)
_HINTS = (
    re.compile(r"mail|contact|@", re.I), re.compile(r"\bip\b|host|server|addr", re.I),
    re.compile(r"card|visa|credit|pay", re.I), re.compile(r"tel|phone|call|fax|mobil", re.I),
)
_TEST = re.compile(r"[0-9@]| at |[(\[]at", re.I)


def candidates(text: str) -> list[Span]:
    """Spans of all generators and of the base patterns; they may overlap."""
    if not _TEST.search(text):
        return []
    found = {(kind, *m.span()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)}
    return sorted(found.union(base_spans(text)))


def _class(text: str, at: int) -> int:
    if at < 0 or at >= len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, start, end = span
    s, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits, groups = _only_digits(s), re.split(r"[^0-9A-Za-z]+", s.strip("()[]+ "))
    numbers = [int(g) for g in groups if g.isascii() and g.isdigit() and len(g) < 10]
    return [
        float(kind), len(s), len(digits), sum(c.isalpha() for c in s), len(groups), max(map(len, groups)), min(map(len, groups)),
        max(numbers, default=-1), s.count("."), s.count(","), s.count(" "), s.count("-"), s.count("@"), s.count(":"), s.count("("),
        float(s.startswith("+")), float(bool(digits) and luhn(digits)), int(digits[0]) if digits else -1, len(set(digits)),
        float(_DOMAIN.fullmatch(s.rpartition("@")[2]) is not None), _class(text, start - 1), _class(text, end),
        *(float(h.search(before) is not None) for h in _HINTS),
    ]


N_FEATURES = len(features("1", (0, 0, 1)))


@dataclass
class Boosted:
    """Additive trees for the log odds: (feature, cut, left, right) or a leaf value."""

    start: float = 0.0
    trees: list = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            self._add(tree, x, np.arange(len(x)), total)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))

    def _add(self, node, x, rows, total) -> None:
        if not isinstance(node, tuple):
            total[rows] += node
        elif len(rows):
            f, cut, left, right = node
            low = x[rows, f] <= cut
            self._add(left, x, rows[low], total)
            self._add(right, x, rows[~low], total)


@dataclass
class Grown:
    """A tree over cut numbers; the children of node i are 2 i + 1 and 2 i + 2."""

    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray
    value: np.ndarray

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of every row, or the node that has yet to be split."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(len(self.feature).bit_length()):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (codes[rows, f] > self.cut[at]), at)
        return at

    def nested(self, cuts: list[np.ndarray], at: int = 0):
        f = int(self.feature[at])
        if f < 0:
            return float(self.value[at])
        return f, float(cuts[f][self.cut[at]]), self.nested(cuts, 2 * at + 1), self.nested(cuts, 2 * at + 2)


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1).astype(np.uint8)


def _log_odds(start: float, trees: list[Grown], codes: np.ndarray) -> np.ndarray:
    total = np.full(len(codes), start)
    for tree in trees:
        total += tree.value[tree.nodes(codes)]
    return total


def _gradients(codes: np.ndarray, y: np.ndarray, n: np.ndarray, start: float, trees: list[Grown], growing: Grown) -> np.ndarray:
    """Sums of gradients and curvatures by node, feature and cut number, in parts of ``UNIT``."""
    p = 1 / (1 + np.exp(-np.clip(_log_odds(start, trees, codes), -30, 30)))
    width, nodes = codes.shape[1], len(growing.feature)
    slot = ((growing.nodes(codes)[:, None] * width + np.arange(width)) * BINS + codes).ravel()
    sums = [np.bincount(slot, np.repeat(np.rint(part * UNIT) * n, width), nodes * width * BINS) for part in (y - p, p * (1 - p))]
    return np.stack(sums).astype(np.int64).reshape(2, nodes, width, BINS)


def _grow(starts: dict[int, float], widths: dict[int, list[int]], gradients, trees: int, depth: int, rate: float) -> dict[int, list[Grown]]:
    """Trees of every key, a level at a time; ``gradients(done, growing)`` gives each key's sums."""
    done: dict[int, list[Grown]] = {k: [] for k in starts}
    size = 2 ** (depth + 1) - 1
    for _ in range(trees):
        growing = {k: Grown(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for k in starts}
        for level in range(depth):
            for k, sums in gradients(done, growing).items():
                tree = growing[k]
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    if level and tree.feature[(node - 1) // 2] < 0:
                        continue
                    g, h = sums[:, node] / UNIT
                    total_g, total_h = g[0].sum(), h[0].sum()
                    tree.value[node], best = rate * total_g / (total_h + 1), 1e-6
                    for f, cuts in enumerate(widths[k]):
                        gs, hs = g[f].cumsum()[:cuts], h[f].cumsum()[:cuts]
                        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                        if len(gain) and gain.max() > best:
                            best, at = gain.max(), int(gain.argmax())
                            tree.feature[node], tree.cut[node] = f, at
                            tree.value[2 * node + 1] = rate * gs[at] / (hs[at] + 1)
                            tree.value[2 * node + 2] = rate * (total_g - gs[at]) / (total_h - hs[at] + 1)
        for k, tree in growing.items():
            done[k].append(tree)
    return done


def _start(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Boosted:
    """Gradient boosting of the logistic loss on binned features, for rows at hand."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes, start, once = _codes(x, cuts), _start(y.mean()), np.ones(len(x))
    grown = _grow({0: start}, {0: [len(c) for c in cuts]}, lambda done, tree: {0: _gradients(codes, y, once, start, done[0], tree[0])}, trees, depth, rate)
    return Boosted(start, [t.nested(cuts) for t in grown[0]])


@dataclass
class ByKind:
    """Trees of their own for every kind, so that none is learned at another's cost."""

    kinds: dict[int, Boosted]

    @property
    def trees(self) -> list:
        return [t for b in self.kinds.values() for t in b.trees]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for kind, trees in self.kinds.items():
            rows = np.flatnonzero(x[:, 0] == kind)
            out[rows] = trees.score(x[rows])
        return out


@dataclass
class Model:
    trees: Boosted | ByKind
    thresholds: tuple[float, ...]  # by kind; above 1: never


_DATE = re.compile(r"(?:[12][0-9]{3}[ ./-](?:0?[1-9]|1[0-2])[ ./-](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:0?[1-9]|[12][0-9]|3[01])[ ./-](?:19|20)[0-9]{2})(?![0-9])")
_YEARS = re.compile(r"(?:1[0-9]|20)[0-9]{2}[ ./-]{1,2}(?:1[0-9]|20)[0-9]{2}")


def fails(kind: int, s: str) -> bool:
    """Whether a candidate cannot be of its kind, whichever way it is written."""
    digits = _only_digits(s)
    if kind == 0:
        last = re.split(r"[.\s()\[\]@]+", s.rstrip(")]. "))[-1]
        return len(last) < 2 or not last.isalpha() or "@" in s and "." not in s.rpartition("@")[2].strip(".")
    if kind == 1:
        if ":" in s:
            return s.count(":") != 7
        parts = re.split("[.,·]", s)
        return "," in s or len(parts) != 4 or any(int(p) > 255 for p in parts)  # commas part lists and thousands
    if kind == 2:
        return not (13 <= len(digits) <= 19 and luhn(digits))
    least = 10 if digits.startswith("00") else 8
    return not least <= len(digits) <= least + 7 or _DATE.match(s) is not None or _YEARS.fullmatch(s) is not None


def _checked(digits: str) -> str:
    """The digits with the last one made to pass ``luhn``."""
    return next(d for d in (digits[:-1] + str(i) for i in range(10)) if luhn(d))


def _grouped(digits: str, sizes: tuple[int, ...], by: str) -> str:
    out, at = [], 0
    for size in sizes:
        out.append(digits[at : at + size])
        at += size
    return by.join(g for g in [*out[:-1], out[-1] + digits[at:]] if g)


def rewritten(kind: int, s: str, pick: int) -> tuple[str, str]:
    """A base span written another way, and one like it that fails a check; ``pick`` says which."""
    a, b, c = pick % 7, pick // 7 % 5, pick // 35 % 10_000
    digits = _only_digits(s)
    if kind == 0:
        local, _, domain = s.rpartition("@")
        at, dot = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), (" [at] ", "[dot]"), (" at ", " dot "))[a]
        host = domain.split(".")[0]
        bad = (f"{local}@{host}", f"{local} at {c % 12} dot {c % 97}", f"{local}[at]{host}.{c % 97}", f"{local} at {host} dot {c}", f"{local}@{host}.{c % 97}")[b]
        return local + at + domain.replace(".", dot), bad
    if kind == 1:
        parts = [int(p) for p in s.split(".")]
        v6 = [0x2001 if c % 2 else 0xFD00 + parts[3], 0xDB8 + c, parts[0] * 257, parts[1], c * 3 % 65536, parts[2] * 251, parts[3], parts[0] * 256 + parts[1]]
        v6 = [f"{x:x}" if c % 3 else f"{x:04x}" for x in v6]
        by = "·" if a % 2 else "."
        over = by.join(str(256 + c % 700 if i == b % 4 else x) for i, x in enumerate(parts))
        bad = (over, over, s + by + str(c % 99), ":".join(v6[: 5 + c % 3]), ",".join(map(str, parts)))[b]
        return (by.join(map(str, parts)) if a in (1, 3) else ":".join(v6)), bad
    if kind == 2:
        n = (13, 14, 15, 15, 16, 16, len(digits))[a]
        sizes = (4, 6, 5) if n == 15 else (4, 4, 4, 4)
        by = ("", "" if n < 16 else ".", " ", "-", "_" if n == 16 else ".")[b]
        good = _checked(digits[:n])
        wrong = good[:-1] + str((int(good[-1]) + 1 + c % 9) % 10)
        return _grouped(good, sizes, by), _grouped(wrong, sizes, by)
    d = (digits + f"{c:04d}{(c * 7919) % 10_000:04d}")
    by = (" ", "-", ".", " ", "/")[b]
    ten = d[1:11]
    good = (
        "(" + ten[:3] + ") " + ten[3:6] + "-" + ten[6:], _grouped(ten, (3, 3, 4), by), _grouped("0" + d[2:12], (3, 4, 4), by), "00" + d[: max(9, min(13, len(digits)))],
        "00" + _grouped(d[: 10 + c % 4], ((2, 3, 3, 3), (2, 2, 3, 3, 2), (1, 3, 3, 4), (2, 3, 4, 3))[c // 4 % 4], by), "(0" + d[2:5] + ") " + d[5:8] + " " + d[8:11], _grouped("0" + d[2:11], (2, 2, 2, 2, 2), by))[a]
    day = f"{1950 + c % 90}{by}{1 + c % 12:02d}{by}{1 + c % 28:02d}" if c % 2 else f"{1 + c % 28:02d}{by}{1 + c % 12:02d}{by}{1950 + c % 90}"
    bad = (day, _grouped(d[:7], (3, 4), by), _grouped(d[:5], (2, 3), by), _grouped((d * 2)[:16], (4, 4, 4, 4), by), f"{1900 + c % 120}{by}{1900 + c % 125}")[b]
    return good, bad


def made_up(kind: int, pick: int) -> str:
    """A base span drawn from a hash."""
    x = pick % 10**15
    if kind == 0:
        name = "".join(chr(97 + x // 26**i % 26) for i in range(3 + x % 6))
        return f"{name}{('', '.', '_')[x % 3]}{name[::-1]}@{name[1:]}{x % 7 or ''}.{('com', 'org', 'net', 'de', 'co.uk', 'io')[x // 11 % 6]}"
    if kind == 1:
        return ".".join(str(x // 256**i % 256) for i in range(4))
    if kind == 2:
        return _checked(f"{3 + x % 4}{x:015d}")
    return f"+{1 + x % 9}{x:015d}"[: 11 + x % 3]


def labelled(text: str, row: int) -> Iterator[tuple[int, int, int, list[float]]]:
    """Kind, label, hash and features of a document's examples; see the head of the module."""
    found = candidates(text)
    base = base_spans(text) if found else []
    known = set(base)
    for span in found:
        kind, start, end = span
        if span in known:
            yield kind, 1, hash((row, *span)), features(text, span)
        elif not any(k == kind and s < end and start < e for k, s, e in base):
            if fails(kind, text[start:end]) or any(s < end and start < e for _, s, e in base):
                yield kind, 0, hash((row, *span)), features(text, span)
    places = [(*span, text[span[1] : span[2]]) for span in base]
    if text.strip():
        pick = abs(hash((row, len(text))))
        at = text.find(" ", pick % len(text))
        at = len(text) if at < 0 else at + 1
        places.append((pick % 4, at, at, made_up(pick % 4, pick // 4)))
    for kind, start, end, s in places:
        before, after = text[max(0, start - 2 * CONTEXT) : start], text[end : end + 2 * CONTEXT]
        if start == end:
            before, after = before if before.endswith(" ") else before + " ", " " + after
        pick = abs(hash((row, kind, start)))
        for label, new in zip((1, 0), rewritten(kind, s, pick), strict=True):
            span = (kind, len(before), len(before) + len(new))
            near = before + new + after
            if any(m.span() == span[1:] for k, g in _GENERATORS if k == kind for m in g.finditer(near)):
                yield kind, label, hash((row, *span, start, label)), features(near, span)


def examples(docs: DataFrame, fit_rows: int | None = None) -> DataFrame:
    """Different candidates with kind, label, fold and features: all of them, or ``fit_rows`` at most, a quarter for each kind."""
    schema = "kind int, label int, held boolean, pick long, features array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, label, held, pick, feats = [], [], [], [], []
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for kind, y, h, x in labelled(text or "", row):
                    kinds.append(kind)
                    label.append(y)
                    held.append(row % 5 == 0)
                    pick.append(h)
                    feats.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(label, pa.int32()), pa.array(held, pa.bool_()), pa.array(pick, pa.int64()), pa.array(feats, pa.list_(pa.float64()))],
                names=["kind", "label", "held", "pick", "features"])

    rows = docs.select(F.xxhash64("text").alias("_row"), "text").mapInArrow(run, schema).dropDuplicates(["kind", "pick"])
    if fit_rows is None:
        return rows
    rows, each = saved(rows, "examples"), fit_rows // len(KINDS)
    out = [rows.where(F.col("kind") == kind).orderBy("pick").limit(each) for kind in range(len(KINDS))]
    return out[0].unionAll(out[1]).unionAll(out[2]).unionAll(out[3])


def _rounded(x: Column) -> Column:
    """Large values to three digits, so that quantiles need few different ones."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 2)
    return F.when(x < 1000, x).otherwise(F.floor(x / unit) * unit)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The cut numbers of a batch of cells."""
    return np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, N_FEATURES)


def _cells(rows: DataFrame, cuts: dict[int, list[np.ndarray]]) -> DataFrame:
    """Examples with their cut numbers for features, those alike as one row with their count ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, x = batch.column("kind").to_numpy(), batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES)
            codes = np.zeros(x.shape, np.uint8)
            for k in cuts:
                codes[kinds == k] = _codes(x[kinds == k], cuts[k])
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "label", "held")), packed], names=["kind", "label", "held", "codes"])

    coded = rows.where(F.col("kind").isin(list(cuts))).mapInArrow(run, "kind int, label int, held boolean, codes binary")
    return coded.groupBy("kind", "label", "held", "codes").agg(F.count(F.lit(1)).alias("n"))


def _pass(cells: DataFrame, starts: dict[int, float], done: dict[int, list[Grown]], growing: dict[int, Grown]) -> dict[int, np.ndarray]:
    """Sums of gradients of every kind over all training cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            kinds, codes = batch.column("kind").to_numpy(), _matrix(batch)
            y, n = batch.column("label").to_numpy(), batch.column("n").to_numpy()
            for k in np.unique(kinds).tolist():
                at = kinds == k
                sums[k] = sums.get(k, 0) + _gradients(codes[at], y[at], n[at], starts[k], done[k], growing[k])
        for k, both in sums.items():
            g, h = both.reshape(2, -1)
            slot = np.flatnonzero((g != 0) | (h != 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), k, np.int32)), pa.array(slot), pa.array(g[slot]), pa.array(h[slot])], names=["kind", "slot", "g", "h"])

    parts = cells.where("NOT held").select("kind", "label", "codes", "n").mapInArrow(run, "kind int, slot long, g long, h long")
    found = parts.groupBy("kind", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow().to_pandas()
    out = {}
    for k, part in found.groupby("kind"):
        both = np.zeros((2, len(growing[k].feature) * N_FEATURES * BINS), np.int64)
        both[:, part["slot"].to_numpy()] = part[["g", "h"]].to_numpy().T
        out[int(k)] = both.reshape(2, -1, N_FEATURES, BINS)
    return out


def _thresholds(cells: DataFrame, starts: dict[int, float], grown: dict[int, list[Grown]]) -> tuple[float, ...]:
    """The lowest score of every kind from which on enough of the held-out examples are right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, codes = batch.column("kind").to_numpy(), _matrix(batch)
            step = np.zeros(len(kinds), np.int64)
            for k in np.unique(kinds).tolist():
                step[kinds == k] = np.floor(np.clip(_log_odds(starts[k], grown[k], codes[kinds == k]), -30, 30) * STEPS)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "label", "n")), pa.array(step)], names=["kind", "label", "n", "step"])

    scored = cells.where("held").select("kind", "label", "codes", "n").mapInArrow(run, "kind int, label int, n long, step long")
    found = scored.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("right")).toArrow().to_pandas()
    out = [2.0 for _ in KINDS]
    for k, part in found.groupby("kind"):
        part = part.sort_values("step", ascending=False)
        right, wrong = part["right"].to_numpy(), (part["n"] - part["right"]).to_numpy()
        # Down the ranking; examples of one score stand evenly mixed, so right ones come before the first wrong one.
        lead = right // (wrong + 1)
        above, bad = right.cumsum() - right, wrong.cumsum() - wrong
        reached = (lead > 0) & (above + lead >= PRECISION * (above + bad + lead))
        good = np.flatnonzero(reached | (above + right >= PRECISION * (above + bad + right + wrong)))
        if len(good) and part["n"].sum() >= 20:
            steps, last = part["step"].to_numpy(), good[-1]
            # Halfway to the next score below: the same is taken here, and what was not seen is judged evenly.
            below = steps[last + 1] + 1 if last + 1 < len(steps) else steps[last]
            out[int(k)] = float(1 / (1 + np.exp(-(steps[last] + below) / 2 / STEPS)))
    return tuple(out)


def fit(docs: DataFrame) -> Model:
    """Trees and thresholds from all labelled examples, by passes over the stored table of them."""
    rows = saved(examples(docs), "examples")
    train, probs = rows.where("NOT held"), [float(q) for q in np.linspace(0, 1, BINS + 1)[1:-1]]
    quantiles = [F.percentile(_rounded(F.col("features")[f]), probs).alias(f"q{f}") for f in range(N_FEATURES)]
    kinds = train.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("right"), *quantiles).collect()
    whole, right = sum(r.n for r in kinds), sum(r.right for r in kinds)
    kinds = [r for r in kinds if 0 < r.right < r.n]
    if whole < 50 or not 0 < right < whole or not kinds:
        return Model(Boosted(), tuple(2.0 for _ in KINDS))
    cuts = {r.kind: [np.unique(r[f"q{f}"]) for f in range(N_FEATURES)] for r in kinds}
    starts = {r.kind: _start(r.right / r.n) for r in kinds}
    cells = saved(_cells(rows, cuts), "cells")
    grown = _grow(
        starts, {k: [len(c) for c in by] for k, by in cuts.items()},
        lambda done, growing: _pass(cells, starts, done, growing), TREES, DEPTH, RATE)
    trees = ByKind({k: Boosted(starts[k], [t.nested(cuts[k]) for t in grown[k]]) for k in starts})
    return Model(trees, _thresholds(cells, starts, grown))


def choose(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """For every text its base spans and all spans, each by kind and start."""
    base = [base_spans(t) if _TEST.search(t) else [] for t in texts]
    rest = [(i, s) for i, t in enumerate(texts) for s in (candidates(t) if model.trees.trees else []) if s not in set(base[i])]
    chosen = [list(b) for b in base]
    if rest:
        p = model.trees.score(np.array([features(texts[i], s) for i, s in rest]))
        for at in np.argsort(-p, kind="stable").tolist():
            i, span = rest[at]
            if p[at] >= model.thresholds[span[0]] and not any(s < span[2] and span[1] < e for _, s, e in chosen[i]):
                chosen[i].append(span)
    return [(b, sorted(c)) for b, c in zip(base, chosen, strict=True)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPANS_TYPE = "array<struct<kind:string,start:int,end:int>>"


def _structs(spans: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]


def find(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``base`` and ``spans``, arrays of kind, start and end."""
    source = docs.select(*keep, F.col("text").alias("_text"))
    fields = [*source.schema.fields[:-1]]
    schema = T.StructType([*fields, *T._parse_datatype_string(f"base {_SPANS_TYPE}, spans {_SPANS_TYPE}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = choose([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], model)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([_structs(b) for b, _ in found], _SPANS), pa.array([_structs(s) for _, s in found], _SPANS)],
                names=[*batch.schema.names[:-1], "base", "spans"])

    return source.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are masked together."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents, the spans in ``text`` replaced by their kind. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = choose([t or "" for t in texts], model)
            new = [None if t is None else masked(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
            yield batch.set_column(at, "text", pa.array(new, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
