"""Byte-level BPE encoding and decoding by a depth-first walk over the trie of distinct words.

Method. A token sequence is what BPE makes of its bytes exactly when every adjacent pair
is what BPE makes of the pair's bytes. So the last token of a prefix is the one token that
ends it and forms a valid pair with the last token of what is before. Each trie node
(prefix) keeps that one token; words that share a prefix share its nodes, and sorting the
distinct words visits the nodes in depth-first order with only the current path in memory.

Every task builds the trie of its own batch of documents: there is no shuffle, memory is
bounded by the batch and by ``CACHE``, and a lost task is simply run again.

Nulls and odd input: a null text is encoded as the empty text (no ids). Rows keep their
other columns unchanged, repeated rows are encoded each, empty tables give empty tables.
A column of the input called like an output column is an error of the caller and raised.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Units whose encodings a Python worker remembers; beyond it starts anew.
CACHE = 300_000
#: Characters of text that are encoded together.
CHUNK = 4_000_000

# Fixed: the split pattern of this tokenizer family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        self.back = back
        to_bytes = lambda s: bytes(back[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.ids = {to_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.pieces = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[to_bytes(a)], self.ids[to_bytes(b)]): (n, self.ids[to_bytes(a + b)]) for n, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.splitter = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.valid: dict[tuple[int, int], bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE: the pair of lowest rank first, from the left. For short strings."""
        ids = [self.ids[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.ranks[ids[i], ids[i + 1]][1]]
        return ids

    def follows(self, before: int, token: int) -> bool:
        """Whether the token may come after ``before`` (-1: at the start of a word)."""
        key = (before, token)
        known = self.valid.get(key)
        if known is None:
            if len(self.valid) > 1_000_000:
                self.valid.clear()
            head = b"" if before < 0 else self.pieces[before]
            known = self.valid[key] = self.merge(head + self.pieces[token]) == ([token] if before < 0 else [before, token])
        return known


def encode_words(vocab: Vocabulary, distinct: list[bytes]) -> dict[bytes, bytes]:
    """Ids (little-endian unsigned 32-bit) of every word, walking their trie depth first."""
    ids, pieces, follows, valid, longest = vocab.ids, vocab.pieces, vocab.follows, vocab.valid, vocab.longest
    out: dict[bytes, bytes] = {}
    path = [-1]  # path[d]: last token of the first d bytes of the current word
    before = b""
    for word in sorted(distinct):
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del path[shared + 1 :]
        head = shared - len(pieces[path[shared]]) if shared else 0  # where the last token begins
        for end in range(shared + 1, len(word) + 1):
            # Only one token can end a prefix. Most often it is the one before with a byte more, or a new one.
            token = ids.get(word[head:end])
            before_it = path[head]
            if token is None or not (valid.get((before_it, token)) or follows(before_it, token)):
                for head in (end - 1, *range(end - 2, max(-1, end - longest - 1), -1)):
                    token = ids.get(word[head:end])
                    if token is not None and follows(path[head], token):
                        break
                else:
                    raise ValueError("a byte has no token")
            path.append(token)
        at, found = len(word), []
        while at:
            found.append(path[at])
            at -= len(pieces[path[at]])
        out[word] = struct.pack(f"<{len(found)}I", *reversed(found))
        before = word
    return out


class Encoder:
    """Encodes texts by units between single spaces, which split independently of each other."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.vocab = Vocabulary(path)
        self.pattern = regex.compile(PATTERN)
        self.exact = pre_tokenizers.ByteLevel(add_prefix_space=False)
        self.rare = re.compile("[^\x00-ɏ]")  # beyond: the library's own character classes
        self.uneven = re.compile(r"\s\s|\A\s|\s\Z")
        self.single = re.compile(r"(?<=\S) (?=\S)")
        self.units: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def _words(self, unit: str, space: str = "") -> list[bytes]:
        if unit.isalpha() and (unit.isascii() or not self.rare.search(unit)):
            return [(space + unit).encode()]
        unit = space + unit
        if self.rare.search(unit):
            back = self.vocab.back
            return [bytes(back[c] for c in w) for w, _ in self.exact.pre_tokenize_str(unit)]
        return [w.encode() for w in self.pattern.findall(unit)]

    def _split(self, text: str) -> list[str]:
        """A space between two other characters always starts a word; later units come without it."""
        return self.single.split(text) if self.uneven.search(text) else text.split(" ")

    def _learn(self, units: set[str], heads: set[str]) -> dict[str, bytes]:
        """Encodings of new units, and of text starts, from one trie of their distinct words."""
        found = {u: self._words(u, " ") for u in units}
        first = {u: self._words(u) for u in heads}
        known = self.words
        if len(known) > CACHE:
            known.clear()
        known.update(encode_words(self.vocab, list({w for words in (*found.values(), *first.values()) for w in words}.difference(known))))
        self.units.update((u, known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))) for u, words in found.items())
        return {u: b"".join(map(known.__getitem__, words)) for u, words in first.items()}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        split, plain = self.vocab.splitter, []
        for text in texts:  # special tokens cut a text; both sides are encoded for themselves
            if split and split.search(text):
                ends = [m.span() for m in split.finditer(text)]
                starts = [0, *(e for _, e in ends)]
                plain.append(([text[a:b] for a, b in zip(starts, [*(s for s, _ in ends), len(text)], strict=True)], [text[a:b] for a, b in ends]))
            else:
                plain.append(([text], []))
        parts = [[self._split(p) if p else [] for p in pieces] for pieces, _ in plain]
        need: set[str] = set()
        for pieces in parts:
            for units in pieces:
                need.update(units[1:])
        fresh = need.difference(self.units)
        if len(self.units) + len(fresh) > CACHE:
            self.units.clear()
            fresh = need
        heads = self._learn(fresh, {units[0] for pieces in parts for units in pieces if units})
        get, out = self.units.__getitem__, []
        for (_, cut), pieces in zip(plain, parts, strict=True):
            whole = []
            for i, units in enumerate(pieces):
                if units:
                    whole.append(heads[units[0]])
                    whole.extend(map(get, units[1:]))
                if i < len(cut):
                    whole.append(struct.pack("<I", self.vocab.special[cut[i]]))
            out.append(b"".join(whole))
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


def chunks(texts: list[str], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``most`` characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _appended(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    if name in df.columns:
        raise ValueError(f"the input already has a column {name}")
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def _mapped(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, work, drop: bool) -> DataFrame:
    """Adds a column computed from ``source`` in slices of bounded size."""
    schema = _appended(df, name, kind)
    if drop:
        schema = T.StructType([f for f in schema.fields if f.name != source])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            values = batch.column(at).to_pylist()
            for a, b in chunks([v or "" for v in values]):
                part = batch.slice(a, b - a)
                columns = [c for i, c in enumerate(part.columns) if not (drop and i == at)]
                names = [n for i, n in enumerate(batch.schema.names) if not (drop and i == at)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(work(values[a:b]), arrow)], names=[*names, name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", drop_text: bool = True, by=encoder) -> DataFrame:
    """Adds ``ids``, the token ids of the text as little-endian unsigned 32-bit integers.

    ``by`` gives the encoder of a path in the Python worker.
    """
    return _mapped(df, text, ids, T.BinaryType(), pa.binary(), lambda texts: by(path).encode([t or "" for t in texts]), drop_text)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """Adds the text of the ids; special tokens are kept, broken UTF-8 becomes U+FFFD."""

    def work(values: list[bytes | None]) -> list[str]:
        piece = encoder(path).vocab.pieces.__getitem__
        return [b"".join(map(piece, memoryview(v or b"").cast("I"))).decode("utf-8", "replace") for v in values]

    return _mapped(df, ids, text, T.StringType(), pa.string(), work, drop_ids)
