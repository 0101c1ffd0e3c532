"""Near-duplicate documents: Jaccard join of word shingles through a token-group matrix.

Two documents link when 100 * |A and B| >= 75 * |A or B| over their sets of five-word
shingles; the answer is the connected components of all links.

1. *Classes.* Documents with the same set are one class; copies never travel as pairs.
2. *Tokens that can matter.* A linked pair shares at least 75 % of the larger set, so it
   shares a token among each one's first |A| - ceil(0.75 |A|) + 1 tokens in any order that
   is the same for all. The order here is (seen in several sets of one batch, hash): a
   bitmap of fixed size holds the first part, and only moves tokens of common passages
   to the back. Tokens that one class alone holds drop out.
3. *Cards.* Each class that is left has a card: its size, minimum hashes and the parity of
   its tokens in twice as many places. Where the bits of two cards differ, the sets differ, so a count of
   differing bits bounds the overlap from above; full sets are only fetched for classes
   that have a possible partner.
4. *Groups.* Classes with an equal minimum hash are compared completely in chunks of
   bounded size, under three hash functions; components of what links are groups. The
   other classes are grouped by likeness: size and most widely held token.
5. *Matrix.* For each group chunk the union of its members' tokens is stored as (token,
   chunk) rows. A class and a chunk qualify when the class's overlap with the union can
   reach the threshold: they share a token, the sizes that hold it are compatible and the
   cards allow it. A group of linked classes asks no chunk of its own. Only qualifying
   chunks are opened and compared exactly, and they give links that connect, not all.

Pairs inside a group are never listed, so a family with a third of all documents costs
its members' tokens times its chunks, whether they link or not; yet every two classes
that link are connected, so no component is split.

Nulls and odd input: documents without words have an empty set and are linked with
nothing. A null id counts as the largest: a document without one gets the smallest id of
its component, and none where no document there has one. Repeated rows are copies. Shingles
are 64-bit hashes and classes 64-bit digests of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bitmap
from .common import saved

SHINGLE = 5
BITS = 25
CHUNK = 256  # classes compared completely at a time
ASKERS = 1_024  # classes that ask one chunk at a time
PARITY = 1_024  # least bits of a card
SLICE = 2_000_000  # characters looked at together
PART = 400_000  # of them in work at once, at some 50 bytes each
_B = np.uint64(0x9E3779B97F4A7C15)
_KEYS = tuple(np.uint64(k) for k in (1, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LONG = 1 << 12
_WEIGHTS = np.random.default_rng(20240607).integers(0, 2**63, _LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _KEYS[2]
    return h ^ (h >> np.uint64(29))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word of a byte string, and where it starts: multilinear in its bytes."""
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_IS_SPACE[raw]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (raw[inside].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[at % _LONG]
    if lengths.max() > _LONG:
        values *= (2 * (at // _LONG) + 1).astype(np.uint64)
    return _mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _B), starts


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; A-Z are lower-cased. A few texts at a time are in work."""
    out: list[np.ndarray] = []
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= PART or i == len(texts) - 1:
            out += _shingles(texts[start : i + 1], size)
            start, held = i + 1, 0
    return out


def _shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    coded = [(t or "").encode() for t in texts]
    h, starts = _word_hashes(b"\n".join(coded))
    begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    first = np.searchsorted(starts, begins)
    whole = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for i in range(size):
        whole = whole * _B + h[i : len(whole) + i]
    whole = _mixed(whole)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= size:
            out.append(np.unique(whole[low : high - size + 1]))
        elif high > low:  # fewer words: all of them are the one shingle
            total = np.full(1, high - low, np.uint64)
            for w in h[low:high]:
                total = total * _B + w
            out.append(_mixed(total))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap that a set of n tokens can link with."""
    return -(-percent * n // 100)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= SLICE or i == len(texts) - 1:
                yield batch.slice(start, i + 1 - start), shingle_sets(texts[start : i + 1])
                start, size = i + 1, 0
    pa.default_memory_pool().release_unused()  # the worker goes on to other stages


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def common_tokens(docs: DataFrame) -> DataFrame:
    """``h`` of tokens that several different sets of one batch hold; each batch counts, all documents do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            distinct = list({s.tobytes(): s for s in sets}.values())
            h, n = np.unique(np.concatenate(distinct), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64))], names=["h"])

    return docs.select("text").mapInArrow(run, "h long")


def signatures(docs: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """doc_id, n, class; and unless a copy inside the batch has them: minimum hashes, parity bits, tokens that can matter."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            seen: set[int] = set()
            names, least, parity, tokens = [], [], [], []
            for s in sets:
                names.append(_name(s) if len(s) else None)
                if names[-1] is None or names[-1] in seen:
                    least.append(None)
                    parity.append(None)
                    tokens.append(None)
                    continue
                seen.add(names[-1])
                with np.errstate(over="ignore"):
                    least.append([int((s * k).min().view(np.int64)) for k in _KEYS])
                parity.append(_card(s))
                frequent = bitmap.holds(shared.value, s)
                ordered = np.concatenate([s[~frequent], s[frequent]])
                tokens.append(ordered[: len(s) - overlap_needed(len(s), percent) + 1].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()),
                 pa.array(least, pa.list_(pa.int64())), pa.array(parity, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc_id", "n", "class", "least", "parity", "tokens"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n long, class long, least array<long>, parity binary, tokens array<long>")


def representatives(signed: DataFrame) -> DataFrame:
    """(class, d): of each class one document with tokens, by the hash of its id."""
    return signed.where("tokens IS NOT NULL").groupBy("class").agg(F.min(F.xxhash64("doc_id")).alias("d"))


def _chosen(reps: DataFrame, bits: int):
    """Broadcast bitmap of the representatives: asks for one row of each class, and perhaps a few more."""
    return reps.sparkSession.sparkContext.broadcast(bitmap.build(reps.select(F.col("class").bitwiseXOR(F.col("d")).alias("h")), bits))


def _speaks(chosen, names: np.ndarray, d: np.ndarray) -> np.ndarray:
    return bitmap.holds(chosen, (names ^ d).view(np.uint64))


def shared_tokens(signed: DataFrame, chosen, bits: int) -> DataFrame:
    """(h, class) of tokens that at least two classes hold.

    Only representatives speak for their class. A first pass counts tokens; those met twice
    set a bit in a bitmap of fixed size, and only they travel with their class in the second.
    What copies or a full bitmap let through drops out in the exact count at the end.
    """
    rows = signed.where("tokens IS NOT NULL").select("class", F.xxhash64("doc_id").alias("d"), "tokens")

    def speaking(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        names = batch.column(0).to_numpy()
        on = np.flatnonzero(_speaks(chosen.value, names, batch.column(1).to_numpy()))
        tokens = batch.column(2).take(pa.array(on))
        return names[on].repeat(pc.list_value_length(tokens).to_numpy()), tokens.flatten().to_numpy()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = np.unique(speaking(batch)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int8))], names=["h", "n"])

    twice = rows.mapInArrow(counted, "h long, n byte").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    perhaps = signed.sparkSession.sparkContext.broadcast(bitmap.build(twice, bits))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, h = speaking(batch)
            on = bitmap.holds(perhaps.value, h.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(h[on]), pa.array(names[on])], names=["h", "class"])

    known = rows.mapInArrow(told, "h long, class long")
    # Aggregated before the shuffle, then a join that Spark can split: no token gathers its rows in one task.
    several = known.groupBy("h").agg(F.min("class").alias("_low"), F.max("class").alias("_high")).where("_low < _high").select("h")
    return known.distinct().join(several, "h", "left_semi").select("h", "class")


def class_cards(signed: DataFrame, tokens: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, n, least, parity) of the classes that hold a shared token, from their representatives."""
    rows = signed.where("tokens IS NOT NULL").select("class", F.xxhash64("doc_id").alias("d"), "n", "least", "parity")
    wanted = reps.join(tokens.select("class").distinct(), "class", "left_semi")
    return rows.join(wanted, ["class", "d"], "left_semi").drop("d").dropDuplicates(["class"])


def class_sets(docs: DataFrame, wanted: DataFrame, reps: DataFrame, bits: int) -> DataFrame:
    """(class, set as bytes) of the wanted classes, from another pass over the texts.

    Only the representative of a class gives its set, so a class of a third of all documents sends one.
    """
    asked = reps.join(wanted.select("class").distinct(), "class", "left_semi")
    chosen = _chosen(asked, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            names = np.array([_name(s) if len(s) else 0 for s in sets], np.int64)
            on = np.flatnonzero(_speaks(chosen.value, names, batch.column(0).to_numpy()) & (np.array([len(s) for s in sets]) > 0))
            kept = {int(names[i]): sets[i].tobytes() for i in on.tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.binary())], names=["class", "set"])

    found = docs.select(F.xxhash64("doc_id").alias("d"), "text").mapInArrow(run, "class long, set binary")
    # A row that the bitmap let through by chance, and repeated rows, are equal to the representative's.
    return found.join(wanted.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two bounded lists of sets, by blocks of tokens."""
    tokens, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    side = np.repeat(np.arange(len(a) + len(b)), [len(s) for s in (*a, *b)])
    first, second = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
    first[at[side < len(a)]] = True
    second[at[side >= len(a)]] = True
    both = np.flatnonzero(first & second)
    place = np.full(len(tokens), -1)
    place[both] = np.arange(len(both))
    out = np.zeros((len(a), len(b)), np.int64)
    column = place[at]
    for low in range(0, len(both), 8192):
        here = (column >= low) & (column < low + 8192)
        dense = np.zeros((len(a) + len(b), min(8192, len(both) - low)), np.float32)
        dense[side[here], column[here] - low] = 1
        out += (dense[: len(a)] @ dense[len(a) :].T).astype(np.int64)
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    inside = _overlaps(a, b)
    either = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - inside
    return 100 * inside >= percent * either


def _unpacked(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column]


def _card(s: np.ndarray) -> bytes:
    """Parity of the tokens per place: at least twice as many places as tokens, a power of two."""
    places = max(PARITY, 1 << int(2 * len(s) - 1).bit_length())
    counts = np.bincount(((s >> np.uint64(20)) % np.uint64(places)).astype(np.int64), minlength=places)
    return np.packbits(counts & 1 == 1).tobytes()


def _folded(bits: list[bytes], places: int) -> np.ndarray:
    """Cards of one width as 0/1 rows, folded to fewer places."""
    rows = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1)
    return (rows.reshape(len(bits), -1, places).sum(axis=1) & 1).astype(np.float32)


def _possible(a_bits: list[bytes], a_n: np.ndarray, b_bits: list[bytes], b_n: np.ndarray, percent: int) -> np.ndarray:
    """Whether the cards allow a link: differing parity bits are differing tokens."""
    out = np.zeros((len(a_bits), len(b_bits)), bool)
    a_width, b_width = (np.array([8 * len(x) for x in bits]) for bits in (a_bits, b_bits))
    for wa in np.unique(a_width):
        for wb in np.unique(b_width):
            i, j, places = np.flatnonzero(a_width == wa), np.flatnonzero(b_width == wb), int(min(wa, wb))
            a, b = _folded([a_bits[x] for x in i], places), _folded([b_bits[x] for x in j], places)
            differ = a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)
            out[np.ix_(i, j)] = differ * (100 + percent) <= (100 - percent) * (a_n[i][:, None] + b_n[j][None, :])
    return out


def _by_group(rows: DataFrame, keys: list[str], work, schema: str) -> DataFrame:
    """Calls ``work(columns)`` for each group of whole-number keys and returns the rows it gives.

    Partitions are sorted by key and walked, which costs far less than a call from
    Spark for each of very many small groups; one group is held at a time. Binary
    columns come as lists, others as arrays; ``keys`` order the rows, the last is not
    part of the group's key but of the order inside it.
    """
    names = rows.columns
    by = keys[:-1]
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def columns(table: pa.Table) -> dict:
        return {c: table[c].to_pylist() if pa.types.is_binary(table.schema.field(c).type) else table[c].to_numpy() for c in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None

        def answers(table: pa.Table) -> pa.RecordBatch:
            got = columns(table)
            ends = np.flatnonzero(np.any([np.diff(got[k]) != 0 for k in by], axis=0)) + 1
            out: list[tuple] = []
            for low, high in zip([0, *ends.tolist()], [*ends.tolist(), len(table)], strict=True):
                if high - low > 1:
                    out += work({c: v[low:high] for c, v in got.items()})
            made = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(list(m), f.type) for m, f in zip(made, arrow, strict=True)], schema=arrow)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([left, table]) if left is not None else table
            if not len(table):
                continue
            last = np.all([table[k].to_numpy() == table[k][-1].as_py() for k in by], axis=0)
            start = len(table) - int(last.sum())  # the last group may go on in the next batch
            left = table.slice(start)
            if start:
                yield answers(table.slice(0, start))
        if left is not None:
            yield answers(left)

    dealt = rows.repartition(*by).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def _chunks(cards: DataFrame, chunk: int) -> DataFrame:
    """(class, _j, _m, _c): the chunks of each class among those of an equal minimum hash; alone in one, it has none."""
    keyed = cards.select("class", F.posexplode("least").alias("_j", "_m"))
    sizes = keyed.groupBy("_j", "_m").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # A bucket of any size is cut into chunks by hash, under each key differently.
    cut = F.pmod(F.xxhash64("class", "_j"), F.ceil(F.col("_n") / (0.8 * chunk)).cast("long"))
    return keyed.join(sizes, ["_j", "_m"]).select("class", "_j", "_m", cut.alias("_c"))


def possible_partners(cards: DataFrame, chunks: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """(class, _j, _m, _c) of classes whose card allows a link inside the chunk."""

    def work(g: dict) -> list[tuple]:
        n = len(g["class"])
        hit = np.zeros(n, bool)
        for low in range(0, n, chunk):
            for at in range(0, low + 1, chunk):
                one, two = slice(low, low + chunk), slice(at, at + chunk)
                allowed = _possible(g["parity"][one], g["n"][one], g["parity"][two], g["n"][two], percent)
                if low == at:
                    np.fill_diagonal(allowed, False)
                hit[one] |= allowed.any(axis=1)
                hit[two] |= allowed.any(axis=0)
        return [(c, int(g["_j"][0]), int(g["_m"][0]), int(g["_c"][0])) for c in g["class"][hit].tolist()]

    rows = chunks.join(cards.select("class", "n", "parity"), "class")
    return _by_group(rows, ["_j", "_m", "_c", "class"], work, "class long, _j int, _m long, _c long")


def group_links(sets: DataFrame, partners: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join what is connected inside each chunk."""

    def work(g: dict) -> list[tuple]:
        names, members = g["class"].tolist(), _unpacked(g["set"])
        root = list(range(len(names)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for low in range(0, len(members), chunk):  # a chunk is seldom larger than ``chunk``
            for at in range(0, low + 1, chunk):
                hits = _linked(members[low : low + chunk], members[at : at + chunk], percent)
                for i, j in zip(*np.nonzero(hits), strict=True):
                    a, b = find(low + int(i)), find(at + int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((names[low + int(i)], names[at + int(j)]))
        return links

    return _by_group(partners.join(sets, "class"), ["_j", "_m", "_c", "class"], work, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(class, root): each linked class and the smallest one it reaches, by large and small stars."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its neighbours below go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("class"), F.col("v").alias("root"))
    return saved(roots.union(roots.select(F.col("root").alias("class"), "root")).distinct(), "roots")


def _with_roots(classes: DataFrame, roots: DataFrame) -> DataFrame:
    return classes.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))


_BY = ["root", "_c", "_q"]


def _meetings(pairs: DataFrame, holding: DataFrame, placed: DataFrame, work, schema: str) -> DataFrame:
    """Brings the classes that ask a chunk together with its members, by blocks of bounded size.

    ``work`` gets the rows of a block: ``asks`` is 1 for classes that ask, and 0 for members.
    """
    blocks = pairs.groupBy("root", "_c").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("long").alias("_blocks"))
    asking = pairs.join(blocks, ["root", "_c"]).withColumn("_q", F.pmod(F.xxhash64("class"), "_blocks"))
    held = placed.select("class", "root", "_c").join(blocks, ["root", "_c"])
    held = held.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    both = asking.select(*_BY, "class", F.lit(1).alias("asks")).union(held.select(*_BY, "class", F.lit(0).alias("asks")))
    return _by_group(both.join(holding, "class").select(*_BY, "asks", "class", *[c for c in holding.columns if c != "class"]), [*_BY, "asks"], work, schema)


def _groups(cards: DataFrame, tokens: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(class, n, root, tied): what is linked is a group; other classes are grouped by likeness.

    A class without a link joins those of like size that have the same most widely held token,
    so a family of which many do not link makes few groups, not one for each. Only groups of
    linked classes are ``tied``; in others the members are compared with each other too.
    """
    known = cards.select("class", "n").join(roots, "class", "left")
    held = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("_held"))
    alone = tokens.join(roots.select("class"), "class", "left_anti").join(held, "h")
    widest = alone.groupBy("class").agg(F.max(F.struct("_held", "h")).alias("_w")).select("class", F.col("_w.h").alias("_top"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    like = F.xxhash64("_top", band)
    return known.join(widest, "class", "left").select("class", "n", F.coalesce("root", like).alias("root"), F.col("root").isNotNull().alias("tied"))


def qualifying(cards: DataFrame, tokens: DataFrame, roots: DataFrame, percent: int, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The matrix's answer: (class, root, _c, members) of chunks to open with the members a card allows, and where each class is."""
    members = saved(_groups(cards, tokens, roots, percent), "groups")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("_n"))
    members = members.join(sizes, "root").withColumn("_c", F.pmod(F.xxhash64("class"), F.ceil(F.col("_n") / (0.8 * chunk)).cast("long")))
    placed = saved(members.select("class", "n", "root", "_c", "tied"), "groups")
    named = tokens.select("h", "class").join(placed, "class")
    # The matrix: one row per token and chunk, with the sizes of the members that hold the token.
    unions = named.groupBy("h", "root", "_c", "tied").agg(F.min("n").alias("_low"), F.max("n").alias("_high"))
    # A token that one group of linked classes alone holds asks nobody.
    several = unions.groupBy("h").agg(F.min("root").alias("_a"), F.max("root").alias("_b"), F.min("tied").alias("_t")).where("_a < _b OR NOT _t").select("h")
    unions = unions.join(several, "h", "left_semi")
    asks = named.join(several, "h", "left_semi").select("h", "class", "n", F.col("root").alias("_own"))
    fits = (F.col("_high") * 100 >= percent * F.col("n")) & (F.col("_low") * percent <= 100 * F.col("n"))
    met = asks.join(unions, "h").where(((F.col("_own") != F.col("root")) | ~F.col("tied")) & fits)
    pairs = saved(met.select("class", "root", "_c").distinct(), "meetings")

    def allowed(g: dict) -> list[tuple]:
        held = int(np.searchsorted(g["asks"], 1))
        if held in (0, len(g["asks"])):
            return []
        names, out = g["class"], []
        for low in range(held, len(names), CHUNK):
            asked = slice(low, low + CHUNK)
            hits = _possible(g["parity"][asked], g["n"][asked], g["parity"][:held], g["n"][:held], percent)
            hits &= names[asked][:, None] != names[:held]
            for i in np.flatnonzero(hits.any(axis=1)).tolist():
                out.append((int(names[low + i]), int(g["root"][0]), int(g["_c"][0]), names[:held][hits[i]].tolist()))
        return out

    card = cards.select("class", "n", "parity")
    return saved(_meetings(pairs, card, placed, allowed, "class long, root long, _c long, members array<long>"), "qualifying"), placed


def matrix_links(open_: DataFrame, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different groups: qualifying chunks, opened and compared exactly."""

    def work(g: dict) -> list[tuple]:
        held = int(np.searchsorted(g["asks"], 1))
        if held in (0, len(g["asks"])):
            return []
        names, members, out, tree = g["class"].tolist(), _unpacked(g["set"]), [], {}

        def find(c: int) -> int:
            while (up := tree.setdefault(c, c)) != c:
                tree[c] = tree[up]
                c = up
            return c

        for low in range(held, len(members), CHUNK):
            hits = _linked(members[low : low + CHUNK], members[:held], percent)
            for i, j in zip(*np.nonzero(hits), strict=True):
                a, b = names[low + int(i)], names[int(j)]
                one, two = find(a), find(b)
                if one != two:  # what is tied already needs no further link
                    tree[max(one, two)] = min(one, two)
                    out.append((a, b))
        return out

    return _meetings(open_.select("class", "root", "_c"), sets, placed, work, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, class and component_id of every document."""
    common = bitmap.build(common_tokens(docs), bits)
    signed = saved(signatures(docs, common, percent), "signatures")
    reps = saved(representatives(signed), "representatives")
    chosen = _chosen(reps, bits)
    tokens = saved(shared_tokens(signed, chosen, bits), "tokens")
    cards = saved(class_cards(signed, tokens, reps), "cards")
    partners = saved(possible_partners(cards, _chunks(cards, CHUNK), percent), "partners")
    sets = saved(class_sets(docs, partners, reps, bits), "sets")
    first = saved(group_links(sets, partners, percent), "links")
    open_, placed = qualifying(cards, tokens, components(first), percent)
    ends = open_.select("class").union(open_.select(F.explode("members").alias("class"))).distinct()
    more_sets = saved(class_sets(docs, ends, reps, bits), "sets")
    more = matrix_links(open_, placed, more_sets, percent)
    roots = components(reduce(DataFrame.union, [first, more]))
    # The smallest id of a class, then of a component: both are reduced before they travel.
    classes = signed.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("_id"))
    rooted = _with_roots(classes, roots)
    least = rooted.groupBy("root").agg(F.min("_id").alias("_least"))
    of_class = rooted.join(least, "root").select("class", F.col("_least").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "class").join(of_class, "class", "left")
    return out.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))
