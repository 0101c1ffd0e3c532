"""Near duplicates among vectors by NN-descent.

A neighbour graph is refined until it holds the links (cosine at or above a threshold):

* *Classes.* Equal vectors are one class, so copies never meet each other.
* *Seeds.* Each vector gets a code of signs of random projections in several tables. In the
  order of the codes, slices of ``SLICE`` neighbouring vectors are compared; the best of
  them start each vector's list. Equal codes are cut like all others, so no bucket grows.
* *Descent.* Each round brings to every vector its neighbours and those that list it, and
  compares them with each other where one of a pair is new. Better ones enter the lists.
  A list full of links is saturated: it doubles, up to ``LONGEST``. Rounds end when one
  finds no link between vectors not seen to be connected, or after ``ROUNDS``.
* *Links.* Whatever is met at or above the threshold, in seeds or rounds, connects; a
  place reports only the pairs that connect what it did not know to be connected.
* *Saturated neighbourhoods, whole.* Links lie inside connected groups. A group is cut into
  cells of bounded size by code and hash; two cells are compared vector by vector in double
  precision unless their centres and radii prove that all or none of their pairs link. That
  gives every vector's exact number of links in its group, and exact groups, however large
  a list would have had to become. Only counts and a spanning set of links leave a task.
* *Audit.* The links of a bounded sample, half of it linked, half not, are counted against
  all vectors. While less than ``RECALL`` of them is found, more tables and rounds follow.

Search works on vectors of one byte a dimension with a bound on the error, and keeps what
may be a link; the cells decide. So nothing below the threshold links.

Nulls and odd input: vectors that are null, empty, zero or hold a null or a non-finite
component link with nothing, nor do vectors of different length. Rows without an id are
kept, with no component and no links. Repeated rows are vectors of their own that link
with each other; each says ``kept`` if it has the smallest id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, saved
from .jaccard import components

TABLES = 8  # of seeds, each time seeds are made
BITS = 32  # of a code; how many of them part vectors follows from their number
SLICE = 256
NEIGHBOURS, LONGEST = 6, 24
REVERSE = 8  # vectors that list another one met in a round; others in other rounds
PROPOSALS = 4  # the best new neighbours one place offers to one vector
ROUNDS, ATTEMPTS = 3, 4
CELL = 1024
AUDITED, RECALL = 256, 0.98


def _projections(table: int, dim: int) -> np.ndarray:
    return np.random.default_rng([table, dim]).standard_normal((dim, BITS)).astype(np.float32)


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Rows of a binary column of equal lengths."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 0), kind)


def unit_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(id, h1, h2, unit): the vector scaled to length one as bytes of doubles, null where it can link with nothing;
    h1 and h2 name equal vectors."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0) & F.col(key).isNotNull()
    plain = F.when(usable, F.transform(v, lambda x: x + F.lit(0.0)))
    source = vectors.select(F.col(key).alias("id"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(7), plain).alias("h2"), plain.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(3):
                if not v.is_valid:
                    out.append(None)
                    continue
                x = v.values.to_numpy()
                x = x / np.abs(x).max()
                out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["id", "h1", "h2", "unit"])

    return source.mapInArrow(run, T.StructType([source.schema["id"], *T._parse_datatype_string("h1 long, h2 long, unit binary").fields]))


def _small(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One byte a dimension, what one step is worth, and the length of what rounding took away."""
    step = np.abs(units).max(axis=1) / 127
    q = np.rint(units / step[:, None]).astype(np.int8)
    return q, step, np.sqrt(((units - q * step[:, None]) ** 2).sum(axis=1))


def small_vectors(classes: DataFrame) -> DataFrame:
    """(id, dim, q, step, err) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, units in _by_dim(batch, "unit"):
                q, step, err = _small(units)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(q), units.shape[1]), pa.int32()), pa.array([x.tobytes() for x in q], pa.binary()),
                     pa.array(step), pa.array(err)], names=["id", "dim", "q", "step", "err"])

    return classes.select("id", "unit").mapInArrow(run, "id long, dim int, q binary, step double, err double")


def _by_dim(batch: pa.RecordBatch, column: str, kind=np.float64) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    sizes = np.array([len(x) for x in batch.column(column).to_pylist()], np.int64)
    for size in np.unique(sizes).tolist():
        rows = batch.take(pa.array(np.flatnonzero(sizes == size))) if (sizes != size).any() else batch
        yield rows, _matrix(rows.column(column), kind)


class _Met:
    """Vectors met at one place: cosines by bytes, with a bound above the true ones."""

    def __init__(self, q: np.ndarray, step: np.ndarray, err: np.ndarray):
        scaled = q.astype(np.float32) * step[:, None].astype(np.float32)
        self.cosine = (scaled @ scaled.T).astype(np.float64)
        self.slack = err[:, None] + err[None, :] + err[:, None] * err[None, :] + 1e-5

    def may_link(self, threshold: float) -> np.ndarray:
        out = self.cosine + self.slack >= threshold
        np.fill_diagonal(out, False)
        return out


def _spanning(link: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that connect what the symmetric matrix of links connects; ``known`` marks those connected already."""
    unseen = np.ones(len(link), bool)
    known = np.zeros(len(link), bool) if known is None else known
    out = []
    for start in np.flatnonzero(link.any(axis=1)).tolist():
        if not unseen[start]:
            continue
        unseen[start] = False
        stack = [start]
        while stack:
            at = stack.pop()
            if known[at]:  # what is known to go together is reached at once
                rest = known & unseen
                unseen &= ~rest
                stack.extend(np.flatnonzero(rest).tolist())
            new = np.flatnonzero(link[at] & unseen)
            new = np.delete(new, np.flatnonzero(known[new])[1:])
            if len(new):
                unseen[new] = False
                out.append((np.full(len(new), at), new))
                stack.extend(new.tolist())
    i, j = zip(*out, strict=True) if out else ((), ())
    return np.concatenate([*i, np.zeros(0, np.int64)]), np.concatenate([*j, np.zeros(0, np.int64)])


_PAIRS = "i long, j long, s double, link boolean"


def _pairs(i: np.ndarray, j: np.ndarray, s: np.ndarray, link: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(s, pa.float64()), pa.array(link, pa.bool_())], names=["i", "j", "s", "link"])


def _joined(ids: np.ndarray, link: np.ndarray, cosine: np.ndarray, known: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    i, j = _spanning(link, known)
    if len(i):
        yield _pairs(ids[i], ids[j], cosine[i, j], np.ones(len(i), bool))


def seeds(small: DataFrame, tables: range, threshold: float, slice_: int = SLICE, best: int = 2) -> DataFrame:
    """Pairs from comparing each vector with those whose codes are next to its own: the best of each vector, and
    (``link``) pairs that connect a slice's links."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64))[::-1]
        for batch in batches:
            for rows, q in _by_dim(batch, "q", np.int8):
                for t in tables:
                    signs = q.astype(np.float32) @ _projections(t, q.shape[1]) > 0
                    code = (signs.astype(np.uint64) * weights).sum(axis=1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), t), pa.int32()), pa.array(code), *rows.columns], names=["t", "code", "id", "dim", "q", "step", "err"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            while rows.num_rows >= 2 * slice_:  # slices overlap by half
                yield from _slice(rows.slice(0, slice_))
                rows = rows.slice(slice_ // 2)
            held = rows
        while held is not None and held.num_rows:
            yield from _slice(held.slice(0, slice_))
            held = held.slice(slice_ // 2) if held.num_rows > slice_ else None

    def _slice(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        places = np.stack([rows.column(c).to_numpy() for c in ("t", "dim")], 1).astype(np.int64)
        cuts = np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)], strict=True):
            if b - a < 2:
                continue
            part = rows.slice(a, b - a).combine_chunks().to_batches()[0]
            ids = part.column("id").to_numpy()
            met = _Met(_matrix(part.column("q"), np.int8), part.column("step").to_numpy(), part.column("err").to_numpy())
            cosine = met.cosine
            yield from _joined(ids, met.may_link(threshold), cosine)
            np.fill_diagonal(cosine, -2)
            top = np.argpartition(-cosine, min(best, b - a - 1) - 1, axis=1)[:, : min(best, b - a - 1)]
            i = np.repeat(np.arange(b - a), top.shape[1])
            yield _pairs(ids[i], ids[top.ravel()], cosine[i, top.ravel()], np.zeros(len(i), bool))

    dealt = small.mapInArrow(coded, "t int, code long, id long, dim int, q binary, step double, err double")
    # Equal codes are told apart by the id's hash, so that any number of them can be dealt out.
    order = ["t", "dim", "code", F.xxhash64("id", "t")]
    return dealt.repartitionByRange(partitions(small.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(compared, _PAIRS)


def merged(lists: DataFrame | None, found: DataFrame, threshold: float) -> DataFrame:
    """(i, j, s, fresh, size): the best ``size`` neighbours of each vector, old and found ones together.

    ``size`` starts at NEIGHBOURS and doubles, up to LONGEST, where all neighbours of a list are links.
    """
    new = found.select("i", "j", "s").union(found.where("link").select("j", "i", "s"))
    new = new.select("i", "j", "s", F.lit(True).alias("fresh"), F.lit(NEIGHBOURS).alias("size"))
    rows = new if lists is None else new.union(lists.select("i", "j", "s", F.lit(False), "size"))
    distinct = rows.groupBy("i", "j").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("size").alias("size"))
    ranked = distinct.selectExpr("i", "j", "s", "fresh", "row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS r", "max(size) OVER (PARTITION BY i) AS size")
    kept = ranked.where(F.col("r") <= 2 * F.col("size"))
    full = F.expr(f"max(CASE WHEN r = size THEN s END) OVER (PARTITION BY i) >= {threshold}")
    grown = kept.withColumn("size", F.when(full, F.least(2 * F.col("size"), F.lit(LONGEST))).otherwise(F.col("size")).cast("int"))
    return grown.where("r <= size").select("i", "j", "s", "fresh", "size")


def descent(lists: DataFrame, small: DataFrame, threshold: float, turn: int) -> DataFrame:
    """Pairs found where the neighbours of a vector, both ways, meet each other."""
    order = F.xxhash64("i", "j", F.lit(turn))
    back = lists.select("i", "j", "s", "fresh", order.alias("o")).withColumn("r", F.expr("row_number() OVER (PARTITION BY j ORDER BY o)"))
    back = back.where(F.col("r") <= REVERSE).select(F.col("j").alias("at"), F.col("i").alias("id"), "s", "fresh")
    worst = lists.groupBy("i").agg(F.min("s").alias("worst"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    worst = worst.select(F.col("i").alias("id"), F.when(F.col("n") < F.col("size"), -2.0).otherwise(F.col("worst")).alias("worst"))
    around = lists.select(F.col("i").alias("at"), F.col("j").alias("id"), "s", "fresh").union(back)
    around = around.groupBy("at", "id").agg(F.max("s").alias("s"), F.max("fresh").alias("fresh"))
    told = around.join(small.join(worst, "id"), "id").select("at", "id", "s", "fresh", "worst", "q", "step", "err")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "at"):
            if rows.num_rows < 2 or not any(rows.column("fresh").to_pylist()):
                continue
            ids, fresh, s = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "fresh", "s"))
            met = _Met(_matrix(rows.column("q"), np.int8), rows.column("step").to_numpy(), rows.column("err").to_numpy())
            cosine, n = met.cosine, rows.num_rows
            new = fresh[:, None] | fresh[None, :]
            # Those that link with the vector of this place are connected through it.
            yield from _joined(ids, met.may_link(threshold) & new, cosine, s >= threshold)
            offered = np.where(new, cosine, -2)
            np.fill_diagonal(offered, -2)
            offered[offered <= rows.column("worst").to_numpy()[:, None]] = -2
            top = np.argsort(-offered, axis=1)[:, :PROPOSALS]
            i = np.repeat(np.arange(n), top.shape[1])
            j = top.ravel()
            on = offered[i, j] > -2
            if on.any():
                yield _pairs(ids[i[on]], ids[j[on]], cosine[i[on], j[on]], np.zeros(int(on.sum()), bool))

    return told.repartition(partitions(small.sparkSession), "at").sortWithinPartitions("at").mapInArrow(run, _PAIRS)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Rows of sorted batches by key; a group is as large as a list and what lists it may be."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield _one(held)
                held = []
            held.append(part)
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def cells(members: DataFrame, size: int = CELL) -> DataFrame:
    """(root, dim, cell, n, ids, weights, units, centre, radius): the vectors of each group in cells of about ``size``.

    ``members`` has id, root, copies, code and unit. Cells part a group by the code's leading byte and, where
    many share it, by hash, so that no task numbers a group's rows.
    """
    keys = ["root", "dim", "part"]
    rows = members.withColumns({"dim": F.octet_length("unit"), "part": F.shiftright("code", BITS - 8)})
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_part"))
    whole = counted.groupBy("root", "dim").agg(F.sum("in_part").alias("in_group")).select(F.col("root").alias("_r"), F.col("dim").alias("_d"), "in_group")
    sizes = counted.join(whole, (F.col("root") == F.col("_r")) & (F.col("dim") == F.col("_d"))).select(
        F.col("root").alias("_r"), F.col("dim").alias("_d"), F.col("part").alias("_p"),
        (F.col("in_group") <= size).alias("single"), F.ceil(F.col("in_part") / size).alias("pieces"))
    placed = rows.join(sizes, (F.col("root") == F.col("_r")) & (F.col("dim") == F.col("_d")) & (F.col("part") == F.col("_p")))
    cell = F.when(F.col("single"), F.lit(-1)).otherwise(F.col("part") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("pieces")))
    # One struct a vector, about CELL of them in an array: bounded, since hashes deal evenly.
    packed = placed.groupBy("root", "dim", cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct("id", "copies", "unit"))).alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.slice(0).to_pylist():
                units = np.frombuffer(b"".join(m["unit"] for m in row["m"])).reshape(len(row["m"]), -1)
                centre = units.sum(axis=0)
                length = np.sqrt(centre @ centre)
                centre = centre / length if length > 1e-9 else units[0]
                radius = float(np.arccos(np.clip(units @ centre, -1, 1)).max())
                ids = np.array([m["id"] for m in row["m"]], np.int64).tobytes()
                copies = np.array([m["copies"] for m in row["m"]], np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "root": row["root"], "dim": row["dim"], "cell": row["cell"], "n": len(row["m"]), "total": int(copies.sum()),
                    "ids": ids, "copies": copies.tobytes(), "units": units.tobytes(), "centre": centre.tobytes(), "radius": radius}], schema=_cell_schema)

    return packed.mapInArrow(run, _CELL_COLUMNS)


_CELL_COLUMNS = "root long, dim int, cell long, n int, total long, ids binary, copies binary, units binary, centre binary, radius double"
_cell_schema = pa.schema([
    ("root", pa.int64()), ("dim", pa.int32()), ("cell", pa.int64()), ("n", pa.int32()), ("total", pa.int64()), ("ids", pa.binary()),
    ("copies", pa.binary()), ("units", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())])


def cell_links(found: DataFrame, threshold: float) -> DataFrame:
    """(id, n, other): for each vector and cell of its group the copies there it links with; ``other`` connects the links.

    Pairs of cells are told apart by centres first; only those that may hold both kinds of pairs are compared.
    """
    key = F.struct("root", "dim", "cell")
    heads = found.select("root", "dim", "cell", "centre", "radius")
    other = heads.select(F.col("root").alias("_r"), F.col("dim").alias("_d"), F.col("cell").alias("cell2"), F.col("centre").alias("centre2"), F.col("radius").alias("radius2"))
    met = heads.join(other, (F.col("root") == F.col("_r")) & (F.col("dim") == F.col("_d")) & (F.col("cell") <= F.col("cell2")))
    angle = float(np.arccos(threshold))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, a in _by_dim(batch, "centre"):
                b = _matrix(rows.column("centre2"))
                apart = np.arccos(np.clip((a * b).sum(axis=1), -1, 1))
                reach = rows.column("radius").to_numpy() + rows.column("radius2").to_numpy()
                may, all_ = apart - reach <= angle + 1e-6, apart + reach <= angle - 1e-6
                out = pa.RecordBatch.from_arrays([rows.column("root"), rows.column("dim"), rows.column("cell"), rows.column("cell2"), pa.array(all_)], names=["root", "dim", "cell", "cell2", "sure"])
                yield out.filter(pa.array(may))

    pairs = met.select("root", "dim", "cell", "cell2", "centre", "centre2", "radius", "radius2").mapInArrow(told, "root long, dim int, cell long, cell2 long, sure boolean")
    mine = found.select(key.alias("k"), "ids", "copies", "units", "total")
    both = (
        pairs.withColumns({"k": key, "k2": F.struct("root", "dim", F.col("cell2").alias("cell"))}).select("k", "k2", "sure")
        .join(mine, "k").join(mine.select(F.col("k").alias("k2"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("units").alias("units2"), F.col("total").alias("total2")), "k2")
        .select((F.col("k") == F.col("k2")).alias("same"), "sure", "ids", "copies", "units", "total", "ids2", "copies2", "units2", "total2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                yield _compared(row, threshold)

    return both.mapInArrow(run, "id long, n long, other long")


def _compared(row: dict, threshold: float) -> pa.RecordBatch:
    ids, ids2 = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ids2"], np.int64)
    copies, copies2 = np.frombuffer(row["copies"], np.int64), np.frombuffer(row["copies2"], np.int64)
    size = len(ids) + (0 if row["same"] else len(ids2))
    if row["sure"]:
        n, n2 = np.full(len(ids), row["total2"]), np.full(len(ids2), row["total"])
        i, j = np.zeros(size - 1, np.int64), np.arange(1, size)
        if not row["same"]:  # the first of each cell stand for theirs
            i[: len(ids) - 1] = len(ids)
    else:
        a, b = np.frombuffer(row["units"]).reshape(len(ids), -1), np.frombuffer(row["units2"]).reshape(len(ids2), -1)
        link = a @ b.T >= threshold
        if row["same"]:
            link |= link.T
            np.fill_diagonal(link, True)
        n, n2 = link @ copies2, link.T @ copies
        whole = link & ~np.eye(size, dtype=bool) if row["same"] else np.block([[np.zeros((len(a), len(a)), bool), link], [link.T, np.zeros((len(b), len(b)), bool)]])
        i, j = _spanning(whole)
    every = ids if row["same"] else np.concatenate([ids, ids2])
    counts = n if row["same"] else np.concatenate([n, n2])
    keep = counts > 0
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([every[keep], every[i]])), pa.array(np.concatenate([counts[keep], np.zeros(len(i), np.int64)])),
         pa.array([None] * int(keep.sum()) + every[j].tolist(), pa.int64())], names=["id", "n", "other"])


def _code(unit_dim: np.ndarray) -> np.ndarray:
    weights = (np.uint64(1) << np.arange(BITS, dtype=np.uint64))[::-1]
    return ((unit_dim.astype(np.float32) @ _projections(0, unit_dim.shape[1]) > 0).astype(np.uint64) * weights).sum(axis=1).astype(np.int64)


def _with_codes(rows: DataFrame) -> DataFrame:
    """Adds the code that parts groups into cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, units in _by_dim(batch, "unit"):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_code(units))], names=[*part.schema.names, "code"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.LongType())]))


def exact_links(classes: DataFrame, pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, n), (class, root)): copies that each class of a group links with, its own included, and the exact groups."""
    groups = components(pairs.select(F.col("i").alias("a"), F.col("j").alias("b")))
    members = classes.join(groups.select(F.col("class").alias("id"), "root"), "id").select("id", "root", "copies", "unit")
    found = saved(cells(_with_codes(members)), "cells")
    links = saved(cell_links(found, threshold), "cell-links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    return counts, components(links.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))


def audit(classes: DataFrame, counts: DataFrame, threshold: float, sample: int = AUDITED) -> float:
    """Share found of the links of a sample of classes, half of them with links, counted against all vectors."""
    lucky = F.xxhash64("id", F.lit(11))
    some = classes.join(counts, "id", "left").select("id", "unit", "copies", F.coalesce("n", "copies").alias("n"), (F.col("n") > F.col("copies")).alias("linked"))
    picked = some.where("linked").orderBy(lucky).limit(sample).union(some.where("linked IS NULL OR NOT linked").orderBy(lucky).limit(sample)).collect()
    by_dim: dict[int, list] = {}
    for row in picked:
        by_dim.setdefault(len(row.unit), []).append(row)
    asked = {d: np.frombuffer(b"".join(r.unit for r in rows)).reshape(len(rows), -1) for d, rows in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(a), np.int64) for d, a in asked.items()}
        for batch in batches:
            for rows, units in _by_dim(batch, "unit"):
                d = units.shape[1] * 8
                if d in asked:
                    total[d] += (units @ asked[d].T >= threshold).T @ rows.column("copies").to_numpy()
        d = [x for x, t in total.items() for _ in t]
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array([i for t in total.values() for i in range(len(t))], pa.int32()), pa.array([int(x) for t in total.values() for x in t], pa.int64())], names=["d", "i", "n"])

    true = {(r.d, r.i): r.n for r in classes.select("unit", "copies").mapInArrow(run, "d int, i int, n long").groupBy("d", "i").agg(F.sum("n").alias("n")).collect()}
    need = sum(true[d, i] - r.copies for d, rows in by_dim.items() for i, r in enumerate(rows))
    have = sum(min(r.n, true[d, i]) - r.copies for d, rows in by_dim.items() for i, r in enumerate(rows))
    return have / need if need > 0 else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """Per row: the id, n_links (other vectors linked directly), component_id (least id reachable) and kept."""
    rows = saved(unit_vectors(vectors, vector, key), "units")
    named = rows.where("unit IS NOT NULL")
    classes = named.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # The row of the least id stands for its class; ids that come several times, for different vectors too, are told apart.
    ranked = classes.join(named.select("h1", "h2", "id", "unit"), ["h1", "h2", "id"]).dropDuplicates(["h1", "h2"])
    names = saved(ranked.select("h1", "h2", F.col("id").alias("least"), F.monotonically_increasing_id().alias("id"), "copies", "unit"), "classes")
    stand = names.select("id", "copies", "unit")
    small = saved(small_vectors(stand), "small")
    lists, pairs, counts, groups, turn = None, None, None, None, 0
    for attempt in range(ATTEMPTS):
        found = saved(seeds(small, range(attempt * TABLES, (attempt + 1) * TABLES), threshold), "seeds")
        connects = found.where("link")
        pairs = connects if pairs is None else pairs.union(connects)
        lists = saved(merged(lists, found, threshold), "lists")
        for _ in range(ROUNDS):
            turn += 1
            found = saved(descent(lists, small, threshold, turn), "found")
            if found.where("link").isEmpty():
                break
            pairs = pairs.union(found.where("link"))
            lists = saved(merged(lists, found, threshold), "lists")
        counts, groups = exact_links(stand, pairs, threshold)
        if audit(stand, counts, threshold) >= RECALL:
            break
    told = names.join(counts, "id", "left").join(groups.select(F.col("class").alias("id"), "root"), "id", "left")
    roots = told.withColumn("root", F.coalesce("root", "id"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = roots.join(least, "root").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), (F.coalesce("n", "copies") - 1).alias("n_links"), "component_id")
    joined = rows.select("id", "h1", "h2", F.col("unit").isNotNull().alias("on")).join(of_class, F.col("on") & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component: Column = F.coalesce("component_id", "id")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))
