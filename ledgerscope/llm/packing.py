"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

A document of more than ``capacity`` tokens is cut so that all pieces but the first are
full. Full pieces are sequences of their own. The others are dealt by hash into pools of
about ``POOL`` pieces, so no task ever holds more than a few pools, whatever one source or
length holds. Each pool is evolved on ``ISLANDS`` islands, with other seeds, for
``EPOCHS`` epochs; between epochs an island gets the best packing of its neighbour.

A packing is a list of bins. First packings put the pieces, in random orders, where they
fit best. Crossover takes whole well-filled bins of one parent into the other, takes out
the bins that now hold a piece twice, gives up the emptiest ones, and best-fits the pieces
displaced by that, longest first. A pool that reaches ceil(tokens / capacity) bins, which
no packing can beat, stops there.

Pools meet: the emptiest eighth of each pool's bins, one at least, goes on to a further
round, dealt by whole bins into fewer pools, until there is one pool or no packing could
be better. A round starts from the bins it was given too, so none makes it worse. What the
split into pools costs is the last bin of the last pool.

Nulls and odd input: a null text is the empty text, one token (the separator). Repeated
rows are packed each. Empty tables give empty tables.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, library_ids
from .common import saved

CAPACITY = 2048
POOL = 4_000
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 10
POPULATION = 4
OPEN = 8  # one bin in so many, the emptiest, goes on to the next round
SEPARATOR = b"\x00\x00\x00\x00"  # id 0, little-endian

Bins = list[list[int]]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and checksum of the ids of every piece."""
    ids = bpe.encode(docs.select("doc_id", "text"), path, by=library_ids.encoder)
    ids = ids.select("doc_id", F.concat("ids", F.lit(SEPARATOR)).alias("ids"))
    cut = ids.withColumn("_first", F.expr(f"CASE WHEN octet_length(ids) div 4 % {capacity} = 0 THEN {capacity} ELSE octet_length(ids) div 4 % {capacity} END").cast("int"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((octet_length(ids) div 4 - 1) div {capacity} AS INT)"))))
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("_first") + (F.col("piece") - 1) * capacity)
    length = F.when(F.col("piece") == 0, F.col("_first")).otherwise(capacity)
    return cut.select(
        "doc_id", "piece", start.cast("long").alias("start"), length.cast("long").alias("length"),
        F.crc32(F.col("ids").substr(start * 4 + 1, length * 4)).cast("long").alias("ids_crc32"))


class Packer:
    """Best fit over open bins, found by their free room."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity

    def best_fit(self, bins: Bins, order: list[int]) -> Bins:
        """Puts pieces, in this order, each into the open bin with the least room that takes it."""
        sizes, capacity = self.sizes, self.capacity
        by_room: dict[int, list[int]] = {}
        open_rooms = 0  # bit r: a bin has room r
        for b, held in enumerate(bins):
            room = capacity - sum(map(sizes.__getitem__, held))
            if room:
                by_room.setdefault(room, []).append(b)
                open_rooms |= 1 << room
        for item in order:
            size = sizes[item]
            fitting = open_rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                at = by_room[room].pop()
                if not by_room[room]:
                    open_rooms ^= 1 << room
                bins[at].append(item)
            else:
                room, at = capacity, len(bins)
                bins.append([item])
            left = room - size
            if left:
                by_room.setdefault(left, []).append(at)
                open_rooms |= 1 << left
        return bins

    def fill(self, held: list[int]) -> int:
        return sum(map(self.sizes.__getitem__, held))

    def fitness(self, bins: Bins) -> tuple[int, int]:
        """Fewer bins first; then unequal filling, which leaves room that can be used."""
        return -len(bins), sum(self.fill(b) ** 2 for b in bins)

    def cross(self, host: Bins, donor: Bins, rng: random.Random) -> Bins:
        filled = [b for b in donor if self.fill(b) * 50 >= self.capacity * 49]
        gift = rng.sample(filled, len(filled) // 2) if filled else []
        given = {i for b in gift for i in b}
        kept, displaced = [], []
        for b in host:
            if given.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in given]
        worst = sorted(range(len(kept)), key=lambda k: self.fill(kept[k]))[: max(2, len(kept) // 50)]
        for k in sorted(worst, reverse=True):  # mutation: the emptiest bins are given up
            displaced += kept.pop(k)
        displaced.sort(key=lambda i: -self.sizes[i] + rng.random())
        return self.best_fit([list(b) for b in (*gift, *kept)], displaced)


def evolve(sizes: list[int], population: list[Bins], rng: random.Random, capacity: int, generations: int, most: int) -> list[Bins]:
    """Best packings first. ``population`` may be empty."""
    packer, floor = Packer(sizes, capacity), -(-sum(sizes) // capacity)
    population = list(population)
    while len(population) < most:
        population.append(packer.best_fit([], rng.sample(range(len(sizes)), len(sizes))))
    rank = lambda all_: sorted(all_, key=packer.fitness, reverse=True)[:most]
    population = rank(population)
    for _ in range(generations):
        if len(population[0]) <= floor:
            break
        children = [packer.cross(*rng.sample(population, 2), rng) for _ in range(most)]
        population = rank(population + children)
    return population


def _bin_of(bins: Bins, n: int) -> list[int]:
    at = [0] * n
    for b, held in enumerate(bins):
        for item in held:
            at[item] = b
    return at


def _bins(bin_of: np.ndarray) -> Bins:
    bins: dict[int, list[int]] = {}
    for item, b in enumerate(bin_of.tolist()):
        bins.setdefault(b, []).append(item)
    return list(bins.values())


def _offsets(bin_of: list[int], sizes: list[int]) -> list[int]:
    used: dict[int, int] = {}
    out = []
    for b, s in zip(bin_of, sizes, strict=True):
        out.append(used.get(b, 0))
        used[b] = out[-1] + s
    return out


def _open(bins: Bins, sizes: list[int], capacity: int) -> list[bool]:
    """Whether a piece lies in one of the emptiest bins, which go on to the next round."""
    packer = Packer(sizes, capacity)
    emptiest = sorted(bins, key=packer.fill)[: -(-len(bins) // OPEN)]
    out = [False] * len(sizes)
    for held in emptiest:
        if packer.fill(held) < capacity:
            for item in held:
                out[item] = True
    return out


def _epoch(islands: DataFrame, capacity: int, generations: int, most: int, seed: tuple[int, int]) -> DataFrame:
    """One epoch on every island: its population (bin of each piece), best first, and of the best one the
    offsets and the pieces of its emptiest bins."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                sizes, rng = [int(s) for s in row.sizes], random.Random(hash((row.pool, row.island, *seed)))
                found = evolve(sizes, [_bins(g) for g in row.genomes], rng, capacity, generations, most)
                genomes = [_bin_of(b, len(sizes)) for b in found]
                yield pd.DataFrame({
                    "pool": [row.pool], "island": [row.island], "bins": [len(found[0])], "genomes": [genomes],
                    "offsets": [_offsets(genomes[0], sizes)], "open": [_open(found[0], sizes, capacity)]})

    return islands.mapInPandas(
        run, "pool long, island int, bins long, genomes array<array<long>>, offsets array<int>, open array<boolean>")


def _round(grouped: DataFrame, size: str, pools: int, capacity: int, islands: int, epochs: int, generations: int, population: int, number: int) -> DataFrame:
    """Best packing of every pool: pool, bins, and the bin, the offset and the openness of each piece.

    ``grouped`` has the pieces of a pool in ``_rows``; ``_rows._bin`` is the bin they came in, null at first.
    """
    problem = grouped.select(
        F.col("_pool").alias("pool"), F.transform("_rows", lambda r: r[size].cast("int")).alias("sizes"),
        F.transform("_rows", lambda r: r["_bin"]).alias("_given"))
    given = F.when(F.exists("_given", lambda b: b.isNotNull()), F.array("_given")).otherwise(F.array().cast("array<array<long>>"))
    problem = problem.select("pool", "sizes", given.alias("genomes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    tasks = min(pools * islands, 4 * grouped.sparkSession.sparkContext.defaultParallelism)
    now, state = problem, None
    for epoch in range(epochs):
        if state is not None:  # the best of the neighbour joins the island's own
            own = state.select("pool", "island", "genomes")
            elite = state.select("pool", ((F.col("island") + 1) % islands).alias("island"), F.slice("genomes", 1, 1).alias("_elite"))
            now = problem.drop("genomes").join(own, ["pool", "island"]).join(elite, ["pool", "island"])
            now = now.select("pool", "island", "sizes", F.concat("genomes", "_elite").alias("genomes"))
        state = saved(_epoch(now.repartition(tasks, "pool", "island"), capacity, generations, population, (number, epoch)), "islands")
    one = F.struct("bins", F.col("genomes")[0].alias("bin"), F.col("offsets").alias("at"), "open")
    best = state.groupBy("pool").agg(F.min_by(one, F.struct("bins", "island")).alias("_best"))
    return best.select("pool", "_best.*")


def pack(rows: DataFrame, size: str = "length", capacity: int = CAPACITY, pool: int = POOL, islands: int = ISLANDS,
         epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows whose ``size`` lies between 1 and ``capacity``."""
    names = rows.columns
    base = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    packed = base.where(F.col(size) >= capacity).select(
        *names, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = base.where(F.col(size) < capacity)
    count, tokens = rest.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    floor, closed, first_id, number = -(-tokens // capacity), 0, 0, 0
    pools = max(1, -(-count // pool))
    # About ``pool`` rows each, whatever the data: a pool is a hash of row numbers, later of bins.
    dealt = rest.select("*", F.lit(None).cast("long").alias("_bin"), F.pmod(F.xxhash64("_row"), F.lit(pools)).alias("_pool"))
    while True:
        grouped = dealt.groupBy("_pool").agg(F.sort_array(F.collect_list(F.struct("_row", "_bin", *names))).alias("_rows"))
        grouped = saved(grouped, "pools")
        best = _round(grouped, size, pools, capacity, islands, epochs, generations, population, number)
        placed = grouped.join(best, grouped["_pool"] == best["pool"]).select(
            "pool", F.explode(F.arrays_zip("_rows", "bin", "at", "open")).alias("_p"))
        placed = saved(placed.select(
            "_p._rows._row", *[F.col(f"_p._rows.{n}").alias(n) for n in names],
            (F.col("pool") * (1 << 20) + F.col("_p.bin") + first_id).alias("sequence_id"),
            F.col("_p.at").cast("long").alias("offset"), F.col("_p.open").alias("_open")), "placed")
        first_id += pools << 20
        # A bin has one piece at offset 0.
        head = F.col("offset") == 0
        bins, left = placed.agg(F.count(F.when(head, 1)), F.count(F.when(F.col("_open"), 1))).first()
        if pools == 1 or left == 0 or closed + bins <= floor:
            return packed.unionByName(placed.select(*names, "sequence_id", "offset"))
        done = placed.where(~F.col("_open"))
        packed = packed.unionByName(done.select(*names, "sequence_id", "offset"))
        closed += done.where(head).count()
        pools, number = max(1, min(-(-left // pool), pools // 2)), number + 1
        dealt = placed.where("_open").select(
            "_row", *names, F.col("sequence_id").alias("_bin"), F.pmod(F.xxhash64("sequence_id"), F.lit(pools)).alias("_pool"))


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(docs, path, capacity), "length", capacity)
