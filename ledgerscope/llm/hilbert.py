"""Sharding by Hilbert curve: neighbours on the curve are neighbours in every dimension.

Each dimension is cut into 2^bits cells of about as many rows each, so hot values only
repeat a cut: numbers at approximate quantiles, texts at the values where the running
total of rows over the distinct values, in order, reaches each share. The curve index of
the cells gives the order. Equal texts take the smallest index among them and follow each
other by id, so a group of equal texts lies in one shard unless one of the 7 cuts between
shards falls into it, which law ``rows`` cannot avoid. Runs are cut by rank, so shard
sizes differ by one row at most (law ``rows``).

Ranks come without a global sort. A cell of the curve is numbered in slices of about
``SLICE_ROWS`` rows by the hash of the text, a text with more copies than that in slices by
the hash of its ids. Rows are counted per slice, running totals are taken over those
counts, and rows are numbered inside their slice only.

Nulls sort as the lowest cell, null text has size 1 and checksum 0 and is a text like any
other. Repeated rows get a slot each, in an order that is not defined among them. Empty
tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved

BITS = 5
#: Rows that one numbering task should hold; gives the number of slices.
SLICE_ROWS = 200_000
SENT_BITS = 16  # cell counts are sent to every task up to 2^16 cells, about a megabyte


def _rotate(bits: int, by: int, n: int) -> int:
    by %= n
    return ((bits << by) | (bits >> (n - by))) & ((1 << n) - 1)


def curve_table(n: int) -> tuple[list[int], list[int]]:
    """Next state and digit of the n-dimensional curve, indexed by state * 2^n + octant.

    A state is where the curve enters a cell and along which axis it runs; both follow
    from reflected Gray codes.
    """
    cells = 1 << n
    gray = lambda i: i ^ (i >> 1)
    trailing = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  ones at the low end
    rank = {gray(i): i for i in range(cells)}
    enter = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    axis = lambda i: 0 if i == 0 else trailing(i - 1 if i % 2 == 0 else i) % n
    states, after, digit = [(0, 0)], [], []
    for entry, along in states:  # grows while it is walked
        for octant in range(cells):
            d = rank[_rotate(octant ^ entry, n - (along + 1) % n, n)]
            nxt = (entry ^ _rotate(enter(d), along + 1, n), (along + axis(d) + 1) % n)
            if nxt not in states:
                states.append(nxt)
            after.append(states.index(nxt))
            digit.append(d)
    return after, digit


def curve_index(cells: list[Column], bits: int = BITS) -> Column:
    """Position on the Hilbert curve of integer coordinates below 2^bits."""
    n = len(cells)
    after, digit = curve_table(n)
    next_state, digits = F.array(*map(F.lit, after)), F.array(*map(F.lit, digit))
    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))

    def step(acc: Column, level: Column) -> Column:
        octant = reduce(lambda a, b: a + b, [
            F.call_function("shiftright", F.get(coords, F.lit(k)), level).bitwiseAND(F.lit(1)) * (1 << k) for k in range(n)])
        return let(acc["state"] * (1 << n) + octant, lambda at: F.struct(
            F.get(next_state, at).alias("state"), (acc["index"] * (1 << n) + F.get(digits, at)).alias("index")))

    coords = F.array(*[c.cast("int") for c in cells])
    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, start, step)["index"]


def text_cuts(df: DataFrame, name: str, shares: list[float]) -> list[str]:
    """The smallest values of a text column below or at which lie these shares of its rows.

    Rows are summed per distinct value first. The values are dealt by Spark's range
    partitioning, and running totals run inside each range on top of one total a range.
    """
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    table = saved(values.repartitionByRange("x").withColumn("r", F.spark_partition_id()), "values")
    ranges = table.groupBy("r").agg(F.sum("n").alias("_n"))  # one row a partition
    past = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("r", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = table.join(ranges, "r").select("x", (F.col("_before") + F.sum("n").over(upto)).alias("upto"))
    total = table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = running.agg(*[F.min(F.when(F.col("upto") >= share * total, F.col("x"))).alias(f"_{i}") for i, share in enumerate(shares)])
    return [x for x in at.first() if x is not None]


def hilbert_order(df: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """Adds ``curve``, the Hilbert index of the quantised dimensions."""
    kinds = dict(df.dtypes)
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    values = {d: F.col(d) if kinds[d] == "string" else F.col(d).cast("long") for d in dims}
    numbers = [d for d in dims if kinds[d] != "string"]
    cuts = {}
    if numbers:
        row = df.agg(*[F.percentile_approx(values[d], shares, 10_000).alias(f"_{i}") for i, d in enumerate(numbers)]).first()
        cuts = {d: row[i] or [] for i, d in enumerate(numbers)}
    cells = []
    for d in dims:
        cut = sorted(set(cuts[d] if d in cuts else text_cuts(df, d, shares)))
        above = [F.when(values[d] >= F.lit(x), 1).otherwise(0) for x in cut]
        cells.append(reduce(lambda a, b: a + b, above) if above else F.lit(0))
    return df.withColumn("curve", curve_index(cells, bits))


def _slice(hash_: Column, slices: Column) -> Column:
    """Which of ``slices`` equal parts of the range of a 64-bit hash it lies in."""
    return F.floor(F.shiftrightunsigned(hash_, 32).cast("double") * slices / F.lit(1 << 32)).cast("long")


def cut_runs(ordered: DataFrame, shards: int, bits: int, dims: int, rows: int) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows with ``curve``, the hashes ``_text`` and ``_id``, and ``_copies``,
    the rows of the text where they are more than one; the order is curve, text, id."""
    cells = ordered.groupBy("curve").agg(F.count(F.lit(1)).alias("_cell"))
    if bits * dims <= SENT_BITS:  # at most 2^(bits * dims) rows of two numbers; so a hot cell is not gathered for the join
        cells = F.broadcast(cells)
    hot = F.coalesce(F.col("_copies"), F.lit(1)) > SLICE_ROWS
    placed = ordered.join(cells, "curve").select(
        *ordered.columns,
        _slice(F.col("_text"), F.ceil(F.col("_cell") / SLICE_ROWS)).alias("_part"),
        # Texts with few copies come first in their part, under hash 0 and in one slice.
        F.when(hot, F.col("_text")).otherwise(F.lit(0)).alias("_hot"),
        F.when(hot, _slice(F.col("_id"), F.ceil(F.col("_copies") / SLICE_ROWS))).otherwise(F.lit(0)).alias("_sub"))
    unit = ["curve", "_part", "_hot", "_sub"]
    counts = placed.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n"))
    counts = saved(counts.withColumn("_coarse", F.shiftrightunsigned(F.col("curve"), max(0, bits * dims - 8))), "counts")
    coarse = counts.groupBy("_coarse").agg(F.sum("_n").alias("_cn"))  # 256 rows at most
    before = Window.orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("_coarse", F.coalesce(F.sum("_cn").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_coarse").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.join(coarse, "_coarse").select(
        *unit, (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_offset"))
    numbered = placed.withColumn("_at", F.row_number().over(Window.partitionBy(*unit).orderBy("_text", "_id", "doc_id")) - 1)
    # Shard s takes ranks from ceil(s * rows / shards) on, so sizes differ by one at most.
    out = numbered.join(offsets, unit).withColumn("_rank", F.col("_offset") + F.col("_at"))
    out = out.withColumn("shard", F.expr(f"CAST((_rank * {shards}) div {max(rows, 1)} AS INT)"))
    first = F.expr(f"(shard * CAST({rows} AS BIGINT) + {shards - 1}) div {shards}")
    return out.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_part", "_hot", "_sub", "_at", "_offset", "_rank")


def shard_documents(docs: DataFrame, shards: int = 8, dims: tuple[str, ...] = ("source", "lang", "size"), bits: int = BITS) -> DataFrame:
    """doc_id, size, checksum, curve index, shard and slot of every document."""
    body = F.col("text")
    base = docs.select(
        "doc_id", *[d for d in dims if d != "size"],
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(body, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(body).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    # Texts are read and hashed once. Rows without an id are told apart by their place.
    base = saved(base, "base").withColumn("_id", F.when(F.col("doc_id").isNull(), F.xxhash64("_row")).otherwise(F.xxhash64("doc_id")))
    rows = base.count()
    ordered = saved(hilbert_order(base.drop("_row"), list(dims), bits), "curve")
    groups = ordered.groupBy("_text").agg(F.count(F.lit(1)).alias("_copies"), F.min("curve").alias("_least")).where(F.col("_copies") > 1)
    together = ordered.join(groups, "_text", "left").withColumn("curve", F.coalesce("_least", "curve")).drop("_least")
    cut = cut_runs(saved(together, "together"), shards, bits, len(dims), rows)
    return cut.select("doc_id", "size", "text_crc32", "curve", "shard", "slot")
