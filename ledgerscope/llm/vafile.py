"""Exact top-k inner products by a vector-approximation file.

Vectors hold whole numbers, as doubles, since ``floor(scale * x)`` of a large x fits no
integer type. Each dimension is cut into 2^``BITS`` cells of equal width; the approximation
file keeps one byte per dimension, the cell. Every value lies within half a cell of its
cell's middle, so the product with the middles bounds the product with the vector from
above and below; the bounds allow for the rounding of doubles. Vectors of like magnitude
share a grid, so a huge vector does not widen the cells of the others.

1. *Scan of the approximations.* Blocks of queries meet parts of the file, block by block of
   cells; per query the k-th largest lower bound so far rules out all whose upper bound is smaller.
2. *Exact reads in bound order.* The k candidates with the best bounds are read first.
   Their k-th exact product is certain to be reached, so only candidates whose upper
   bound is at least that are read next; all others cannot be among the first k.

Equal vectors form one class with its ``k + 1`` smallest ids, which is all that a list of
k can show (one of them may be the query itself), so a vector with very many copies costs
as much as one. Each query is compared with every class in blocks, none is sampled.

Nulls and odd input: vectors that are null, empty, or hold a null or non-finite component
take no part, nor do those whose scaled component is beyond a double; vectors of different
length are not compared with each other. Components of any size are multiplied exactly:
where a product may leave a long, in whole numbers of Python. Lists are ordered by the exact
score; a score beyond a long is shown as the nearest long. Rows of one id and equal vectors
count once. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import saved

BITS = 6
SCALE = 256
BLOCK, BLOCK_BYTES = 4_096, 1 << 20  # vectors in a block of the approximation file, fewer if they are long
QUERY_BLOCK, QUERY_BYTES = 4_096, 1 << 22
PART = 65_536  # vectors of the file that one task compares with a block of queries
STEP = 512  # queries that are multiplied with a block at once
HELD = 400_000  # candidates that a task holds before it writes them
SMALL = 1 << 25  # components up to here, in vectors of up to DIMS, have products that fit a long
DIMS = 4_096
EPS = 2.0**-52
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def integer_vectors(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id and ``v``, the scaled and floored components, without unusable vectors."""
    x = F.col(vector)
    unbounded = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    bad = F.exists(x, lambda c: c.isNull() | unbounded(c.cast("double") * scale))
    # From 2^53 on every double is whole already, and might not fit the long that floor gives.
    floored = lambda y: F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)
    whole = F.transform(x, lambda c: floored(c.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad).select("vec_id", whole.alias("v"))


def _band() -> Column:
    """Magnitude of a vector: 0 where products of such vectors fit a long, then one number for each factor of 256."""
    widest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    above = F.greatest(F.lit(1), F.ceil((F.log2(widest) - 25) / 8).cast("int"))
    return F.when((widest <= SMALL) & (F.size("v") <= DIMS), 0).otherwise(above)


def classes(vectors: DataFrame, k: int, is_query: Column) -> DataFrame:
    """One row per distinct vector: class, v, dim, its k + 1 smallest ids, and whether a query has it."""
    by_id = Window.partitionBy("_h", "v").orderBy("vec_id")
    rows = vectors.withColumn("_h", F.xxhash64("v"))
    # row_number <= k + 1 is applied before the shuffle too, so copies do not travel.
    least = rows.withColumn("_n", F.dense_rank().over(by_id)).where(F.col("_n") <= k + 1).dropDuplicates(["_h", "v", "vec_id"])
    asks = rows.where(is_query).select("_h", "v").distinct().withColumn("asked", F.lit(True))
    found = least.groupBy("_h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    found = found.join(asks, ["_h", "v"], "left")
    return found.select(
        F.monotonically_increasing_id().alias("class"), "v", F.size("v").alias("dim"), _band().alias("band"), "ids",
        F.coalesce("asked", F.lit(False)).alias("asked"))


def cell_grid(found: DataFrame, bits: int) -> DataFrame:
    """Lowest value and cell width of every dimension of the vectors of one length and magnitude."""
    ends = found.select("dim", "band", F.posexplode("v").alias("at", "x"))
    ends = ends.groupBy("dim", "band", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # Halves before the difference: two ends may be further apart than the largest double.
    width = F.greatest(F.lit(1.0), ((F.col("high") / 2 - F.col("low") / 2) / (1 << (bits - 1))) * (1 + 1e-12) + F.lit(1.0) / (1 << bits))
    cells = ends.groupBy("dim", "band").agg(F.sort_array(F.collect_list(F.struct("at", "low", width.alias("width")))).alias("_g"))
    return cells.select("dim", "band", F.col("_g.low").alias("low"), F.col("_g.width").alias("width"))


def cell_bytes(bits: int) -> Column:
    """One byte for each dimension of ``v``: its cell in the grid's ``low`` and ``width``."""
    steps = F.zip_with(F.zip_with("v", "low", lambda x, low: x / 2 - low / 2), "width", lambda d, w: d / w * 2)
    inside = F.transform(steps, lambda c: F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(c).cast("int"))))
    return F.unhex(F.array_join(F.transform(inside, lambda c: F.lpad(F.hex(c), 2, "0")), ""))


def _blocks(rows: DataFrame, by: list[str], count: int, size: int, columns: list[str]) -> DataFrame:
    """Packs rows of one kind into blocks of about ``size``, by hash."""
    n = max(1, -(-count // size))
    return rows.groupBy(*by, F.pmod(F.xxhash64("class"), F.lit(n)).alias("block")).agg(*[F.collect_list(F.struct("class", *columns)).alias("rows")])


def _meetings(found: DataFrame, grid: DataFrame, bits: int, counts: Row) -> DataFrame:
    """Where each block of queries meets each part of the file of its length: ``dim, meeting``, the queries first, then blocks of cells.

    Blocks are copied to their meetings and go there in one shuffle; nothing is joined, so nothing
    goes through the driver. A part has up to ``PART`` vectors, fewer where cores would idle.
    """
    widest = max(counts["widest"] or 1, 1)
    size = max(1, min(BLOCK, BLOCK_BYTES // widest))
    query_size = max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * widest)))
    blocks, query_blocks = -(-counts["classes"] // size) or 1, -(-counts["asked"] // query_size) or 1
    idle = -(-2 * found.sparkSession.sparkContext.defaultParallelism // query_blocks)
    parts = min(blocks, max(-(-blocks * size // PART), idle))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = found.join(F.broadcast(grid), ["dim", "band"]).select("dim", "band", "class", cell_bytes(bits).alias("cells"))
    file = _blocks(cells, ["dim", "band"], counts["classes"], size, ["cells"]).join(F.broadcast(grid), ["dim", "band"])
    file = file.withColumn("_q", copies(query_blocks)).select(
        "dim", (F.col("_q") * parts + F.col("block") % parts).alias("meeting"), F.lit(None).alias("queries"), "rows", "low", "width")
    asked = _blocks(found.where("asked"), ["dim"], counts["asked"], query_size, ["v"]).withColumn("_p", copies(parts)).select(
        "dim", (F.col("block") * parts + F.col("_p")).alias("meeting"), F.col("rows").alias("queries"), F.lit(None).alias("rows"), F.lit(None).alias("low"), F.lit(None).alias("width"))
    both = asked.unionByName(file).repartition(query_blocks * parts, "dim", "meeting")
    return both.sortWithinPartitions("dim", "meeting", F.col("queries").isNull())


def _scan(meetings: DataFrame, k: int) -> DataFrame:
    """Candidates of every meeting: query class, class and upper bound."""
    need = k + 1

    def flush(held: list[tuple[np.ndarray, ...]], asked: np.ndarray, best: np.ndarray) -> Iterator[pd.DataFrame]:
        """Those held that the best lower bounds so far leave open."""
        if held:
            i, c, up = (np.concatenate(x) for x in zip(*held, strict=True))
            at = np.flatnonzero(up >= best[i, 0])
            for start in range(0, len(at), HELD):
                x = at[start : start + HELD]
                yield pd.DataFrame({"query": asked[i[x]], "class": c[x], "upper": up[x]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, held, size = None, [], 0
        asked, best = np.empty(0, np.int64), np.empty((0, need))
        for frame in frames:
            for row in frame.itertuples(index=False):
                if here != (row.dim, row.meeting):
                    yield from flush(held, asked, best)
                    here, held, size, asked = (row.dim, row.meeting), [], 0, np.empty(0, np.int64)
                if row.queries is not None:
                    asked = np.fromiter((r["class"] for r in row.queries), np.int64, len(row.queries))
                    vectors = np.array([r["v"] for r in row.queries], np.float64)
                    best = np.full((len(asked), need), -np.inf)  # of each query, the smallest first
                    continue
                if not len(asked):  # no query of this length in the block
                    continue
                low, width = np.array(row.low, np.float64), np.array(row.width, np.float64)
                ids = np.fromiter((r["class"] for r in row.rows), np.int64, len(row.rows))
                cells = np.frombuffer(b"".join(r["cells"] for r in row.rows), np.uint8).reshape(len(ids), len(low))
                middle = low + (cells + 0.5) * width
                take = min(need, len(ids))
                for start in range(0, len(asked), STEP):
                    part = slice(start, start + STEP)
                    q = vectors[part]
                    with np.errstate(over="ignore", invalid="ignore"):  # beyond a double: no bound, read exactly
                        score = q @ middle.T
                        slack = np.abs(q) @ (width / 2)
                        # What doubles may lose in cells, middles, products and their sums.
                        slack += 1 + (4 * len(low) + 64) * EPS * (np.abs(q) @ (np.abs(low) + np.abs(middle).max(axis=0) + 256 * width))
                        up, down = score + slack[:, None], score - slack[:, None]
                    up[~np.isfinite(up)], down[~np.isfinite(down)] = np.inf, -np.inf
                    top = np.partition(down, len(ids) - take, axis=1)[:, len(ids) - take :]
                    best[part] = np.sort(np.hstack([best[part], top]), axis=1)[:, take:]
                    i, j = np.nonzero(up >= best[part, :1])
                    held.append((i + start, ids[j], up[i, j]))
                    size += len(i)
                    if size > HELD:
                        yield from flush(held, asked, best)
                        held, size = [], 0
        yield from flush(held, asked, best)

    return meetings.mapInPandas(run, "query long, class long, upper double")


def _product() -> Column:
    products = F.zip_with("q", "v", lambda a, b: a.cast("long") * b.cast("long"))
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def _digits(value: int) -> str:
    """A text that sorts as the whole number does."""
    text = f"{len(str(abs(value))):06d}{abs(value)}"
    return "1" + text if value >= 0 else "0" + "".join(str(9 - int(d)) for d in text)


@F.pandas_udf(StructType([StructField("score", LongType()), StructField("beyond", StringType())]))
def _any_product(q: pd.Series, v: pd.Series) -> pd.DataFrame:
    out = []
    for a, b in zip(q, v, strict=True):
        s = sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
        out.append((s, "") if LEAST < s < MOST else (MOST if s > 0 else LEAST, _digits(s)))
    return pd.DataFrame(out, columns=["score", "beyond"])


def _read(candidates: DataFrame, vectors: DataFrame, wide: bool) -> DataFrame:
    """Exact products of candidates; ``query`` and ``class`` name the vectors.

    ``beyond`` orders scores that are shown as the same end of the longs; it is empty for all others.
    """
    asked = vectors.where("asked").select(F.col("class").alias("query"), F.col("v").alias("q"), F.col("band").alias("_qb"))
    # Never by broadcast: as files the vectors are a tenth of what they would take in the driver.
    pairs = candidates.join(vectors.select("class", "v", "band").hint("merge"), "class").join(asked.hint("merge"), "query")
    small = (F.col("band") == 0) & (F.col("_qb") == 0)
    exact = pairs.where(small).select("query", "class", _product().alias("score"), F.lit("").alias("beyond"))
    if wide:
        rest = pairs.where(~small).select("query", "class", _any_product("q", "v").alias("_s"))
        exact = exact.unionByName(rest.select("query", "class", "_s.score", "_s.beyond"))
    return exact


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", bits: int = BITS, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows of every query row, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``.
    """
    whole = integer_vectors(vectors, vector, scale)
    found = saved(classes(whole, k, is_query), "classes")
    grid = cell_grid(found, bits)  # one row per length and magnitude
    counts = found.agg(
        F.count(F.lit(1)).alias("classes"), F.count(F.when(F.col("asked"), 1)).alias("asked"), F.max("band").alias("band"), F.max("dim").alias("widest")).first()
    wide = bool(counts["band"])
    candidates = saved(_scan(_meetings(found, grid, bits, counts), k), "candidates")

    best_bounds = Window.partitionBy("query").orderBy(F.desc("upper"), "class")
    first = candidates.withColumn("_n", F.row_number().over(best_bounds)).where(F.col("_n") <= k + 1)
    reached = _read(first, found, wide).groupBy("query").agg(F.count(F.lit(1)).alias("_read"), F.min("score").alias("_sure"))
    # A score shown as the least long may be smaller still and rules out nothing.
    bar = F.when((F.col("_read") > k) & (F.col("_sure") > LEAST), F.col("_sure"))
    open_ = candidates.join(reached, "query").where(bar.isNull() | (F.col("upper") >= bar.cast("double")))
    exact = _read(open_.select("query", "class"), found, wide)
    exact = exact.join(found.select("class", "ids").hint("merge"), "class")
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), F.col("ids")[0], "class")
    lists = exact.withColumn("_n", F.row_number().over(by_score)).where(F.col("_n") <= k + 1)

    # From classes back to rows: every query row of a class has the class's list without itself.
    members = lists.select("query", "score", "beyond", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    members = members.withColumn("_n", F.row_number().over(by_row)).where(F.col("_n") <= k + 1)
    answers = members.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("_list"))
    asks = whole.where(is_query).select("vec_id", "v").distinct().withColumn("_h", F.xxhash64("v"))
    of_class = found.where("asked").select(F.xxhash64("v").alias("_h"), "v", F.col("class").alias("query"))
    rows = asks.join(of_class.hint("merge"), ["_h", "v"]).select(F.col("vec_id").alias("query_id"), "query").join(answers, "query")
    others = F.slice(F.filter("_list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = rows.select("query_id", F.posexplode(others).alias("_at", "_x"))
    return ranked.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), "_x.vec_id", "_x.score")
