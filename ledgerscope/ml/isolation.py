"""Anomaly channel: isolation trees over legitimate payments.

Isolation Forest (Liu, Ting and Zhou, 2008). Spark samples the rows of every tree
by hash and groups them by tree; a task grows one tree from its few thousand
rows. The grown trees are small by construction (at most ``2 * max_samples``
nodes each), so they can be broadcast for scoring.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 1 << 16  # equal steps of the anomaly score in which the reference is counted
_NODE = "tree INT, node INT, feature INT, cut DOUBLE, low INT, high INT, size DOUBLE, depth INT"


def average_path(n):
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2.0)
    c = 2.0 * (np.log(big - 1.0) + 0.5772156649) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def grow(tree: int, x: np.ndarray, max_depth: int, seed: int) -> pd.DataFrame:
    """Splits on a random feature at a random cut until rows stand alone."""
    rng = np.random.default_rng([seed, tree])
    nodes, stack = [], [(0, np.arange(len(x)), 0)]
    count = 1
    while stack:
        node, rows, depth = stack.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 and depth < max_depth else []
        if len(spread) == 0:
            nodes.append((tree, node, -1, 0.0, -1, -1, float(len(rows)), depth))
            continue
        f = int(rng.choice(spread))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        below = part[:, f] < cut
        if below.all() or not below.any():
            below = part[:, f] <= part[:, f].min()
        low, high = count, count + 1
        count += 2
        nodes.append((tree, node, f, cut, low, high, float(len(rows)), depth))
        stack += [(low, rows[below], depth + 1), (high, rows[~below], depth + 1)]
    cols = ["tree", "node", "feature", "cut", "low", "high", "size", "depth"]
    return pd.DataFrame(nodes, columns=cols).sort_values("node")


@dataclass
class IsolationModel:
    features: list[str]
    medians: dict[str, float]
    trees: list[dict[str, np.ndarray]]
    sample_size: int
    reference: np.ndarray  # rows below each step, and all rows at the end

    def vector(self) -> Column:
        """Feature array with medians in place of missing values."""
        return F.array(*[
            F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(self.medians[c])).cast("double")
            for c in self.features])

    def _score_udf(self, spark, percentile: bool):
        shared = spark.sparkContext.broadcast((self.trees, self.sample_size, self.reference))

        @F.pandas_udf("double")
        def score(v: pd.Series) -> pd.Series:
            trees, size, ref = shared.value
            if len(v) == 0:
                return pd.Series([], dtype=float)
            s = anomaly(np.vstack(v.to_numpy()), trees, size)
            return pd.Series(ref[np.clip(s * STEPS, 0, STEPS - 1).astype(int)] / max(1, ref[-1]) if percentile else s)

        return score

    def transform(self, df: DataFrame, percentile: bool = True, name: str = "novelty") -> DataFrame:
        """Adds the share of reference payments less anomalous than each row, by at least a step of the score."""
        return df.withColumn(name, self._score_udf(df.sparkSession, percentile)(self.vector()))


def anomaly(x: np.ndarray, trees: list[dict[str, np.ndarray]], size: int) -> np.ndarray:
    depth = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        while len(rows):
            f = t["feature"][at[rows]]
            rows = rows[f >= 0]
            if not len(rows):
                break
            here = at[rows]
            below = x[rows, t["feature"][here]] < t["cut"][here]
            at[rows] = np.where(below, t["low"][here], t["high"][here])
        depth += t["depth"][at] + average_path(t["size"][at])
    return np.power(2.0, -depth / len(trees) / max(float(average_path(size)), 1e-9))


def fit_isolation(
    legit: DataFrame, features: list[str], medians: dict[str, float], trees: int = 180, max_samples: int = 4096,
    seed: int = 13, tie: str = "txn_id",
) -> IsolationModel:
    """Grows every tree on its own ``max_samples`` rows (the method's parameter), drawn by hash from all rows.

    The reference distribution of the percentile counts all rows, in ``STEPS``
    equal steps of the score, so what comes to the driver has a fixed size.
    """
    spark = legit.sparkSession
    model = IsolationModel(features, medians, [], max_samples, np.zeros(STEPS + 1))
    rows = legit.select(tie, model.vector().alias("v"))
    n = rows.count()
    size = min(max_samples, n)
    share = size / max(1, n)
    picks = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.col(tie), t, F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40)))
    depth = max(1, math.ceil(math.log2(max(2, size))))

    def one_tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return grow(int(key[0]), np.vstack(pdf["v"].to_numpy()), depth, seed)

    grown = (
        rows.select(F.explode(picks).alias("tree"), "v").groupBy("tree").applyInPandas(one_tree, _NODE).toPandas()
    )
    model.sample_size = size
    model.trees = [
        {c: g[c].to_numpy() for c in ("feature", "cut", "low", "high", "size", "depth")}
        for _, g in grown.sort_values(["tree", "node"]).groupby("tree")]
    step = F.least(F.floor(F.col("__s") * STEPS), F.lit(STEPS - 1)).cast("int")
    counted = model.transform(legit.select(tie, *features), percentile=False, name="__s").groupBy(step.alias("step")).count().toPandas()
    sizes = np.zeros(STEPS)
    sizes[counted["step"].to_numpy(int)] = counted["count"].to_numpy()
    model.reference = np.append(0, np.cumsum(sizes))
    return model
