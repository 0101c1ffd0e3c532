"""The vectors of the top-k search meet in blocks of any size and never go through the driver."""

import re

import numpy as np

from ledgerscope.llm import vafile


def _rows(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6 if i % 9 else 3).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, [1e30] * 6), (2001, [1e6, 0.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_blocks_of_any_size_give_the_same_lists(spark, monkeypatch):
    df = _rows(spark)
    want = sorted(map(tuple, vafile.top_k(df, df["vec_id"] % 4 == 0, 3).collect()))
    assert len(want) == 3 * 36
    for name, value in {"BLOCK": 8, "QUERY_BLOCK": 7, "PART": 16, "STEP": 3, "HELD": 10}.items():
        monkeypatch.setattr(vafile, name, value)
    assert sorted(map(tuple, vafile.top_k(df, df["vec_id"] % 4 == 0, 3).collect())) == want


def test_vectors_are_not_broadcast(spark, monkeypatch):
    """Files of vectors look small enough to broadcast long before they are."""
    plans, saved = [], vafile.saved

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df, name)

    monkeypatch.setattr(vafile, "saved", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        df = _rows(spark)
        plans.append(vafile.top_k(df, df["vec_id"] % 4 == 0, 3)._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    _, scan, lists = plans
    keys = {re.sub(r"#\d+L?", "", x) for x in re.findall(r"BroadcastHashJoin \[([^\]]*)\]", scan)}
    assert keys == {"dim, band"}  # the grid: one row per length and magnitude
    assert not re.search(r"BroadcastHashJoin \[(class|_h)#", lists)
