"""NN-descent against comparing all pairs."""

import numpy as np

from ledgerscope.llm import nn_descent, queries


def plain(ids, vectors, threshold):
    """(id, n_links, component, kept) by all pairs."""
    n, unit = len(ids), []
    for v in vectors:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / np.abs(np.array(v, float)).max() if ok else None
        unit.append(x / np.sqrt(x @ x) if ok else None)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            a, b = unit[i], unit[j]
            if ids[i] is not None and ids[j] is not None and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        reach, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - reach:
                reach.add(j)
                stack.append(j)
        least = min(ids[j] for j in reach) if ids[i] is not None else None
        out.append((ids[i], len(links[i]), least, ids[i] == least))
    return sorted(out, key=str)


SCHEMA = "vec_id long, embedding array<double>, label int, id long, h1 string, root int, kept string"


def frame(spark, ids, vectors):
    rows = [(i, v, 1, 5, "x", 2, "k") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def made(rng, dim=24):
    vectors = [rng.normal(size=dim) for _ in range(250)]
    for size in (2, 2, 3, 7, 60, 150):  # families of near copies
        base = rng.normal(size=dim)
        vectors += [base + rng.normal(size=dim) * rng.uniform(0, 0.25) for _ in range(size)]
    chain = rng.normal(size=dim)
    for _ in range(20):  # each links with the next
        chain = chain + rng.normal(size=dim) * 0.2
        vectors.append(chain)
    vectors = [v.tolist() for v in vectors]
    vectors += vectors[:5] * 2 + [vectors[300]] * 30 + [[2 * x for x in vectors[7]]]
    return vectors + [None, [], [0.0] * dim, [-0.0] * dim, [float("nan"), *[1.0] * (dim - 1)], [None, *[1.0] * (dim - 1)], [float("inf"), *[1.0] * (dim - 1)],
                      [1e200] * dim, [1e-200] * dim, [1.0] * dim, [1.0], [2.0], [-1.0], [1.0, 0.0], [0.99, 0.1]]


def rows(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_links_and_components_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = made(rng)
    ids = [int(i) for i in rng.permutation(5000)[: len(vectors)]]
    ids[3] = None
    ids[-20] = ids[-21]  # one id for two vectors
    got = rows(nn_descent.near_duplicates(frame(spark, ids, vectors), 0.95))
    assert got == plain(ids, vectors, 0.95)


def test_cells_of_few_vectors_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = [rng.normal(size=12) for _ in range(2)]
    vectors = [(base[i % 2] + rng.normal(size=12) * rng.choice([0.01, 0.2])).tolist() for i in range(160)]
    rows_ = frame(spark, range(160), vectors)
    unit = nn_descent.unit_vectors(rows_).select("id", nn_descent.F.lit(0).cast("long").alias("root"), nn_descent.F.lit(1).cast("long").alias("copies"), "unit")
    found = nn_descent.cells(nn_descent._with_codes(unit), size=8).cache()
    assert found.count() > 10
    links = nn_descent.cell_links(found, 0.95)
    counts = dict(map(tuple, links.groupBy("id").agg(nn_descent.F.sum("n")).collect()))
    want = plain(list(range(160)), vectors, 0.95)
    assert {i: counts[i] - 1 for i in range(160)} == {i: n for i, n, _, _ in want}


def test_empty_table_and_audit(spark, tmp_path):
    frame(spark, [], []).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.op11_nn_descent(spark, str(tmp_path)).count() == 0
    rng = np.random.default_rng(3)
    x = rng.normal(size=16)
    units = [x / np.sqrt(x @ x)] * 3
    classes = spark.createDataFrame([(i, 1, u.tobytes()) for i, u in enumerate(units)], "id long, copies long, unit binary")
    counts = spark.createDataFrame([(0, 2), (1, 2)], "id long, n long")
    assert nn_descent.audit(classes, counts, 0.95) == 2 / 6


def test_spanning_pairs():
    link = np.zeros((6, 6), bool)
    for i, j in [(0, 1), (1, 2), (0, 2), (3, 4)]:
        link[i, j] = link[j, i] = True
    i, j = nn_descent._spanning(link)
    assert len(i) == 3
    known = np.array([True, True, False, True, False, False])
    i, j = nn_descent._spanning(link, known)
    assert sorted(map(sorted, zip(i.tolist(), j.tolist()))) in ([[0, 2], [3, 4]], [[1, 2], [3, 4]])
