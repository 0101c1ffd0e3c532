"""Personal data that no base pattern can match is found, and failed checks are not."""

from __future__ import annotations

import random

import numpy as np

from data import frame, prose

from ledgerscope.llm import pii

PLANTED = [
    (3, "030 1234 5678"), (3, "(743) 555-3824"), (3, "0049 30 123 456 78"), (2, "378282246310005"), (2, "4222222222222"),
    (1, "2001:db8:85a3:8d3:1319:8a2e:370:7348"), (0, "jane.doe at example dot com"), (0, "jane [at] example.org"),
]
FAILED = ["378282246310006", "192.168.1.300", "1,234,567,890", "2024-01-05", "foo@bar"]


def test_planted_spans_outside_the_base_are_added(spark):
    rng = random.Random(5)
    texts = [f"{prose(rng, 30)} {value} {prose(rng, 10)}" for _ in range(60) for value in [*(v for _, v in PLANTED), *FAILED]]
    docs = frame(spark, texts)
    model = pii.fit(docs)
    wanted = [*(v for _, v in PLANTED), *FAILED]
    found = dict.fromkeys(wanted, 0)
    for text, (base, spans) in zip(texts, pii.choose(texts, model), strict=True):
        assert not base
        value = next(v for v in wanted if f" {v} " in text)
        at = text.index(f" {value} ") + 1
        kinds = {k for k, v in PLANTED if v == value}
        found[value] += any(k in kinds and s <= at and e >= at + len(value) for k, s, e in spans) if kinds else bool(spans)
    assert all(found[v] >= 54 for _, v in PLANTED) and all(found[v] <= 3 for v in FAILED), found


def test_equal_examples_count_once_and_kinds_share_the_sample(spark):
    rng = random.Random(6)
    copies = ["call +49 30 1234567 or 999.1.1.1"] * 300
    rows = pii.examples(frame(spark, [*copies, *(prose(rng, 12) for _ in range(400))]), 200).collect()
    assert len({r.pick for r in rows}) == len(rows)
    assert all(sum(r.kind == k for r in rows) == 50 for k in range(4))


def test_all_examples_are_used_to_fit(spark):
    rng = random.Random(7)
    docs = frame(spark, [prose(rng, 4) for _ in range(11_500)])
    rows = docs.selectExpr("xxhash64(text) AS row", "text").collect()
    wanted = {(kind, pick) for r in rows for kind, _, pick, _ in pii.labelled(r.text, r.row)}
    found = [(r.kind, r.pick) for r in pii.examples(docs).select("kind", "pick").collect()]
    assert len(found) > 20_000 and len(found) == len(wanted) and set(found) == wanted


def test_trees_of_the_whole_table_are_those_of_its_rows_at_once(spark):
    rng = random.Random(8)
    docs = frame(spark, [f"{prose(rng, 5)} +49 30 {rng.randrange(10**6, 10**7)} {prose(rng, 5)} 10.0.{i % 250}.7" for i in range(600)])
    model = pii.fit(docs.repartition(7))
    rows = pii.examples(docs).toPandas()
    train = rows[~rows["held"]]
    for kind, trees in model.trees.kinds.items():
        part = train[train["kind"] == kind]
        x = np.array(part["features"].tolist())
        plain = pii.boost(x, part["label"].to_numpy(float))
        assert len(trees.trees) == len(plain.trees) and abs(trees.start - plain.start) < 1e-9
        assert np.abs(trees.score(x) - plain.score(x)).mean() < 0.01
    assert set(model.trees.kinds) == {0, 1, 2, 3}
