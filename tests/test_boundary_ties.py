"""One instant with most rows: its ids are narrowed before anything is sorted for the driver."""

from __future__ import annotations

import random

import pytest

from ledgerscope.operators import ranks


@pytest.mark.parametrize("text_ids", [False, True])
def test_an_instant_of_many_rows_is_narrowed_by_id(spark, monkeypatch, text_ids):
    monkeypatch.setattr(ranks, "_SORTED", 20)
    monkeypatch.setattr(ranks, "_SPLITS", 4)
    rng = random.Random(8)
    ids = [*range(-200, 300), *[7] * 200]  # one id in 201 rows, too
    rows = [(f"é{i + 500:04d}" if text_ids else i * 10**15, 5) for i in ids] + [(None, 5)] * 30
    rows += [("a" if text_ids else 1, t) for t in (1, 2, 9, 9)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"txn_id {'STRING' if text_ids else 'LONG'}, ts_us LONG")
    skipped = []
    plain = type(df).offset
    monkeypatch.setattr(type(df), "offset", lambda self, n: skipped.append(n) or plain(self, n))
    ordered = sorted(((t, i) for i, t in rows), key=lambda r: (r[0], r[1] is not None, r[1] or ("" if text_ids else 0)))
    at = [10, 300, 520]
    assert ranks.boundaries(df, at) == [ordered[p] for p in at]
    assert max(skipped) < 20
