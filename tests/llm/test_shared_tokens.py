"""A token of very many classes is not gathered in one window."""

from __future__ import annotations

from ledgerscope.llm import jaccard


def test_shared_tokens_without_a_window(spark):
    held = [(c, [7, 100 + c, 500 + c % 3]) for c in range(60)] + [(200, [9]), (200, [9]), (201, None)]
    rows = [(i, c, t) for i, (c, t) in enumerate(held)] + [(5, 5, held[5][1]), (None, 300, [7, 9]), (400, 5, held[5][1])]
    held += [(300, [7, 9])]
    signed = spark.createDataFrame(rows, "doc_id long, class long, tokens array<long>")
    got = jaccard.shared_tokens(signed, jaccard._chosen(jaccard.representatives(signed), 12), 12)
    classes = {}
    for c, tokens in held:
        for h in tokens or []:
            classes.setdefault(h, set()).add(c)
    want = sorted((h, c) for h, cs in classes.items() if len(cs) > 1 for c in cs)
    assert sorted(map(tuple, got.collect())) == want
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
