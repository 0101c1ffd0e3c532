"""Repeated passages and near copies against brute force, with families larger than a chunk."""

import collections
import random

import numpy as np
from data import ODD, edited, frame, packed_long, prose

from ledgerscope.llm import bitmap, jaccard, substrings


def _repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        covered = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(covered), b" ".join(x for i, x in enumerate(w) if i not in covered).decode()))
    return out


def test_cover_reaches_all_differences():
    assert substrings.covers(substrings.COVER, substrings.PERIOD)
    assert not substrings.covers((0, 1, 4), 21)


def test_substrings_as_brute_force(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 60), prose(rng, 36)
    texts = [*ODD, packed_long(rng)]
    texts += [f"{prose(rng, rng.randint(0, 80))} {passage} {prose(rng, rng.randint(0, 50))}" for _ in range(60)]
    texts += [f"{prose(rng, 10)}\n{other} {prose(rng, 5)}\t{other}", " ".join(passage.split()[:34]), " ".join(passage.split()[:35])]
    texts += ["same word " * 100, prose(rng, 200), texts[12], edited(rng, texts[12], 40)]
    docs = frame(spark, texts)
    want = _repeats(texts, 35)
    for bits in (26, 6):  # a full bitmap only costs time
        rows = substrings.remove_repeats(docs.repartition(5), 35, bits=bits).orderBy("row.doc_id").collect()
        assert [(r.n_words, r.n_removed, r.kept) for r in rows] == want
    again = substrings.remove_repeats(docs.union(docs.where("doc_id = 75")), 35).where("row.doc_id = 75").collect()
    assert len(again) == 2 and {r.n_removed for r in again} == {again[0].n_words if again[0].n_words >= 35 else 0}
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def _components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        inside = collections.Counter(j for x in s for j in holders[x] if j < i)
        for j, n in inside.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_components_as_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    base, passage = prose(rng, 120), prose(rng, 40)
    texts = [*ODD, "A b c", "a B c", packed_long(rng)]
    texts += [edited(rng, base, 45) for _ in range(150)] + [base] * 5 + [base.upper()]
    texts += [f"{passage} {prose(rng, rng.randint(3, 60))}" for _ in range(40)]
    chain = prose(rng, 200).split()
    for step in range(6):  # each links with the next only
        texts.append(" ".join(chain))
        chain = [w if i // 6 != step + 3 else w + "z" for i, w in enumerate(chain)]
    texts += [prose(rng, 100) for _ in range(20)]
    want = _components(texts)
    assert len({w[2] for w in want}) > 40
    docs = frame(spark, texts).repartition(4)
    for bits in (25, 6):
        rows = jaccard.near_duplicates(docs, 75, bits).orderBy("doc_id").collect()
        assert [(r.doc_id, r.n_shingles, r.component_id) for r in rows] == want


def test_matrix_finds_links_that_groups_miss(spark):
    rng = random.Random(2)
    base = prose(rng, 100)
    texts = [edited(rng, base, 40) for _ in range(60)]
    want = _components(texts)
    docs = frame(spark, texts)
    common = bitmap.build(jaccard.common_tokens(docs), 12)
    signed = jaccard.signatures(docs, common, 75)
    reps = jaccard.representatives(signed)
    tokens = jaccard.shared_tokens(signed, jaccard._chosen(reps, 12), 12)
    cards = jaccard.class_cards(signed, tokens, reps)
    alone = spark.createDataFrame([], "class long, root long")  # every class its own group
    open_, placed = jaccard.qualifying(cards, tokens, alone, 75, chunk=4)
    links = jaccard.matrix_links(open_, placed, jaccard.class_sets(docs, cards, reps, 12), 75)
    roots = {r["class"]: r.root for r in jaccard.components(links).collect()}
    names = {r.doc_id: r["class"] for r in signed.collect()}
    got = collections.defaultdict(set)
    for d, c in names.items():
        got[roots.get(c, c)].add(d)
    wanted = collections.defaultdict(set)
    for d, _, c in want:
        wanted[c].add(d)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, wanted.values()))


def test_empty_and_repeated_rows(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, ["a b c d e f g", None])
    rows = jaccard.near_duplicates(docs.union(docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in rows] == [(0, 3, 0), (0, 3, 0), (1, 0, 1), (1, 0, 1)]


def test_bitmap(spark):
    rng = np.random.default_rng(4)
    h = rng.integers(-(2**63), 2**63, 500, dtype=np.int64)
    built = bitmap.build(spark.createDataFrame([(int(x),) for x in h], "h long"), 20)
    assert bitmap.holds(built, h.view(np.uint64)).all()
    assert bitmap.holds(built, rng.integers(0, 2**63, 10_000, dtype=np.uint64)).mean() < 0.01


def test_windows_are_done_with_before_the_texts_are_shuffled(spark):
    docs = frame(spark, ["a b c d"] * 3)
    plan = substrings.remove_repeats(docs, 35)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
