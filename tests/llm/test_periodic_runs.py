"""Periodic runs against trying every period at every place, and the query against the plain contract."""

import hashlib
import random
import zlib

import numpy as np
from data import ODD, frame, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerscope.llm import periodic_runs, queries


def plain_runs(words: list) -> list[tuple[int, int, int]]:
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q):
                part = words[s : e + q]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((s, e + q - s, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = [w for w in (text or "").encode().split() if w]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha(listed.encode()), sha(kept))


pieces = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8), st.integers(0, 8))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(pieces, max_size=5), max_size=5))
def test_runs_of_several_documents(built):
    documents = [[w for unit, times, less in doc for w in (unit * times)[: max(0, len(unit) * times - less)]] for doc in built]
    documents += documents[:1]  # a copy shares its symbols
    found = periodic_runs.runs_of([np.array(d, np.int64) for d in documents])
    assert [[tuple(r) for r in f.tolist()] for f in found] == [plain_runs(d) for d in documents]


def test_long_runs_of_large_and_small_periods():
    rng = random.Random(3)
    unit = [rng.randrange(40) for _ in range(611)]
    words = [rng.randrange(40) for _ in range(999)] + unit * 5 + [1, 2] * 2000 + [7] * 3000 + unit[:600]
    found = periodic_runs.runs_of([np.array(words, np.int64)])[0]
    assert [tuple(r) for r in found.tolist()] == plain_runs(words)


def test_grammar_derives_its_documents():
    rng = random.Random(4)
    words = np.array([rng.randrange(5) for _ in range(500)], np.int64)
    g = periodic_runs.Grammar(words, np.repeat([0, 1], 250))

    def derived(symbol):
        rule = symbol - g.n_words
        return [symbol] if rule < 0 else derived(g.left[rule]) + derived(g.right[rule])

    assert [w for root in g.roots.tolist() for w in derived(root)] == words.tolist()
    assert len(g.left) < 499


def test_query_rows_equal_the_contract(spark, tmp_path):
    rng = random.Random(5)
    texts = [*ODD, "a " * 7, "x y " * 9, "la la la la la la\nla", prose(rng, 300), prose(rng, 2000, "ab")]
    texts += [" ".join(rng.choice(["na", "no"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    df = frame(spark, texts)
    df = df.union(df.limit(20)).union(spark.sql("SELECT CAST(NULL AS BIGINT), 'b b b b b b b', '', '', 0L, 0D, '', 0L, ''"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([plain_row(r.doc_id, r.text) for r in df.collect()], key=str)
    assert sum(r[1] > 0 for r in got) > 20
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_clashing_columns_travel(spark):
    df = spark.createDataFrame([(1, "a a a a a a", "r", 5)], "doc_id long, text string, row string, runs int")
    out = periodic_runs.find_runs(df).first()
    assert out.row.row == "r" and out.row.runs == 5 and [tuple(r) for r in out.runs] == [(0, 6, 1)] and out.collapsed == "a"
