"""Quality rules, shards, personal data, toxicity and vector search against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from data import ODD, frame, packed_long, prose

from ledgerscope.llm import hilbert, pii, quality_rules, toxicity, vafile
from ledgerscope.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _measures(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_rules(spark):
    rng = random.Random(1)
    line = prose(rng, 9)
    texts = [*ODD, packed_long(rng), "a b c d e f g h " * 30, f"{line}\n{line}\n\n \n{line} x\n{line}", "#*$ " * 40, prose(rng, 40), "the of and to " * 2 + prose(rng, 60)]
    docs = frame(spark, texts)
    rows = quality_rules.quality_rules(docs).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [_measures(t) for t in texts]
    assert rows[-1].passed and not rows[0].passed and "symbols_per_word" in rows[-3].failed_rules
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0
    own = quality_rules.quality_rules(docs, rules=(quality_rules.Rule("n_words", most=1),))
    assert own.where("passed").count() == sum(_measures(t)[0] <= 1 for t in texts)


def test_clean_documents_are_kept(spark, sf_dir):
    judged = QUERIES["op6_quality_rules"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = judged.where("quality = 1 AND NOT base_failed")
    assert good.where("kept").count() >= 0.95 * good.count()


def test_curve_visits_neighbours(spark):
    from pyspark.sql import functions as F

    for dims, bits in ((2, 3), (3, 2)):
        cells = spark.range(1 << (dims * bits)).select(*[F.shiftright("id", k * bits).bitwiseAND((1 << bits) - 1).alias(f"x{k}") for k in range(dims)])
        rows = cells.select("*", hilbert.curve_index([F.col(f"x{k}") for k in range(dims)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (dims * bits)))
        assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("n", [0, 1, 7, 8, 61])
def test_shards_differ_by_one_row(spark, n, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE_ROWS", 5)
    texts = ([*ODD, "hot copy"] + ["hot copy"] * 50)[:n]
    docs = frame(spark, texts)
    if n == 61:
        docs = docs.unionByName(docs.where("doc_id = 3"))
    rows = hilbert.shard_documents(docs, 8).collect()
    total = docs.count()
    assert len(rows) == total
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    if total >= 8:
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and set(slots) == set(range(8))


def test_sources_with_a_common_prefix_are_told_apart(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i}", f"https://site{i % 8}.example/feed", None if i % 40 == 0 else "en") for i in range(800)],
        "doc_id long, text string, source string, lang string")
    rows = hilbert.shard_documents(docs, 8).collect()
    shards = collections.defaultdict(set)
    for r in rows:
        shards[r.doc_id % 8].add(r.shard)
    assert len({r.curve for r in rows}) > 8
    # A reader of one source opens two or three of the eight files.
    assert max(map(len, shards.values())) <= 3


def test_equal_texts_stay_together(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "SLICE_ROWS", 4)
    rng = random.Random(14)
    rows = [(None if i % 50 == 0 else i, "everywhere" if i % 3 == 0 else f"text {rng.randint(0, 60)}", f"s{i % 7}", "en", "clash") for i in range(400)]
    rows += [(1_000 + i, None, None, None, "clash") for i in range(30)] + [(2_000, "long " * 20_000, "s1", "de", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, curve string")
    cut = hilbert.shard_documents(docs, 8).collect()
    assert len(cut) == len(rows)
    at = {(r.shard, r.slot) for r in cut}
    sizes = collections.Counter(r.shard for r in cut)
    assert len(at) == len(rows) and max(sizes.values()) - min(sizes.values()) <= 1
    starts = [sum(sizes[t] for t in range(s)) for s in range(8)]
    places = collections.defaultdict(list)
    for r in cut:
        places[(r.size, r.text_crc32)].append(starts[r.shard] + r.slot)
    assert sorted(len(p) for p in places.values()) == sorted(collections.Counter(r[1] for r in rows).values())
    for p in places.values():
        assert max(p) - min(p) == len(p) - 1  # one after the other


_PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = []
    for kind, pattern in enumerate(_PATTERNS):
        for m in re.finditer(pattern, text):
            d = digits(m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (16 <= len(d) <= 19 and pii.luhn(d)) or kind == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_personal_data(spark):
    rng = random.Random(6)
    texts = [*[t or "" for t in ODD], *("".join(rng.choice("a1.@ +-()b9é") for _ in range(rng.randint(1, 60))) for _ in range(3_000))]
    texts += ["".join(rng.choice("0123456789 -.") for _ in range(rng.randint(15, 45))) for _ in range(1_000)]
    texts += ["call +1 (988) 555-2485 or x.y@a.b.c, 4929178580871 4539578763621486 10.0.0.255 10.0.0.256 é 1.2.3.4.5.6.7.8"]
    assert [pii.base_spans(t) for t in texts] == [_base(t) for t in texts]
    for long in ("1" * 100_000, "a" * 100_000, "@" * 50_000 + "a." * 50_000, "1." * 50_000, "+1 " * 30_000):
        pii.candidates(long)  # in linear time
    docs = frame(spark, [*ODD, texts[-1]])
    rows = pii.find(docs, pii.fit(docs)).orderBy("doc_id").collect()
    assert [[(pii.KINDS.index(s.kind), s.start, s.end) for s in r.base] for r in rows] == [_base(t or "") for t in [*ODD, texts[-1]]]
    clean = {r.doc_id: r for r in pii.redact(docs, pii.fit(docs)).collect()}
    assert clean[0].text is None and clean[5].text == ODD[5] and clean[0].spans == "s"
    assert clean[10].text.startswith("call [PHONE] or [EMAIL], ") and "[IP]" in clean[10].text
    assert pii.find(frame(spark, []), pii.fit(frame(spark, []))).count() == 0


def test_boosting_adds_spans_that_look_right(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    model = pii.boost(x, y)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    never = pii.Model(model, (2.0,) * 4)
    assert pii.choose(["mail a@b.c now"], pii.Model(pii.Boosted(), (2.0,) * 4)) == [([(0, 5, 10)], [(0, 5, 10)])]
    assert never.thresholds[0] > 1


def test_toxicity_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = QUERIES["op10_toxicity_ftrl"](spark, sf_dir)
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic = rows["toxic"].to_numpy() == 1
    rank = rows["score"].rank().to_numpy()
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert (rows["predicted"].to_numpy()[~toxic] == 0).mean() > 0.98
    assert rows["score"].between(0, 1).all()
    assert (scored.where("held_out").select("doc_id").toPandas()["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % 5) == 0).all()


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity(docs, docs, none).collect()} == {0.0}
    some = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, None), (3, 0, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, docs, some).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(frame(spark, []), docs, some).count() == 0


def _nearest(vectors, every, k):
    usable = {}
    for i, v in vectors:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v):
            usable.setdefault(i, [int(np.floor(256 * float(np.float32(c)))) for c in v])
    out = []
    for q, v in usable.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in usable.items() if i != q and len(w) == len(v))
            out += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_vectors_as_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(size=12).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(40)] + [(2000 + i, vectors[0][1] if i % 2 else vectors[1][1]) for i in range(20)]
    vectors += [(3000, None), (3010, []), (3020, [None] * 12), (3030, [float("nan")] * 12), (3040, [float("inf")] * 12), (None, vectors[1][1])]
    vectors += [(4000, [1.0, 2.0]), (4010, [3.0, 1.0]), (4020, [3.0, 1.0]), (5000, [0.0] * 12), (5010, [1e30] * 12)]
    vectors += [(5020, [1e6] + [0.0] * 11), (5021, [2e6, 1.0] + [0.0] * 10), (5022, [3e6] + [0.0] * 11), (5023, [-1e30] * 12), (5024, [-3e30] + [1e25] * 11)]
    vectors += [(5030, [1e6, 0.0]), (5031, [2e6, 1.0]), (5032, [3e6, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors], "vec_id long, embedding array<float>, rank int")
    got = vafile.top_k(df, df["vec_id"] % 10 == 0, 5)
    assert sorted(map(tuple, got.collect())) == _nearest(vectors, 10, 5)
    assert vafile.top_k(df.limit(0), df["vec_id"] % 10 == 0, 5).count() == 0
