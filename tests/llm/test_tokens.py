"""Encoding, decoding, counting and packing against the libraries and plain versions."""

import hashlib
import random
import struct
import zlib

import pytest
from data import ODD, edited, frame, packed_long, prose
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from ledgerscope.llm import bpe, packing, token_counts  # noqa: E402
from ledgerscope.llm.queries import BYTE_BPE, PIECE_BPE  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(BYTE_BPE))
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = prose(rng, 300)
    return [*ODD, packed_long(rng), base, base, *(edited(rng, base, 9) for _ in range(20)), "don't we'll  I'm\r\n\n 's", " " * 50 + "x"]


def test_encode_and_decode_as_the_library(spark, library, texts):
    path = P.path(BYTE_BPE)
    rows = bpe.decode(bpe.encode(frame(spark, texts), path), path).orderBy("doc_id").collect()
    assert len(rows) == len(texts)
    for r, t in zip(rows, texts, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids))) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(frame(spark, []), path).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(frame(spark, texts), path, ids="kept")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab 's\n\t1é.<|>日　\x1c", max_size=60))
def test_encoder_on_any_text(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(P.path(BYTE_BPE)) if not hasattr(test_encoder_on_any_text, "t") else test_encoder_on_any_text.t
    test_encoder_on_any_text.t = want
    got = bpe.encoder(P.path(BYTE_BPE)).encode([text])[0]
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want.encode(text, add_special_tokens=False).ids


def test_counts_are_spliced_right(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path(PIECE_BPE))
    texts = [*texts, "a  b   c " * 400, "日本語" * 500, "x" * 4_000 + " y " * 300, "▁a▁ b " * 200, "<s> </s> <unk> " * 80]
    for chunk, overlap in ((50_000, 500), (200, 20)):
        rows = token_counts.token_counts(frame(spark, texts), P.path(PIECE_BPE), chunk=chunk, overlap=overlap, limit=100).orderBy("doc_id").collect()
        for r, t in zip(rows, texts, strict=True):
            assert (r.n_bytes, r.n_tokens) == (len((t or "").encode()), len(model.encode(t or "")))
            assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.token_counts(frame(spark, []), P.path(PIECE_BPE)).count() == 0


def test_packing_is_whole_and_gapless(spark, library, texts):
    docs = frame(spark, [*texts, *texts[:3]])
    docs = docs.union(docs.where("doc_id = 11"))  # a repeated row
    rows = packing.best_fit_packing(docs, P.path(BYTE_BPE), capacity=512).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    all_texts = [*texts, *texts[:3]]
    assert set(by_doc) == set(range(len(all_texts)))
    for d, pieces in by_doc.items():
        ids = library.encode(all_texts[d] or "", add_special_tokens=False).ids + [0]
        copies = 2 if d == 11 else 1
        cut = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in pieces})
        assert len(pieces) == copies * len(cut)
        assert [c[0] for c in cut] == list(range(len(cut))) and sum(c[2] for c in cut) == len(ids)
        for _, start, length, crc in cut:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
        assert all(c[2] == 512 for c in cut[1:])
    for held in by_sequence.values():
        place = 0
        for offset, length in sorted(held):
            assert offset == place
            place += length
        assert place <= 512
    assert packing.best_fit_packing(frame(spark, []), P.path(BYTE_BPE)).count() == 0


def test_evolution_keeps_pieces_and_never_gets_worse():
    rng = random.Random(8)
    for n in (0, 1, 40, 300):
        sizes = [rng.randint(300, 1_100) for _ in range(n)]
        plain = packing.Packer(sizes, 2048).best_fit([], sorted(range(n), key=lambda i: -sizes[i]))
        found = packing.evolve(sizes, [], random.Random(1), 2048, 10, 4)[0]
        assert sorted(i for b in found for i in b) == list(range(n))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in found)
        assert -(-sum(sizes) // 2048) <= len(found) <= len(plain)


def test_sha_of_query_columns(spark, sf_dir, library):
    from ledgerscope.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_bpe_encode_decode"](spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def _sequences(spark, sizes, **more):
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    packed = packing.pack(rows, "length", 2048, **more).collect()
    assert sorted((r.doc_id, r.length) for r in packed) == list(enumerate(sizes))
    held = {}
    for r in packed:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(held)


def test_pools_meet_until_no_packing_is_better(spark):
    """Short documents fill all sequences but one, however many pools they were dealt into."""
    assert _sequences(spark, [10] * 4_000, pool=300) == -(-40_000 // 2048)
    assert _sequences(spark, [1] * 6_000, pool=50) == -(-6_000 // 2048)
    rng = random.Random(12)
    mixed = [rng.randint(20, 900) for _ in range(2_000)]
    assert _sequences(spark, mixed, pool=400) <= 1.01 * (-(-sum(mixed) // 2048))
    middle = [rng.randint(700, 1_024) for _ in range(600)]  # two a sequence at most
    assert _sequences(spark, middle, pool=150) == 300


def test_evolution_beats_longest_first():
    """First packings are random; crossover and displacement bring them to or below best-fit decreasing."""
    rng = random.Random(13)
    fewer = 0
    for _ in range(6):
        sizes = [rng.randint(300, 1_100) for _ in range(300)]
        plain = packing.Packer(sizes, 2048).best_fit([], sorted(range(300), key=lambda i: -sizes[i]))
        start = packing.evolve(sizes, [], random.Random(2), 2048, 0, 4)[0]
        found = packing.evolve(sizes, [], random.Random(2), 2048, 20, 4)[0]
        assert len(found) <= len(plain) and len(found) < len(start)
        fewer += len(found) < len(plain)
    assert fewer
