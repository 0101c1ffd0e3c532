"""Small tables with every odd case: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, sequence_id long, spans string"


def frame(spark, texts, first=0):
    rows = [(first + i, t, "en", "src0", len(t or ""), 0.5, "k", 7, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng: random.Random, n: int, alphabet: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng: random.Random, text: str, every: int) -> str:
    return " ".join("x" + w if rng.randrange(every) == 0 else w for w in text.split(" "))


ODD = [None, "", " ", "\n\t ", "one", "two words", "a  b\tc\x0bd\x0ce\rf\ng", "Ünï çödé ﬁ 日本語 😀", "<|endoftext|> a<|endoftext|>b", "\x00\x1c\x85\xa0 x"]


def packed_long(rng: random.Random) -> str:
    return "q" * 5_000 + " " + prose(rng, 6_000) + " " + "7" * 3_000
