"""Quality rules: a table of thresholds compiled into one projection.

Everything is a built-in expression of the row's own text, so the job is a scan with
no shuffle, whatever the size. Windows of eight words are compared by 64-bit hash
inside one document only.

Nulls and odd input: a null or empty text has zero words and is kept by no rule set
that asks for a minimum. Rows are judged one by one, so ties and repeated rows each
get their own answer. Columns of the input are not carried along unless named in
``keep``; the names of the measures cannot clash then.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, let, words

WINDOW = 8

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "with", "on", "was", "by", "at", "from", "this", "an", "are",
    "le", "la", "les", "de", "des", "et", "en", "un", "une", "que", "qui", "dans", "du", "pour", "est", "il", "elle",
    "der", "die", "das", "und", "ein", "eine", "zu", "den", "von", "mit", "nicht", "im", "sich", "auf", "ist",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "una", "su", "al", "lo",
)


@dataclass(frozen=True)
class Rule:
    """A document fails when ``measure`` is below ``least`` or above ``most``."""

    measure: str
    least: float | None = None
    most: float | None = None

    def failed(self) -> Column:
        value, tests = F.col(self.measure), []
        if self.least is not None:
            tests.append(value < self.least)
        if self.most is not None:
            tests.append(value > self.most)
        return F.coalesce(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(False))


#: The default table. Ratios are per word or per line; null (no words, no lines) never fails.
RULES = (
    Rule("n_words", least=20, most=1_000_000),
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("symbols_per_word", most=0.1),
    Rule("n_stop_words", least=2),
    Rule("dup_line_share", most=0.5),
    Rule("repeat_share", most=0.3),
)


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs at least twice, from the array of window hashes."""

    def repeated(h: Column) -> Column:
        runs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(runs, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda x, j: F.when(
                F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False)), x["i"])),
            lambda p: p.isNotNull())))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda at, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - at, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda total, x: total + x))

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated(h)).otherwise(F.lit(0).cast("long")))


def _window_hashes(w: Column) -> Column:
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    return let(hashed, lambda h: F.when(
        F.size(h) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>")))


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts and ratios of every text, next to the columns named in ``keep``."""
    body = F.coalesce(F.col(text), F.lit(""))
    stop = F.array(*[F.lit(x) for x in STOP_WORDS])
    per_word = let(words(body), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _covered(_window_hashes(w)).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x: F.array_contains(stop, F.lower(x)))).cast("long").alias("n_stop_words"),
    ))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS[1:]}"))
    per_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.select(
        *keep, per_word.alias("_w"), per_line.alias("_l"),
        F.length(F.regexp_replace(body, f"{SPACE_CLASS}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    flat = counted.select(*keep, "_w.*", "_l.*", "word_chars", "n_symbols")
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    return flat.select(
        "*", share("word_chars", "n_words").alias("mean_word_chars"), share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"))


def judge(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``failed_rules`` (names, in table order) and ``passed``."""
    failed = F.filter(F.array(*[F.when(r.failed(), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull())
    return measured.withColumn("failed_rules", failed).withColumn("passed", F.size("failed_rules") == 0)


def quality_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict of every document."""
    return judge(measures(docs, text, keep), rules)
