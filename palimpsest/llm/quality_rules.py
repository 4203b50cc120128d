"""Quality rules: a table of thresholds compiled into one projection.

Counts are taken from each text inside the projection: no shuffle, no user function. Words are runs
of anything but ASCII white space; a NULL text has none. A ratio is compared in whole numbers, as
``100 * part`` against ``percent * whole``, so that no rounding decides.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
SYMBOLS = "#*$%&|<>"
BULLET = f"^[{BLANK}]*[-*•]"
ELLIPSIS = f"(\\.\\.\\.|…)[{BLANK}]*$"

# Frequent words of the languages of the corpus.
STOP_WORDS = (
    "the of and to in is it that was for on are as with be at by this from or an "
    "le la les de des et que qui dans un une pour est sur par en du "
    "der die das und ist nicht ein eine zu mit von den auf für sich "
    "el los las y del se por con para una su al lo como más"
).split()


class Rule(NamedTuple):
    """``percent_low <= 100 * part / whole <= percent_high``; a bound may be missing."""

    name: str
    part: str
    whole: str
    percent_low: int | None
    percent_high: int | None


# A document with few words or many repeated ones fails before any of these is asked.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("letter_words", "n_letter_words", "n_words", 60, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 50),
)
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are sorted, which brings equal ones side by side, and the first positions of those
    with an equal neighbour are sorted again: each covers the words up to the next, three at most.
    """
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.arrays_zip(
        F.slice(words, F.lit(1), n).alias("a"),
        F.slice(words, F.lit(2), n).alias("b"),
        F.slice(words, F.lit(3), n).alias("c"),
        F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1))), F.lit(1), n).alias("p"),
    )

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def twins(ordered: Column) -> Column:
        return F.filter(
            ordered, lambda x, i: F.coalesce(same(x, F.get(ordered, i + 1)), F.lit(False))
            | F.coalesce(same(x, F.get(ordered, i - 1)), F.lit(False))
        )

    def covered(starts: Column) -> Column:
        widths = F.transform(starts, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda total, w: total + w)

    repeated = _let(F.sort_array(windows), twins)
    return _let(F.sort_array(F.transform(repeated, lambda x: x["p"])), covered)


def _counts(text: Column) -> Column:
    """All counts of a text as one struct."""

    def of(text: Column, words: Column, lines: Column) -> list[Column]:
        return [
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            F.size(F.filter(lines, lambda x: x.rlike(BULLET))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(ELLIPSIS))).cast("long").alias("n_ellipsis_lines"),
        ]

    whole = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    words = F.regexp_extract_all(whole, F.lit(WORD), F.lit(0))
    parts = F.struct(whole.alias("text"), words.alias("words"), lines.alias("lines"))
    return _let(parts, lambda x: F.struct(*of(x["text"], x["words"], x["lines"])))


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and the counts that the rules compare, one row per row of ``docs``."""
    ids = docs[doc_id].cast("long").alias("doc_id")
    return docs.select(ids, _counts(docs[text]).alias("found")).select("doc_id", "found.*")


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    )


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one condition."""
    verdict = F.lit(True)
    for rule in rules:
        part, whole = 100 * F.col(rule.part), F.col(rule.whole)
        if rule.percent_low is not None:
            verdict &= part >= rule.percent_low * whole
        if rule.percent_high is not None:
            verdict &= part <= rule.percent_high * whole
    return verdict


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts with ``base_failed`` and ``kept``. Empty texts and NULLs fail, repeated rows each count."""
    failed = base_failed()
    return measure(docs, doc_id, text).withColumns({"base_failed": failed, "kept": ~failed & passes(rules)})


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with all their columns."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    measured = docs.select(row, _counts(docs[text]).alias("found")).select("row", "found.*")
    return measured.where(~base_failed() & passes(rules)).select("row.*")
