"""Quality rules: a threshold table compiled into one Spark projection.

Every figure and every verdict is a built-in expression, so the whole rule set
runs in one narrow projection: no shuffle, no Python, no state between rows.

The share of stop words says something only of a language whose stop words are
listed, so that rule holds where the column of languages names one of these and
all other texts pass it: a language without a list is not a fault.

Equal windows of words are told by chained 64-bit hashes of the words, not by
the words: two windows of one text that differ count as equal with a chance of 2^-64.

Defined results: a null text has no words and fails; an empty text likewise; a
very long text is judged whole, with figures in longs; a figure that equals its
threshold (a tie) passes; a repeated row is judged like its first; an empty table gives
an empty one; other columns pass through untouched, and a column of the input
whose name clashes with an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

# Frequent function words by language code.
STOP_WORDS = {
    "en": "a an and are as at be but by for from had has have he her his i in is it not of on or she that the they this to was we were which will with you",
    "fr": "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour qui que sa se ses son sur un une vous",
    "de": "als am auch auf aus bei das dem den der des die ein eine einem einen einer er es für ich im ist mit nach nicht sich sie sind und von war wie wir zu zum zur",
    "es": "al como con del el ella ellos es esta este fue ha la las lo los más me no para pero por que se si sin su sus un una y",
}
FUNCTION_WORDS = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})

WINDOW = 8
#: White space between words.
SPACE = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """Fails a text of which ``per * figure`` is not within [low, high] times ``base``; None: no bound.

    With ``languages`` it holds for texts of these alone; one of an unknown language passes it.
    """

    name: str
    figure: str
    base: str | None = None
    low: int | None = None
    high: int | None = None
    per: int = 100
    languages: tuple[str, ...] | None = None


#: The thresholds, in per cent where there is a base. All are integer comparisons, so any engine agrees on them.
RULES = (
    Rule("few_words", "n_words", low=20, per=1),
    Rule("repeats", "n_repeat_words", "n_words", high=30),
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "word_chars", high=5),
    Rule("exclamations", "n_exclamations", "n_words", high=50),
    Rule("stop_words", "n_stop_words", "n_words", low=3, languages=tuple(STOP_WORDS)),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=40),
)
#: The rules of the contract's base verdict.
BASE = ("few_words", "repeats")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, even where body names it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    """Runs of characters other than U+0020 and U+0009-U+000D."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in windows of ``width`` words found twice or more in the text."""

    def starts(windows: Column) -> Column:  # of the repeated ones, in order
        ranked = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ranked,
            lambda r: F.array_sort(
                F.transform(
                    F.filter(
                        r,
                        lambda x, k: (F.get(r, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(r, k + 1)["h"].eqNullSafe(x["h"])),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, zero, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(width), p - a["last"])).alias("n")), lambda a: a["n"])

    def joined(h: Column, step: int) -> Column:  # hashes of runs of twice step words from those of step words
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    def windows(h: Column, step: int = 1) -> Column:
        return h if step == width else let(joined(h, step), lambda x: windows(x, 2 * step))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) < F.size(w), covered(starts(w))).otherwise(F.lit(0))

    assert width & (width - 1) == 0, "a window is a power of two of words"
    return let(windows(F.transform(words, lambda w: F.xxhash64(w))), count)


def figures(text: Column) -> Column:
    """A struct of all figures of a text, each a long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(words: Column, lines: Column) -> Column:
        n = {
            "n_words": F.size(words),
            "word_chars": F.length(F.regexp_replace(text, SPACE, "")),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
            "n_exclamations": F.regexp_count(text, F.lit("!")),
            "n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*FUNCTION_WORDS))),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in n.items()])

    return let(split_words(text), lambda w: let(lines, lambda x: of(w, x)))


def verdict(rule: Rule, f: Column, lang: Column | None = None) -> Column:
    """True where the rule fails."""
    if rule.languages is not None and lang is None:
        return F.lit(False)
    base = f[rule.base] if rule.base else F.lit(1)
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (rule.per * f[rule.figure] < rule.low * base)
    if rule.high is not None:
        bad = bad | (rule.per * f[rule.figure] > rule.high * base)
    if rule.languages is not None:
        bad = F.coalesce(lang.isin(*rule.languages), F.lit(False)) & bad
    return bad


NAMES = ("n_words", "word_chars", "n_symbols", "n_exclamations", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")


def judgement(text: Column, rules: tuple[Rule, ...] = RULES, lang: Column | None = None) -> Column:
    """A struct of the figures, ``base_failed``, ``failed`` (names of the failed rules) and ``kept``.

    It is one expression that computes each figure once. A filter on ``kept`` that the
    optimizer moves below the projection so copies the work once and not for each rule.
    """

    def verdicts(f: Column) -> Column:
        failed = F.array_compact(F.array(*[F.when(verdict(r, f, lang), F.lit(r.name)) for r in rules]))
        base = F.array(*[F.lit(x) for x in BASE])
        return let(
            failed,
            lambda x: F.struct(*[f[n].alias(n) for n in NAMES], F.arrays_overlap(x, base).alias("base_failed"), x.alias("failed"), (F.size(x) == 0).alias("kept")),
        )

    return let(figures(text), verdicts)


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str = "lang") -> DataFrame:
    """docs with the fields of their judgement as columns. Without a column ``lang`` no language is known."""
    found = free_name(docs.columns, "judgement")
    known = F.col(lang).cast("string") if lang.lower() in map(str.lower, docs.columns) else None
    out = docs.withColumn(found, judgement(F.col(text), rules, known))
    return out.withColumns({n: F.col(found)[n] for n in (*NAMES, "base_failed", "failed", "kept")}).drop(found)
