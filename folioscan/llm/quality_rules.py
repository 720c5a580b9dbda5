"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every statistic is an expression over the whole text; nothing shuffles, nothing is a user function.

Defined results. Null text: as the empty text (0 words, base_failed, not kept). Empty text: the same. Repeated rows
and ties: each row is judged by itself. Texts of any length are judged whole, none is too long. Extra columns: ignored by `rule_report`, kept by `apply_rules`. Words are
maximal runs of characters other than space and U+0009-U+000D; three-word windows are compared by a 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import carry, let, pick, unload

WORD_SPACE = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: Frequent function words of the four languages, in natural order.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "that", "is", "was", "for", "with", "as", "on", "be", "at", "by", "this", "from", "or", "are", "it"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "sur", "par", "est", "au"],
    "de": ["der", "die", "das", "und", "ist", "von", "den", "mit", "sich", "nicht", "auf", "für", "ein", "eine", "dem", "zu", "es"],
    "es": ["el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "por", "con", "para", "se", "del", "no", "al"],
}


@dataclass(frozen=True)
class Rule:
    """kept needs low <= numerator / denominator <= high (None: no bound). A denominator of 0 counts as 1."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None = None
    high: float | None = None


#: The threshold table. Numerators and denominators name statistics of `statistics`.
RULES = (
    Rule("words", "n_words", None, low=50),
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=14),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.1),
    Rule("shouts_per_word", "n_shouts", "n_words", high=0.3),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)


def _words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\x09-\\x0D]+"))


def _dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _covered(starts: Column) -> Column:
    """Words covered by three-word windows at these ascending starts."""
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(F.size(starts) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur at least twice.

    Windows are hashed; only a text with an equal pair sorts (hash, position) pairs and marks equal neighbours, so
    the work is n log n in the worst case and linear in the common one.
    """
    grams = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(F.slice(h, 1, F.size(h) - 2), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    )

    def marked(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.sort_array(
                F.transform(F.filter(p, lambda x, i: (x["h"] == F.get(p, i + 1)["h"]) | (x["h"] == F.get(p, i - 1)["h"])), lambda x: x["i"]),
            ),
        )

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(let(marked(g), _covered)))


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text."""
    whole = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})

    def of_lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != "")

    def of_words(t: Column) -> Column:
        return let(
            _words(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                _repeat_words(w).alias("n_repeat_words"),
                F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(
        whole,
        lambda t: F.struct(
            of_words(t).alias("w"),
            F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
            let(of_lines(t), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), _dup_lines(x).alias("n_dup_lines"))).alias("l"),
        ),
    )


def compile_rules(stats: dict[str, Column], rules=RULES) -> Column:
    """The table as one boolean expression."""
    verdict = F.lit(True)
    for r in rules:
        value = stats[r.numerator] if r.denominator is None else stats[r.numerator] / F.greatest(stats[r.denominator], F.lit(1))
        if r.low is not None:
            verdict = verdict & (value >= r.low)
        if r.high is not None:
            verdict = verdict & (value <= r.high)
    return verdict


def _judged(s: Column, rules) -> tuple[dict[str, Column], Column, Column]:
    """(statistics by name, base_failed, kept) of a struct of statistics."""
    stats = {n: s["w"][n] for n in ("n_words", "word_chars", "n_repeat_words", "n_stop_words")} | {n: s[n] for n in ("n_symbols", "n_shouts")} | {n: s["l"][n] for n in ("n_lines", "n_dup_lines")}
    failed = (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])
    return stats, failed, ~failed & compile_rules(stats, rules)


def rule_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: its counts, base_failed and kept."""
    stats, failed, kept = _judged(F.col("s"), rules)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stop_words")
    return pick(docs, "doc_id", "text").select("doc_id", statistics(F.col("text")).alias("s")).select("doc_id", *[stats[n].alias(n) for n in names], failed.alias("base_failed"), kept.alias("kept"))


def apply_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that every rule keeps, with all their columns."""
    whole = carry(docs, "text")
    return unload(whole.filter(let(statistics(F.col("text")), lambda s: _judged(s, rules)[2])), docs)
