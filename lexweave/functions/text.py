"""Column expressions over text: words, n-grams, light stems, era and language cues. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: Latin letters and digits with an inner apostrophe, or a run of another script's letters and signs.
WORD = r"[a-z0-9]+(?:'[a-z]+)?|[\x{0900}-\x{0DFF}\x{0600}-\x{06FF}]+"


def words(text: Column) -> Column:
    """The lower-case words of a text, in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def plain_words(text: Column) -> Column:
    """Latin words and digits only, masks removed; the stream n-gram scoring uses."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, r"\[MASK\]", " ")), F.lit("[a-z0-9]+"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens joined by a space, in order, with repeats."""
    size = F.size(tokens)
    starts = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def char_bigrams(term: Column) -> Column:
    """The distinct character pairs of a term between $ signs."""
    t = F.concat(F.lit("$"), term, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2)))


def light_stem(word: Column) -> Column:
    """The first of seven English suffixes taken off where more than three letters are left over."""
    out = word
    for suffix in reversed(("ingly", "ation", "ing", "ed", "es", "ly", "s")):
        out = F.when(word.endswith(suffix) & (F.length(word) > len(suffix) + 3), F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def era(text: Column, new: str, old: str) -> Column:
    """``new`` or ``old`` when only that side's cues (regular expressions) occur, null when both or none do."""
    n, o = F.lower(text).rlike(new), F.lower(text).rlike(old)
    return F.when(n & ~o, F.lit("new")).when(o & ~n, F.lit("old"))


def code_in_force(date: Column, change: str) -> Column:
    """``new`` from a day on, ``old`` before, ``?`` without a date."""
    return F.when(date.isNull(), "?").when(date >= F.to_date(F.lit(change)), "new").otherwise("old")
