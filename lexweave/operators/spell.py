"""Tolerant retrieval: k-gram candidates, corrections, wildcards, phonetic buckets, lexicon look-up."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.lexical import hindi_soundex, normal_roman, osa, vectorised
from lexweave.functions.text import char_bigrams


def kgram_candidates(words: DataFrame, vocabulary: DataFrame, least: float = 0.3, length_diff: int = 2) -> DataFrame:
    """(word, term, jaccard): vocabulary terms that share enough character pairs with a word; a set-similarity equi-join on pairs."""
    a = words.select("word", char_bigrams(F.col("word")).alias("g"))
    b = vocabulary.select("term", char_bigrams(F.col("term")).alias("h"))
    x = a.select("word", F.size("g").alias("na"), F.length("word").alias("la"), F.explode("g").alias("k"))
    y = b.select("term", F.size("h").alias("nb"), F.length("term").alias("lb"), F.explode("h").alias("k"))
    both = x.join(y, "k").where((F.abs(F.col("la") - F.col("lb")) <= length_diff) & (F.col("word") != F.col("term")))
    c = both.groupBy("word", "term").agg(F.count("*").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    j = F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))
    return c.select("word", "term", j.alias("jaccard")).where(F.col("jaccard") >= least)


def osa_distance(a: str, b: str) -> Column:
    """Edit distance with swaps of neighbours, 3 when over 2."""

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else osa(p, q, 2) for p, q in zip(x, y)], dtype="object")

    return distance(a, b)


def corrections(words: DataFrame, vocabulary: DataFrame, limit: int = 2) -> DataFrame:
    """(word, term, edits): the best correction of each word: fewest edits, same first letter, most frequent, then by name."""
    near = kgram_candidates(words, vocabulary.select("term")).withColumn("edits", osa_distance("word", "term")).where(F.col("edits") <= limit)
    ranked = near.join(vocabulary, "term").withColumn("first", (F.substring("word", 1, 1) != F.substring("term", 1, 1)).cast("int"))
    r = F.row_number().over(Window.partitionBy("word").orderBy("edits", "first", F.desc("df"), "term"))
    return ranked.withColumn("r", r).where("r = 1").select("word", "term", "edits")


def policy(words: DataFrame, best: DataFrame) -> DataFrame:
    """(word, term, action): unseen words are corrected, rare ones with a neighbour 50 times as frequent at one edit get a suggestion."""
    both = words.join(best, "word", "left")
    a = F.when(F.col("term").isNull(), "none").when(F.coalesce("df", F.lit(0)) == 0, "applied").when((F.col("df") <= 2) & (F.col("edits") == 1) & (F.col("term_df") >= 50 * F.col("df")), "suggested").otherwise("none")
    return both.select("word", "term", a.alias("action"))


def soundex_buckets(terms: DataFrame, hindi: bool = False) -> DataFrame:
    """(code, n, first): phonetic buckets of a vocabulary."""
    code = vectorised(hindi_soundex, "string")(F.col("term")) if hindi else F.soundex("term")
    return terms.select("term", code.alias("code")).groupBy("code").agg(F.count("*").alias("n"), F.min("term").alias("first"))


def lexicon_lookup(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, english, weight): exact, then by folded spelling, then by phonetic key at 0.8; the lexicon is a bounded dictionary."""
    norm, key = vectorised(normal_roman, "string"), vectorised(hindi_soundex, "string")
    w = words.select("word", norm("word").alias("n"), key("word").alias("p"))
    lx = lexicon.select("roman", "english", "weight")
    exact = lx.groupBy(F.col("roman").alias("word")).agg(F.max(F.struct("weight", "english")).alias("e"))
    folded = lx.groupBy(norm("roman").alias("n")).agg(F.max(F.struct("weight", "english")).alias("f"))
    sound = lx.where(F.length("roman") >= 5).groupBy(key("roman").alias("p")).agg(F.max(F.struct("weight", "english")).alias("s"))
    got = w.join(exact, "word", "left").join(folded, "n", "left").join(sound, "p", "left")
    weak = F.when(F.length("word") >= 5, F.col("s"))
    english = F.coalesce("e.english", "f.english", weak["english"])
    weight = F.coalesce("e.weight", "f.weight", weak["weight"] * 0.8)
    return got.where(english.isNotNull()).select("word", english.alias("english"), weight.alias("weight"))
