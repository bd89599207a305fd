"""Evaluation of rankings and answers: measures of special test sets, baselines, robustness, pools and generated test sets.

Runs are (query_id, doc_id, rank, score), judgments (query_id, doc_id, grade). Everything is a join and an aggregation over
whole runs. Defined results: a question without a hit counts as a miss, one without what is asked about is left out; empty
runs give no rows or zero; repeated rows count once.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.operators import evaluate as ev
from lexweave.operators import score as sc


def _share(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def wrong_hits(run: DataFrame, wrong: DataFrame, k: int = 10) -> DataFrame:
    """(wrong_hit): the share of questions (query_id, ref) with one of their wrong references among the first ``k``."""
    asked = wrong.select("query_id").distinct()
    hit = run.where(F.col("rank") <= k).join(wrong.select("query_id", F.col("ref").alias("doc_id")).distinct(), ["query_id", "doc_id"]).select("query_id").distinct().withColumn("h", F.lit(True))
    return asked.join(hit, "query_id", "left").agg(_share(F.col("h")).alias("wrong_hit"))


def precision_by(run: DataFrame, qrels: DataFrame, groups: DataFrame, k: int = 5, least: int = 1) -> DataFrame:
    """(grp, queries, precision): mean precision at ``k`` by group (query_id, grp), such as a language or an era."""
    rel = qrels.where(F.col("grade") >= least).select("query_id", "doc_id").distinct().withColumn("r", F.lit(1))
    n = run.where(F.col("rank") <= k).join(rel, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum("r").alias("n"))
    return groups.select("query_id", "grp").distinct().join(n, "query_id", "left").groupBy("grp").agg(F.count("*").alias("queries"), (F.avg(F.coalesce("n", F.lit(0))) / k).alias("precision"))


def binding_share(run: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, binding): the share of the first ``k`` that binds in the question's state; docs (doc_id, states), queries (query_id, state)."""
    both = run.where(F.col("rank") <= k).join(docs.select("doc_id", "states"), "doc_id").join(queries.select("query_id", "state"), "query_id")
    return both.groupBy("query_id").agg(_share(F.array_contains("states", F.col("state")) | F.array_contains("states", "*")).alias("binding"))


def jurisdiction_grades(qrels: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, grade): 2 for relevant judgments that bind in the question's state, 1 for other relevant ones, else 0."""
    both = qrels.join(docs.select("doc_id", "states"), "doc_id", "left").join(queries.select("query_id", "state"), "query_id", "left")
    binds = F.coalesce(F.array_contains("states", F.col("state")) | F.array_contains("states", "*"), F.lit(False))
    return both.select("query_id", "doc_id", F.when(F.col("grade") <= 0, 0).when(binds, 2).otherwise(1).alias("grade"))


def first_is(run: DataFrame, expected: DataFrame) -> DataFrame:
    """(queries, code_at_1, offence_at_1, both_at_1, expected_at_1): what the first hit gets right; expected (query_id, ref, offence_id), hits carry (doc_id, offence_id)."""
    code = lambda c: F.substring_index(c, ":", 1)
    top = run.where("rank = 1").select("query_id", F.col("doc_id").alias("hit"), F.col("offence_id").alias("hit_offence"))
    both = expected.select("query_id", "ref", "offence_id").distinct().join(top, "query_id", "left")
    one = both.groupBy("query_id").agg(F.bool_or(F.coalesce(code("hit") == code("ref"), F.lit(False))).alias("c"), F.bool_or(F.coalesce(F.col("hit_offence") == F.col("offence_id"), F.lit(False))).alias("o"), F.bool_or(F.coalesce(F.col("hit") == F.col("ref"), F.lit(False))).alias("e"))
    return one.agg(F.count("*").alias("queries"), _share(F.col("c")).alias("code_at_1"), _share(F.col("o")).alias("offence_at_1"), _share(F.col("c") & F.col("o")).alias("both_at_1"), _share(F.col("e")).alias("expected_at_1"))


def facts_to_sections(run: DataFrame, gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, gold, first): the first rank at which a gold section or one of its aliases (ref, alias) is found, null where it isn't."""
    names = aliases.select("ref", "alias").unionByName(gold.select("ref", F.col("ref").alias("alias"))).distinct()
    want = gold.select("query_id", "ref").distinct().join(names, "ref").select("query_id", F.col("ref").alias("gold"), F.col("alias").alias("doc_id"))
    return want.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id", "gold").agg(F.min("rank").alias("first"))


def natural_cosine(terms: DataFrame, post: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): the plain baseline, natural logarithms on both sides; ``post`` has (term, doc_id, tf), ``stats`` (term, df, n)."""
    idf = stats.select("term", F.log((1 + F.col("n")) / (1 + F.col("df"))).alias("idf"))
    w = post.join(idf, "term").select("term", "doc_id", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    dn = w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    q = terms.join(idf, "term").select("query_id", "term", ((1 + F.log("weight")) * F.col("idf")).alias("qw"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = w.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return dots.join(dn, "doc_id").join(qn, "query_id").where("dn > 0 and qn > 0").select("query_id", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def expanded_queries(queries: DataFrame, named: DataFrame, equivalents: DataFrame) -> DataFrame:
    """(query_id, text): the question with the equivalents of the sections it names (query_id, ref) put after it, in order."""
    more = named.join(equivalents.select("ref", "other"), "ref").groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set(F.translate("other", ":", " "))), " ").alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "text", "more").alias("text"))


def recall_against(run: DataFrame, whole: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, recall): the share of the exhaustive first ``k`` that a faster search also has among its first ``k``."""
    want, got = (r.where(F.col("rank") <= k).select("query_id", "doc_id").distinct() for r in (whole, run))
    n = want.groupBy("query_id").agg(F.count("*").alias("n"))
    hit = want.join(got, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("h"))
    return n.join(hit, "query_id", "left").select("query_id", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def latencies(times: DataFrame) -> DataFrame:
    """(system, n, median, p95) of (system, seconds)."""
    return times.groupBy("system").agg(F.count("*").alias("n"), F.percentile("seconds", 0.5).alias("median"), F.percentile("seconds", 0.95).alias("p95"))


def ladder(runs: DataFrame, qrels: DataFrame, order: list[str]) -> DataFrame:
    """(step, system, map, gain): mean average precision of every rung of an ablation ladder and what it adds to the one before; runs carry ``system``."""
    rel = qrels.where("grade > 0").groupBy("query_id").agg(F.count("*").alias("n_rel"))
    names = runs.sparkSession.createDataFrame(list(enumerate(order)), "step int, system string")
    hits = runs.join(qrels.where("grade > 0").select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    seen = F.row_number().over(Window.partitionBy("system", "query_id").orderBy("rank"))
    ap = hits.withColumn("i", seen).groupBy("system", "query_id").agg(F.sum(F.col("i") / F.col("rank")).alias("s"))
    every = rel.crossJoin(F.broadcast(names))  # a handful of rungs
    mean = every.join(ap, ["system", "query_id"], "left").groupBy("step", "system").agg(F.avg(F.coalesce("s", F.lit(0.0)) / F.col("n_rel")).alias("map"))
    before = F.lag("map").over(Window.partitionBy(F.lit(1)).orderBy("step"))  # a ladder is a handful of rows
    return mean.withColumn("gain", F.col("map") - before)


#: Neighbours on a keyboard.
KEYS = {"a": "qs", "s": "adw", "d": "sfe", "f": "dgr", "g": "fht", "h": "gjy", "j": "hku", "k": "jli", "l": "ko", "e": "wrd", "r": "etf", "t": "ryg", "i": "uok", "o": "ipl", "n": "bm", "m": "n", "c": "xv", "b": "vn", "u": "yi", "p": "o"}


def misspelled(word: str, seed: int) -> str:
    """One slip inside a word of five letters or more: a swap, a lost, a doubled or a neighbouring letter; the ends stay."""
    if len(word) < 5 or not word.isalpha():
        return word
    rng = random.Random(f"{seed}:{word}")
    i = rng.randrange(1, len(word) - 2)
    kind = rng.choice(("swap", "drop", "double", "near"))
    if kind == "swap":
        return word[:i] + word[i + 1] + word[i] + word[i + 2 :] if word[i] != word[i + 1] else word[:i] + word[i + 1 :]
    if kind == "drop":
        return word[:i] + word[i + 1 :]
    return word[:i] + (word[i] + word[i] if kind == "double" else rng.choice(KEYS.get(word[i].lower(), "x"))) + word[i + 1 :]


def typo_queries(queries: DataFrame, seed: int = 1) -> DataFrame:
    """(query_id, text): every question with a slip in its longest word, the same on every run."""

    @F.pandas_udf("string")
    def slip(t: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            words = (text or "").split()
            at = max(range(len(words)), key=lambda i: (len(words[i]), -i), default=None)
            return text if at is None else " ".join([*words[:at], misspelled(words[at], seed), *words[at + 1 :]])

        return t.map(one)

    return queries.select("query_id", slip("text").alias("text"))


def known_item(run: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """(queries, mrr, success): how high the one document asked for (query_id, doc_id) comes."""
    hit = wanted.select("query_id", "doc_id").distinct().join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.min("rank").alias("r"))
    return hit.agg(F.count("*").alias("queries"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), _share(F.col("r") <= k).alias("success"))


def latest_files(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of several result files merged: of each ``key`` the row of the last file holds."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r")


def layers(scores: DataFrame, base: str) -> DataFrame:
    """(system, queries, mean, difference, wins, losses): every system against ``base`` over the questions both have; scores (system, query_id, value)."""
    b = scores.where(F.col("system") == base).select("query_id", F.col("value").alias("b"))
    both = scores.where(F.col("system") != base).join(b, "query_id")
    return both.groupBy("system").agg(F.count("*").alias("queries"), F.avg("value").alias("mean"), F.avg(F.col("value") - F.col("b")).alias("difference"), F.count_if(F.col("value") > F.col("b")).alias("wins"), F.count_if(F.col("value") < F.col("b")).alias("losses"))


def misgrounded(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, named, verdict): the first section an answer names outside quotations against the expected code and section.

    ``answers`` has (query_id, text), ``expected`` (query_id, ref). Verdicts: right, wrong_code, wrong_section, none.
    """
    from lexweave.functions import legal, lexical

    plain = F.regexp_replace("text", "\"[^\"]*\"|“[^”]*”", " ")
    mention = lexical.vectorised(legal.section_mentions, legal.MENTION_TYPE)
    named = answers.select("query_id", plain.alias("t")).select("query_id", mention("t").alias("m")).select("query_id", F.when(F.size("m") > 0, F.concat_ws(":", F.col("m")[0]["code"], F.col("m")[0]["section"])).alias("named"))
    code = lambda c: F.substring_index(c, ":", 1)
    verdict = F.when(F.col("named").isNull(), "none").when(F.col("named") == F.col("ref"), "right").when(code("named") != code("ref"), "wrong_code").otherwise("wrong_section")
    return expected.join(named, "query_id", "left").select("query_id", "named", verdict.alias("verdict"))


def discordant(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b, p): questions that one of two systems gets right (query_id, correct), with McNemar's exact p."""
    both = a.select("query_id", F.col("correct").alias("a")).join(b.select("query_id", F.col("correct").alias("b")), "query_id")
    n = both.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))

    @F.pandas_udf("double")
    def exact(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([ev.mcnemar(int(i), int(j)) for i, j in zip(x, y)])

    return n.withColumn("p", exact("only_a", "only_b"))


def without_code(run: DataFrame, wrong: DataFrame, k: int = 10) -> DataFrame:
    """The run without hits of a question's wrong code (query_id, code), ranks closed up, the first ``k``: the context ablation."""
    code = F.substring_index("doc_id", ":", 1)
    kept = run.withColumn("code", code).join(wrong.select("query_id", "code").distinct(), ["query_id", "code"], "left_anti").drop("code", "rank")
    return sc.topk(kept, k)


def balanced_sample(questions: DataFrame, group: str, n: int) -> DataFrame:
    """The first ``n`` of every group in the order of their hashes, groups taken in turn; a fixed sample for every run."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.col("query_id").cast("string")), "query_id"))
    return questions.withColumn("turn", rank).where(F.col("turn") <= n)


def cross_version_set(sections: DataFrame, equivalents: DataFrame) -> DataFrame:
    """(query_id, text, wrong_ref, expected): questions about each section by its title, to be answered from the other code; generated test set."""
    s = sections.select("ref", "title").where("title is not null")
    return s.join(equivalents, "ref").select(F.concat(F.lit("xv:"), "ref", F.lit(">"), "other").alias("query_id"), F.concat(F.lit("What is the law on "), F.lower("title")).alias("text"), F.col("ref").alias("wrong_ref"), F.col("other").alias("expected"))


def statute_docs(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref, doc_id): the documents of a reference, by itself or by its base section; docs (doc_id, ref)."""
    base = F.regexp_replace("ref", r"\(.*$", "")
    keys = refs.select("ref", F.explode(F.array_distinct(F.array("ref", base))).alias("k")).distinct()
    return keys.join(docs.select("doc_id", F.col("ref").alias("k")), "k").select("ref", "doc_id").distinct()


def answer_quality(answers: DataFrame) -> DataFrame:
    """(answers, support, abstain_precision, abstain_recall) of (query_id, answerable, abstains, supported, sentences)."""
    said = F.sum(F.when(~F.col("abstains"), F.col("sentences")))
    right, gave = F.count_if(F.col("abstains") & ~F.col("answerable")), F.count_if(F.col("abstains"))
    return answers.agg(
        F.count("*").alias("answers"), (F.sum(F.when(~F.col("abstains"), F.col("supported"))) / F.nullif(said, F.lit(0))).alias("support"),
        (right / F.nullif(gave, F.lit(0))).alias("abstain_precision"), (right / F.nullif(F.count_if(~F.col("answerable")), F.lit(0))).alias("abstain_recall"),
    )


def outcome_classes(run: DataFrame, gold: DataFrame, by: DataFrame, k: int = 10) -> DataFrame:
    """(grp, outcome, n): hit at 1, hit within ``k``, same section of another code, or miss, by style or era (query_id, grp)."""
    number = lambda c: F.substring_index(c, ":", -1)
    both = gold.select("query_id", "ref").distinct().join(run.where(F.col("rank") <= k).select("query_id", "doc_id", "rank"), "query_id", "left")
    one = both.groupBy("query_id").agg(F.min(F.when(F.col("doc_id") == F.col("ref"), F.col("rank"))).alias("r"), F.bool_or(F.coalesce((number("doc_id") == number("ref")) & (F.col("doc_id") != F.col("ref")), F.lit(False))).alias("near"))
    what = F.when(F.col("r") == 1, "first").when(F.col("r").isNotNull(), "found").when(F.col("near"), "other_code").otherwise("missed")
    return one.join(by.select("query_id", "grp").distinct(), "query_id").groupBy("grp", what.alias("outcome")).agg(F.count("*").alias("n"))


def stale_share(run: DataFrame, stale: DataFrame, k: int = 10) -> DataFrame:
    """(stale): the mean share of the first ``k`` whose law no longer carries over; stale (query_id, doc_id)."""
    head = run.where(F.col("rank") <= k)
    hit = head.join(stale.select("query_id", "doc_id").distinct().withColumn("s", F.lit(True)), ["query_id", "doc_id"], "left")
    return hit.groupBy("query_id").agg(_share(F.col("s")).alias("s")).agg(F.avg("s").alias("stale"))


def size_report(post: DataFrame) -> DataFrame:
    """(docs, terms, postings): the size of an index."""
    return post.agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))
