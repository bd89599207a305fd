"""Scoring, fusion and re-ranking of batches of queries. Query sides are small, stated sets; documents are only mapped and joined."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import words
from lexweave.operators import index as ix
from lexweave.session import cut


def query_terms(queries: DataFrame, query_id: str, text: str, tokens: Column | None = None) -> DataFrame:
    """(query_id, term, weight): a term weighs as often as it stands in the query."""
    toks = words(F.col(text)) if tokens is None else tokens
    rows = queries.select(F.col(query_id).alias("query_id"), F.explode(toks).alias("term"))
    return rows.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))


def merge_terms(*parts: DataFrame) -> DataFrame:
    """Expansions merge by the larger weight."""
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "term").agg(F.max("weight").alias("weight"))


def prune(terms: DataFrame, stats: DataFrame, keep: int, idf: str = "idf_bm25") -> DataFrame:
    """The ``keep`` terms of a query with the largest idf times weight."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.col(idf) * F.col("weight")), "term"))
    return terms.join(stats, "term").withColumn("_r", rank).where(F.col("_r") <= keep).select("query_id", "term", "weight", *[c for c in stats.columns if c != "term"])


def candidates_for(post: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings of the terms the batch asks for; everything else is dropped before any shuffle of postings.

    Query terms are a stated set; whether they are small enough to broadcast is left to the optimiser's size check.
    """
    return post.join(terms.select("term").distinct(), "term", "left_semi")


def topk(scores: DataFrame, k: int, by: str = "query_id", score: str = "score", doc: str = "doc_id") -> DataFrame:
    """The ``k`` best of each query with their rank; ties go to the larger id."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), F.desc(doc)))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def bm25(terms: DataFrame, post: DataFrame, stats: DataFrame, norms: DataFrame | None = None, k1: float = 1.6) -> DataFrame:
    """(query_id, doc_id, score) by BM25 with length norms, which the postings carry where ``norms`` is None."""
    hits = post.join(terms.join(stats.select("term", "idf_bm25"), "term"), "term")
    hits = hits if norms is None else hits.join(norms, "doc_id")
    part = F.col("weight") * F.col("idf_bm25") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * F.col("norm"))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def bm25f(terms: DataFrame, post: DataFrame, stats: DataFrame, norms: DataFrame, zones: dict[str, float], k1: float = 1.6) -> DataFrame:
    """(query_id, doc_id, score): zone frequencies are normed and weighted, added up, and saturated once per term."""
    weight = F.coalesce(*[F.when(F.col("zone") == z, F.lit(float(w))) for z, w in zones.items() if w > 0])
    used = post.withColumn("zw", weight).where("zw is not null")
    hits = used.join(terms.join(stats.select("term", "idf_bm25"), "term"), "term").join(norms, ["doc_id", "zone"])
    per_term = hits.groupBy("query_id", "doc_id", "term").agg(F.first("weight").alias("qw"), F.first("idf_bm25").alias("idf"), F.sum(F.col("zw") * F.col("tf") / F.col("norm")).alias("tfn"))
    part = F.col("qw") * F.col("idf") * F.col("tfn") * (k1 + 1) / (F.col("tfn") + k1)
    return per_term.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def zone_breakdown(terms: DataFrame, post: DataFrame, norms: DataFrame, zones: dict[str, float]) -> DataFrame:
    """(query_id, doc_id, zone, share): what each zone adds to the normed frequencies of a hit."""
    weight = F.coalesce(*[F.when(F.col("zone") == z, F.lit(float(w))) for z, w in zones.items() if w > 0])
    hits = post.withColumn("zw", weight).where("zw is not null").join(terms, "term").join(norms, ["doc_id", "zone"])
    by = hits.groupBy("query_id", "doc_id", "zone").agg(F.sum(F.col("zw") * F.col("tf") / F.col("norm")).alias("part"))
    return by.withColumn("share", F.col("part") / F.sum("part").over(Window.partitionBy("query_id", "doc_id"))).drop("part")


def cosine_norm(tokens: Column) -> Column:
    """The length of a text's vector of 1 + log10 tf, from its sorted words alone: no postings are moved for it."""
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"))

    def closed(a: Column) -> Column:
        return a["sum"] + F.when(a["n"] > 0, F.pow(1 + F.log10(a["n"].cast("double")), 2)).otherwise(0.0)

    def step(a: Column, x: Column) -> Column:
        same = a["w"] == x
        return F.struct(x.alias("w"), F.when(same, a["n"] + 1).otherwise(1).alias("n"), F.when(same, a["sum"]).otherwise(closed(a)).alias("sum"))

    return F.aggregate(F.array_sort(tokens), start, step, lambda a: F.sqrt(closed(a)))


def tfidf(terms: DataFrame, post: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): cosine of (1 + log10 tf) documents, whose norms the postings carry as ``dn``, and idf-weighted queries."""
    qw = F.when(F.col("weight") < 1, F.col("weight")).otherwise(1 + F.log10("weight")) * F.col("idf_log10")
    q = terms.join(stats.select("term", "idf_log10"), "term").where("idf_log10 > 0").select("query_id", "term", qw.alias("qw"))
    qn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = post.join(q, "term").groupBy("query_id", "doc_id").agg(F.sum((1 + F.log10("tf")) * F.col("qw")).alias("dot"), F.first("dn").alias("dn"))
    return dots.join(qn, "query_id").select("query_id", "doc_id", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))


def gram_bm25(grams: DataFrame, post: DataFrame, stats: DataFrame, top: int = 300) -> DataFrame:
    """(query_id, doc_id, score) over the distinct n-grams of each query; the best ``top`` are kept before any candidate filter."""
    q = grams.select("query_id", "term").distinct().withColumn("weight", F.lit(1.0))
    return topk(bm25(q, post, stats, k1=1.2), top).drop("rank")


def maxp(queries: DataFrame, passages: DataFrame, dims: str = "embedding", block: int = 20_000) -> DataFrame:
    """(query_id, doc_id, score): the best cosine of a document's passages; ``queries`` is a stated set, taken against all rows.

    Blocks of ``block`` queries are sent to the tasks, which multiply them with a batch of passages and keep the best of each
    document in it, so what leaves a task is a row per query, document and batch. More blocks cost a scan each. Vectors without
    a length, and nulls, have no score.
    """
    rows = queries.select("query_id", F.col(dims).cast("array<double>").alias("v")).where("v is not null")
    blocks = max(1, -(-rows.count() // block))
    types = dict(queries.dtypes)["query_id"], dict(passages.dtypes)["doc_id"]
    parts = []
    for n in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n).toPandas()
        if len(got):
            parts.append((got["query_id"].to_numpy(), _unit(np.stack(got["v"].to_list()))))
    spark = queries.sparkSession
    schema = f"query_id {types[0]}, doc_id {types[1]}, score double"
    out = []
    for part in parts:
        shared = spark.sparkContext.broadcast(part)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for b in batches:
                b = b.sort_values("doc_id", kind="stable")
                if not len(b):
                    continue
                p = _unit(np.stack(b["v"].to_list()))
                docs, starts = np.unique(b["doc_id"].to_numpy(), return_index=True)
                best = np.maximum.reduceat(p @ q.T, starts, axis=0)
                yield pd.DataFrame({"query_id": np.tile(ids, len(docs)), "doc_id": np.repeat(docs, len(ids)), "score": best.ravel()})

        given = passages.select("doc_id", F.col(dims).cast("array<double>").alias("v")).where("v is not null and doc_id is not null")
        out.append(given.mapInPandas(run, schema))
    if not out:
        return spark.createDataFrame([], schema)
    best = reduce(DataFrame.unionByName, out).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return best.where(~F.isnan("score"))


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, length, out=np.full_like(rows, np.nan), where=length > 0)


def qpp_pre(terms: DataFrame, stats: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(query_id, max_idf, avg_idf, scope) before retrieval, over terms of positive idf."""
    hits = terms.join(stats, "term").where("idf_log10 > 0").crossJoin(F.broadcast(n_docs))
    return hits.groupBy("query_id").agg(F.max("idf_log10").alias("max_idf"), F.avg("idf_log10").alias("avg_idf"), F.least(F.lit(1.0), F.sum("df") / F.first("n")).alias("scope"))


def qpp_post(ranked: DataFrame, depth: int = 10) -> DataFrame:
    """(query_id, gap, top_ratio, spread) of the first ``depth`` scores."""
    head = ranked.where(F.col("rank") <= depth)
    s = head.groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2"), F.avg("score").alias("m"), F.stddev_pop("score").alias("sd")
    )
    gap = F.when(F.col("s1") > 0, (F.col("s1") - F.coalesce("s2", F.lit(0.0))) / F.col("s1")).otherwise(0.0)
    return s.select("query_id", gap.alias("gap"), F.when(F.col("m") > 0, F.col("s1") / F.col("m")).otherwise(0.0).alias("top_ratio"), F.when(F.col("m") > 0, F.col("sd") / F.col("m")).otherwise(0.0).alias("spread"))


def confidence(max_idf: Column, gap: Column) -> Column:
    return 0.5 * F.least(F.lit(1.0), max_idf / 3) + 0.5 * F.least(F.lit(1.0), gap / 0.2)


def _by(df: DataFrame, fn, *cols: str) -> Column:
    return fn(*cols).over(Window.partitionBy("query_id"))


def max_normal(scores: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("query_id"))
    return scores.withColumn("score", F.col("score") / F.when(top == 0, 1.0).otherwise(top))


def min_max(scores: DataFrame) -> DataFrame:
    """To 0..1 within each query; equal scores all become 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)))


def z_score(scores: DataFrame) -> DataFrame:
    """Standard scores within each query; fewer than two, or no spread, give 0."""
    w = Window.partitionBy("query_id")
    sd = F.stddev_pop("score").over(w)
    return scores.withColumn("score", F.when((F.count("*").over(w) < 2) | (sd == 0), 0.0).otherwise((F.col("score") - F.avg("score").over(w)) / sd))


def mix(a: DataFrame, b: DataFrame, beta: float) -> DataFrame:
    """(1 - beta) a/max + beta b/max over the union; a missing score is 0."""
    x, y = max_normal(a).withColumnRenamed("score", "_a"), max_normal(b).withColumnRenamed("score", "_b")
    s = (1 - beta) * F.coalesce("_a", F.lit(0.0)) + beta * F.coalesce("_b", F.lit(0.0))
    return x.join(y, ["query_id", "doc_id"], "full").select("query_id", "doc_id", s.alias("score"))


def fuse(a: DataFrame, b: DataFrame, alpha: float, normal=min_max) -> DataFrame:
    """alpha a + (1 - alpha) b after ``normal``; a document missing from a channel gets the channel's minimum."""
    x, y = normal(a).withColumnRenamed("score", "_a"), normal(b).withColumnRenamed("score", "_b")
    both = x.join(y, ["query_id", "doc_id"], "full")
    w = Window.partitionBy("query_id")
    s = alpha * F.coalesce(F.col("_a"), F.min("_a").over(w), F.lit(0.0)) + (1 - alpha) * F.coalesce(F.col("_b"), F.min("_b").over(w), F.lit(0.0))
    return both.select("query_id", "doc_id", s.alias("score"))


def rrf(ranked: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, doc_id, rank, weight)."""
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("score"))


def combsum(runs: DataFrame) -> DataFrame:
    """Weighted sum of min-max scores of (query_id, run, doc_id, score, weight)."""
    w = Window.partitionBy("query_id", "run")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    s = F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)) * F.col("weight")
    return runs.withColumn("_s", s).groupBy("query_id", "doc_id").agg(F.sum("_s").alias("score"))


def net_score(scores: DataFrame, authority: DataFrame, weight: float = 0.2) -> DataFrame:
    g = F.coalesce("g", F.lit(0.0))
    return scores.join(authority, "doc_id", "left").select("query_id", "doc_id", (F.col("score") + weight * g).alias("score"))


def collapse(ranked: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """One document of each duplicate group within the first 3k, then the first k."""
    head = ranked.where(F.col("rank") <= 3 * k).join(groups, "doc_id", "left")
    same = F.coalesce(F.col("grp").cast("string"), F.col("doc_id").cast("string"))
    first = F.row_number().over(Window.partitionBy("query_id", same).orderBy("rank"))
    kept = head.withColumn("_f", first).where("_f = 1").drop("_f", "grp", "rank")
    return topk(kept, k)


def bridge(statute_hits: DataFrame, cites: DataFrame, scale: float = 0.3, top: int = 10) -> DataFrame:
    """(query_id, doc_id, boost): documents that cite the query's best provisions, scaled to ``scale``."""
    head = max_normal(topk(statute_hits, top).drop("rank")).select("query_id", F.col("doc_id").alias("ref"), "score")
    got = head.join(cites.select("doc_id", "ref").distinct(), "ref").groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
    return max_normal(got).select("query_id", "doc_id", (scale * F.col("score")).alias("boost"))


def boosted(scores: DataFrame, boosts: DataFrame) -> DataFrame:
    """Boosts never add documents."""
    return scores.join(boosts, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("boost", F.lit(0.0))).alias("score"))


def demote(ranked: DataFrame, penalty: Column, depth: int = 100) -> DataFrame:
    """Subtract a share of the head's spread from its documents: overruled or doubted cases, or law that doesn't carry over."""
    w = Window.partitionBy("query_id")
    head = F.col("rank") <= depth
    spread = F.max(F.when(head, F.col("score"))).over(w) - F.min(F.when(head, F.col("score"))).over(w)
    return ranked.withColumn("score", F.when(head, F.col("score") - F.coalesce(penalty, F.lit(0.0)) * spread).otherwise(F.col("score")))


def rocchio(judged: DataFrame, post: DataFrame, stats: DataFrame, gamma: float = 0.25, top: int = 10) -> DataFrame:
    """(query_id, term, weight) from judged (query_id, doc_id, relevant): mean weights of relevant less gamma that of other documents."""
    w = (1 + F.log10("tf")) * F.col("idf_log10")
    rows = judged.join(post, "doc_id").join(stats.select("term", "idf_log10"), "term")
    n = judged.groupBy("query_id").agg(F.sum(F.col("relevant").cast("int")).alias("np"), F.sum((~F.col("relevant")).cast("int")).alias("nn"))
    s = rows.groupBy("query_id", "term").agg(F.sum(F.when(F.col("relevant"), w).otherwise(0.0)).alias("p"), F.sum(F.when(~F.col("relevant"), w).otherwise(0.0)).alias("q"))
    weight = F.when(F.col("np") > 0, F.col("p") / F.col("np")).otherwise(0.0) - gamma * F.when(F.col("nn") > 0, F.col("q") / F.col("nn")).otherwise(0.0)
    out = s.join(n, "query_id").select("query_id", "term", weight.alias("weight")).where("weight > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term"))
    return out.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def linear(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """A learned ranking: the weighted sum of feature columns."""
    return features.select("query_id", "doc_id", sum((F.lit(w) * F.coalesce(F.col(f), F.lit(0.0)) for f, w in weights.items()), F.lit(0.0)).alias("score"))


def query_tables(docs: DataFrame, doc_id: str, text: str, terms: DataFrame, b: float = 1.0, tokens: Column | None = None, cosine: bool = False) -> tuple[DataFrame, DataFrame]:
    """(postings with tf, norm and, with ``cosine``, dn; statistics) of the terms a batch asks for.

    Texts are cut into words (or ``tokens``) once. Words no query has are dropped before the only shuffle, so what moves grows
    with the hits and not with the corpus; every document also sends one row without a term, from which the totals are taken.
    The hits are written to the shared folder once: totals, statistics and scores read them there instead of cutting the texts
    again.
    """
    cut_up = words(F.col(text)) if tokens is None else tokens
    toks = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(cut_up, F.array().cast("array<string>")).alias("_w"))
    own = [F.size("_w").alias("len"), *([cosine_norm(F.col("_w")).alias("dn")] if cosine else [])]
    kept = ["len", *(["dn"] if cosine else [])]
    once = toks.select("doc_id", *own, "_w")  # a projection of its own, else each word would reckon them again
    rows = once.select("doc_id", *kept, F.explode(F.concat(F.array(F.lit("")), "_w")).alias("term"))
    asked = terms.select("term").union(terms.sparkSession.range(1).select(F.lit("")))
    post = cut(candidates_for(rows, asked).groupBy("term", "doc_id", *kept).agg(F.count("*").alias("tf")))
    one = F.col("term") == ""
    totals = post.agg(F.sum(F.when(one, 1)).alias("n"), F.avg(F.when(one, F.col("len"))).alias("avg_len"))
    norm = F.when(F.col("avg_len") > 0, F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("avg_len")).otherwise(F.lit(1.0))
    df = post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).crossJoin(F.broadcast(totals.select("n")))
    n = F.col("n").cast("double")
    stats = df.select("term", "df", "cf", ix.idf_log10(n, F.col("df")).alias("idf_log10"), ix.idf_bm25(n, F.col("df")).alias("idf_bm25"))
    return post.crossJoin(F.broadcast(totals)).select("term", "doc_id", "tf", norm.alias("norm"), *kept[1:]), stats


def search_tables(docs: DataFrame, doc_id: str, text: str, b: float = 1.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, statistics, norms) of one corpus."""
    post = ix.postings(ix.token_rows(docs, doc_id, text))
    lengths = ix.doc_lengths(docs, doc_id, text)
    return post, ix.term_stats(post, docs.agg(F.count("*").alias("n"))), ix.length_norms(lengths, b)
