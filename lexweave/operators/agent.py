"""Control of batched research rounds: routing, planning sub-queries, fusing and one gated feedback round."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators import score as sc


@dataclass(frozen=True)
class Options:
    """Which stages a search runs."""

    lexical: str = "bm25"
    ngrams: bool = False
    bridge: bool = False
    authority: bool = False
    feedback: bool = False
    collapse: bool = False
    top_k: int = 10
    depth: int = 50


PRESETS = {
    "baseline": Options(), "ngram_baseline": Options(ngrams=True), "interactive": Options(ngrams=True, authority=True, collapse=True),
    "full": Options(ngrams=True, bridge=True, authority=True, feedback=True, collapse=True),
}


def preset(name: str, **changes) -> Options:
    return replace(PRESETS[name], **changes)


def route(text: Column, section: str = r"(?i)\b(section|sec\.|s\.|article|art\.|dhara)\s*\d+") -> Column:
    """case_text, section_lookup or fact_question."""
    long = F.size(F.split(F.trim(text), r"\s+")) >= 50
    return F.when(long, "case_text").when(text.rlike(section), "section_lookup").otherwise("fact_question")


def plan(queries: DataFrame, salient: DataFrame) -> DataFrame:
    """(query_id, sub, kind, text, weight): the question itself and its most telling words as a second sub-query; case texts weigh less."""
    q = queries.select("query_id", "text", route(F.col("text")).alias("route"))
    first = q.select("query_id", F.lit(0).alias("sub"), F.lit("original").alias("kind"), "text", F.lit(1.0).alias("weight"))
    words = salient.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("text"))
    second = q.select("query_id", "route").join(words, "query_id").select("query_id", F.lit(1).alias("sub"), F.lit("salient").alias("kind"), "text", F.when(F.col("route") == "case_text", 0.3).otherwise(0.8).alias("weight"))
    return first.unionByName(second)


def run_round(subs: DataFrame, post: DataFrame, stats: DataFrame, norms: DataFrame | None = None, depth: int = 50) -> DataFrame:
    """(query_id, sub, doc_id, score, rank, weight): every sub-query of the batch in one search."""
    keyed = subs.withColumn("_k", F.concat_ws("#", F.col("query_id").cast("string"), F.col("sub").cast("string")))
    terms = sc.query_terms(keyed, "_k", "text")
    got = sc.topk(sc.bm25(terms, post, stats, norms), depth)
    return got.join(keyed.select(F.col("_k").alias("query_id"), F.col("query_id").alias("_q"), "sub", "weight"), "query_id").select(F.col("_q").alias("query_id"), "sub", "doc_id", "score", "rank", "weight")


def fuse_round(found: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank, found_by): reciprocal rank fusion with the sub-queries that found a document."""
    by = found.groupBy("query_id", "doc_id").agg(F.sum(F.col("weight") / (60 + F.col("rank"))).alias("score"), F.sort_array(F.collect_set("sub")).alias("found_by"))
    return sc.topk(by, k)


def wants_more(fused: DataFrame, confidence: DataFrame, least: int = 10, floor: float = 0.35) -> DataFrame:
    """(query_id): queries with fewer than ``least`` results or low confidence."""
    n = fused.groupBy("query_id").agg(F.count("*").alias("n"))
    return confidence.join(n, "query_id", "left").where((F.coalesce("n", F.lit(0)) < least) | (F.col("confidence") < floor)).select("query_id")


def votes(fused: DataFrame, cites: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, ref, score, voters): provisions cited by the best documents, weighted by 1/rank, from two voters on."""
    v = fused.join(cites.select("doc_id", "ref").distinct(), "doc_id").groupBy("query_id", "ref").agg(F.sum(1 / F.col("rank")).alias("score"), F.count_distinct("doc_id").alias("voters"))
    return v.where(F.col("voters") >= least)
