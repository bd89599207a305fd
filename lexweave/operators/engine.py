"""One search: questions are taken apart, documents filtered, channels scored and fused, boosts and penalties applied, duplicates collapsed.

Every stage is a join or aggregation over the whole batch of questions; the options choose stages, and a table that isn't given
switches its stage off. Nothing is collected; what several stages read is written to the shared folder once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import ngrams, plain_words
from lexweave.operators import agent as ag
from lexweave.operators import analyse as an
from lexweave.operators import index as ix
from lexweave.operators import score as sc
from lexweave.session import cut


@dataclass(frozen=True)
class Corpus:
    """docs (doc_id, text, states?, decision_date?), and what else is known: statutes (doc_id, text), cites (doc_id, ref), authority (doc_id, g),
    groups (doc_id, grp), penalties (doc_id, penalty), vectors (query_id, doc_id, score), vocabulary's lexicon, section offences."""

    docs: DataFrame
    statutes: DataFrame | None = None
    cites: DataFrame | None = None
    authority: DataFrame | None = None
    groups: DataFrame | None = None
    penalties: DataFrame | None = None
    dense: DataFrame | None = None
    lexicon: DataFrame | None = None
    offences: DataFrame | None = None


def restricted(scores: DataFrame, docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Hits that pass the filters of their question: state (``*`` binds everywhere), date range, code."""
    cols = [c for c in ("states", "decision_date", "cites") if c in docs.columns]
    rows = scores.join(asked.select("query_id", "filters", "state"), "query_id").join(docs.select("doc_id", *cols), "doc_id")
    ok = F.lit(True)
    if "states" in cols:
        ok = ok & (F.col("state").isNull() | F.array_contains("states", F.lower("state")) | F.array_contains("states", "*"))
    if "decision_date" in cols:
        for key, test in (("date_from", lambda d, v: d >= v), ("date_to", lambda d, v: d <= v)):
            v = F.col("filters")[key]
            ok = ok & (v.isNull() | F.coalesce(test(F.col("decision_date"), v), F.lit(False)))
    if "cites" in cols:
        code = F.col("filters")["code"]
        ok = ok & (code.isNull() | F.exists("cites", lambda r: F.substring_index(r, ":", 1) == F.lower(code)))
    return rows.where(ok).select(*scores.columns)


def search(corpus: Corpus, queries: DataFrame, res: an.Resources, options: ag.Options) -> DataFrame:
    """(query_id, doc_id, score, rank, channels): the ranking of every question, with the score each stage gave or added."""
    asked = cut(an.read(queries, res))
    docs = cut(an.document_tokens(corpus.docs, "text", res).drop("text"))  # the texts are cut into words once
    vocabulary = ix.postings(ix.token_rows(docs, "doc_id", "tokens", tokens=F.col("tokens"))).groupBy("term").agg(F.count("*").alias("df"))
    terms = cut(an.terms(asked, vocabulary, corpus.lexicon, corpus.offences))
    post, stats = sc.query_tables(docs, "doc_id", "tokens", terms, tokens=F.col("tokens"), cosine=options.lexical == "tfidf")
    first = sc.tfidf(terms, post, stats) if options.lexical == "tfidf" else sc.bm25(terms, post, stats)
    lexical = sc.max_normal(restricted(first, docs, asked))
    channels = {"lexical": lexical}
    total = lexical
    pre = sc.qpp_pre(terms, stats, docs.agg(F.count("*").alias("n")))
    sure = pre.join(sc.qpp_post(sc.topk(lexical, 10)), "query_id").select("query_id", sc.confidence(F.col("max_idf"), F.col("gap")).alias("confidence"))
    if options.ngrams or corpus.dense is not None:
        q = ix.gram_rows(asked.select("query_id", "text"), "query_id", "text").withColumnRenamed("doc_id", "query_id")
        p = corpus.docs.select("doc_id", plain_words(F.col("text")).alias("_p"))
        grams = restricted(sc.gram_bm25(q, *sc.query_tables(p, "doc_id", "_p", q, 0.9, ngrams(F.col("_p"), 3))), docs, asked)
        channels["grams"] = grams = grams if options.ngrams else grams.limit(0)
        long = asked.where("n_words >= 50").select("query_id")
        of = lambda df, how: df.join(long, "query_id", how) if df is not None else None
        total = an.fuse_long(of(lexical, "left_semi"), of(grams, "left_semi"), of(corpus.dense, "left_semi"), sure).unionByName(
            an.fuse_short(of(lexical, "left_anti"), of(grams, "left_anti"), of(corpus.dense, "left_anti"), asked, sure)
        )
    if options.bridge and corpus.statutes is not None and corpus.cites is not None:
        law = an.document_tokens(corpus.statutes, "text", res)
        hits = sc.bm25(terms, *sc.query_tables(law, "doc_id", "tokens", terms, tokens=F.col("tokens")))
        channels["bridge"] = sc.bridge(hits, corpus.cites)
        total = sc.boosted(total, channels["bridge"])
    if options.authority and corpus.authority is not None:
        total = sc.net_score(total, corpus.authority)
    if corpus.penalties is not None:
        ranked = sc.topk(total, 1_000_000).join(corpus.penalties, "doc_id", "left")
        total = sc.demote(ranked, F.col("penalty")).select("query_id", "doc_id", "score")
    ranked = sc.topk(total, options.depth)
    if options.collapse and corpus.groups is not None:
        ranked = sc.collapse(ranked, corpus.groups, options.top_k)
    out = ranked.where(F.col("rank") <= options.top_k).select("query_id", "doc_id", "score", "rank")
    for name, rows in channels.items():
        rows = rows.select("query_id", "doc_id", F.col("boost" if name == "bridge" else "score").alias(name))
        out = out.join(rows, ["query_id", "doc_id"], "left")
    names = [F.lit(x) if i == 0 else F.col(n) for n in channels for i, x in enumerate((n, n))]
    return out.select("query_id", "doc_id", "score", "rank", F.map_filter(F.create_map(*names), lambda k, v: v.isNotNull()).alias("channels"))


def explain(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, reasons): in words, which channels found a hit."""
    said = {"lexical": "shares telling words", "grams": "shares phrases", "bridge": "cites the provisions the question is about"}
    reasons = F.array_compact(F.array(*[F.when(F.col("channels")[k].isNotNull(), F.lit(v)) for k, v in said.items()]))
    return hits.select("query_id", "doc_id", reasons.alias("reasons"))
