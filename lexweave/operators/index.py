"""Inverted-index tables: postings, lengths, statistics, n-gram weights, tiers and champion lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import ngrams, plain_words, words
from lexweave.operators.order import numbered


def token_rows(docs: DataFrame, doc_id: str, text: str, extra: tuple[str, ...] = (), tokens: Column | None = None) -> DataFrame:
    """(doc_id, extra..., pos, term): one row per word, positions from 0."""
    toks = words(F.col(text)) if tokens is None else tokens
    return docs.select(F.col(doc_id).alias("doc_id"), *extra, F.posexplode(toks).alias("pos", "term"))


def postings(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, by..., tf): counts-only postings; partial counts combine before the shuffle."""
    return rows.groupBy("term", "doc_id", *by).agg(F.count("*").alias("tf"))


def positional(rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions)."""
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def doc_lengths(docs: DataFrame, doc_id: str, text: str, extra: tuple[str, ...] = (), tokens: Column | None = None) -> DataFrame:
    """(doc_id, extra..., len) without exploding."""
    toks = words(F.col(text)) if tokens is None else tokens
    return docs.select(F.col(doc_id).alias("doc_id"), *extra, F.coalesce(F.size(toks), F.lit(0)).cast("long").alias("len"))


def zone_lengths(rows: DataFrame) -> DataFrame:
    """(doc_id, zone, len) of the zones a document has."""
    return rows.groupBy("doc_id", "zone").agg(F.count("*").alias("len"))


def zone_offsets(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para, zone, start): the running word offset of each paragraph within its document."""
    before = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.size(words(F.col("text"))), F.lit(0))
    return paragraphs.select("doc_id", "para", "zone", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start"))


def idf_log10(n: Column, df: Column) -> Column:
    return F.log10(n / df)


def idf_bm25(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_stats(post: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf_log10, idf_bm25); ``n_docs`` is a one-row table (n)."""
    df = post.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    both = df.crossJoin(F.broadcast(n_docs))  # one row: the number of documents
    n = F.col("n").cast("double")
    return both.select("term", "df", idf_log10(n, F.col("df")).alias("idf_log10"), idf_bm25(n, F.col("df")).alias("idf_bm25"))


def length_norms(lengths: DataFrame, b: float, zone: str | None = None) -> DataFrame:
    """(doc_id, zone?, norm): 1 - b + b * len / average; the average is over the documents that have the zone."""
    keys = [zone] if zone else []
    avg = lengths.groupBy(*keys).agg(F.avg("len").alias("avg_len"))
    both = lengths.join(F.broadcast(avg), zone) if zone else lengths.crossJoin(F.broadcast(avg))
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.col("avg_len")
    return both.select("doc_id", *keys, F.when(F.col("avg_len") > 0, norm).otherwise(F.lit(1.0)).alias("norm"))


def gram_rows(docs: DataFrame, doc_id: str, text: str, n: int = 3) -> DataFrame:
    """(doc_id, gram) with repeats."""
    cut = docs.select(F.col(doc_id).alias("doc_id"), plain_words(F.col(text)).alias("_w"))  # once a text, not once a gram
    return cut.select("doc_id", F.explode(ngrams(F.col("_w"), n)).alias("term"))


def gram_lengths(docs: DataFrame, doc_id: str, text: str, n: int = 3) -> DataFrame:
    """(doc_id, len) in n-grams, zero for short documents, which count in the average."""
    size = F.greatest(F.size(plain_words(F.col(text))) - (n - 1), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(size, F.lit(0)).cast("long").alias("len"))


def gram_weights(grams: DataFrame, lengths: DataFrame, k1: float = 1.2, b: float = 0.9) -> DataFrame:
    """(term, doc_id, w): BM25 weights per cell, ready to be stored bucketed by term."""
    post = postings(grams)
    n = lengths.agg(F.count("*").alias("n"))
    stats = term_stats(post, n).select("term", "idf_bm25")
    cell = post.join(stats, "term").join(length_norms(lengths, b), "doc_id")
    w = F.col("idf_bm25") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * F.col("norm"))
    return cell.select("term", "doc_id", w.alias("w"))


def champions(post: DataFrame, authority: DataFrame, r: int) -> DataFrame:
    """(term, doc_id, rank): per term the ``r`` documents of highest tf * (1 + authority), ties by the larger id.

    The group limit runs before the shuffle, so a term that is in every document sends at most ``r`` rows per task.
    """
    scored = post.join(authority, "doc_id", "left").withColumn("s", F.col("tf") * (1 + F.coalesce("g", F.lit(0.0))))
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("s"), F.desc("doc_id")))
    return scored.select("term", "doc_id", rank.alias("rank")).where(F.col("rank") <= r)


def tier_one(authority: DataFrame, share: float) -> DataFrame:
    """(doc_id): the documents of positive authority that are in the top share, ties by the larger id."""
    n = authority.count()
    return numbered(authority.where("g > 0"), F.desc("g"), F.desc("doc_id")).where(F.col("position") <= int(round(share * n))).select("doc_id")
