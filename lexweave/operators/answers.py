"""Answers from retrieved text: abstaining, chunking, extraction, checking claims and correcting them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.legal import quantities, section_mentions
from lexweave.functions.text import words

#: Where a sentence ends for extraction: an end mark, white space and a capital, not behind a short abbreviation.
SENTENCE = r"(?<!\b(?:[A-Z]|Mr|Dr|Smt|vs|v|No|Sec|Rs|Ext|cl)\.)(?<=[.!?])\s+(?=[A-Z\"“(\[])"


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE)


def cited(text: Column) -> Column:
    """The numbers of the sources a sentence cites."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def uncited(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\[\d+\]", ""))


def abstain(pre: DataFrame, post: DataFrame, least_idf: float = 0.3, flat: float = 0.02) -> DataFrame:
    """(query_id, abstains): no specific term, nothing found, or a flat head."""
    both = pre.join(post, "query_id", "left")
    return both.select("query_id", ((F.col("max_idf") < least_idf) | F.col("gap").isNull() | ((F.col("gap") < flat) & (F.col("spread") < flat))).alias("abstains"))


def coverage(terms: DataFrame, chunk_terms: DataFrame, idf: DataFrame, unseen: float = 3.0) -> DataFrame:
    """(query_id, coverage): the idf-weighted share of a query's terms that its best single chunk has."""
    w = terms.join(idf, "term", "left").select("query_id", "term", F.coalesce("idf", F.lit(unseen)).alias("w"))
    total = w.groupBy("query_id").agg(F.sum("w").alias("t"))
    hit = w.join(chunk_terms.select("query_id", "chunk", "term").distinct(), ["query_id", "term"]).groupBy("query_id", "chunk").agg(F.sum("w").alias("s"))
    best = hit.groupBy("query_id").agg(F.max("s").alias("s"))
    return total.join(best, "query_id", "left").select("query_id", (F.coalesce("s", F.lit(0.0)) / F.col("t")).alias("coverage"))


def clipped(text: Column, chars: int = 1200) -> Column:
    """A text cut at the last sentence end within its first characters."""
    head = F.substring(text, 1, chars)
    kept = F.regexp_extract(head, r"(?s)^(.*[.!?।۔])(?:\s|$)", 1)
    return F.when(F.length(text) <= chars, text).when(kept != "", kept).otherwise(head)


def chunks(paragraphs: DataFrame, terms: DataFrame, ranked: DataFrame, most: int = 8, chars: int = 1200) -> DataFrame:
    """(query_id, chunk, doc_id, para, text): the best paragraph of each of the best documents, ratio and decision first, cut at a sentence end."""
    p = ranked.join(paragraphs, "doc_id").withColumn("_w", F.array_distinct(words(F.col("text"))))
    q = terms.groupBy("query_id").agg(F.collect_set("term").alias("_q"))
    s = p.join(q, "query_id").withColumn("_s", F.size(F.array_intersect("_w", "_q")) + F.when(F.col("zone").isin("ratio", "decision"), 0.5).otherwise(0.0))
    one = s.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("_s"), "para"))).where("_r = 1")
    num = one.withColumn("chunk", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("chunk") <= most)
    return num.select("query_id", "chunk", "doc_id", "para", clipped(F.col("text"), chars).alias("text"))


def extractive(chunk_rows: DataFrame, terms: DataFrame, most: int = 4, chars: int = 240) -> DataFrame:
    """(query_id, n, sentence): the sentences that share most with the query, each with the number of its source."""
    rows = chunk_rows.select("query_id", "chunk", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    q = terms.groupBy("query_id").agg(F.collect_set("term").alias("_q"))
    got = rows.join(q, "query_id").withColumn("_s", F.size(F.array_intersect(F.array_distinct(words(F.col("s"))), "_q"))).where("_s > 0")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "chunk", "i"))
    short = F.when(F.length("s") > chars, F.concat(F.substring("s", 1, chars - 1), F.lit("…"))).otherwise(F.col("s"))
    return got.withColumn("n", n).where(F.col("n") <= most).select("query_id", "n", F.concat(short, F.lit(" ["), F.col("chunk").cast("string"), F.lit("]")).alias("sentence"))


def snippet(hits: DataFrame, paragraphs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, snippet): the two best sentences of a hit, in their order."""
    rows = hits.select("query_id", "doc_id").join(paragraphs, "doc_id").select("query_id", "doc_id", "para", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    q = terms.groupBy("query_id").agg(F.collect_set("term").alias("_q"))
    m = F.size(F.array_intersect(F.array_distinct(words(F.col("s"))), "_q"))
    got = rows.join(q, "query_id").withColumn("_s", m * m / F.size("_q"))
    r = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("_s"), "para", "i"))
    two = got.withColumn("_r", r).where("_r <= 2").groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("para", "i", "s"))).alias("x"))
    return two.select("query_id", "doc_id", F.array_join("x.s", " ").alias("snippet"))


def highlight(text: Column, terms: list[str], left: str = "<b>", right: str = "</b>") -> Column:
    return F.regexp_replace(text, "(?i)\\b(" + "|".join(map(re.escape, sorted(terms, key=len, reverse=True))) + ")\\b", f"{left}$1{right}") if terms else text


_NEGATION = re.compile(r"\b(?:not|no|never|nor|neither|cannot|without)\b", re.I)


def check_claim(sentence: str | None, source: str | None, least: float = 0.3) -> dict:
    """Whether a sentence is borne out by its source, and what is wrong with it otherwise."""
    s, src = re.sub(r"\s*\[\d+\]", "", sentence or ""), source or ""
    problems = []
    low = " ".join(src.lower().split())
    for q in re.findall(r"[\"“]([^\"”]{12,})[\"”]", s):
        if " ".join(q.lower().split()) not in low:
            problems.append("quotation")
    ws = set(re.findall(r"[a-z]{3,}", s.lower()))
    share = len(ws & set(re.findall(r"[a-z]{3,}", low))) / len(ws) if ws else 0.0
    if share < least:
        problems.append("support")
    have = [(q["unit"], q["value"]) for q in quantities(src)]
    if any((q["unit"], q["value"]) not in have for q in quantities(s)):
        problems.append("quantity")
    there = {(m["code"], m["section"]) for m in section_mentions(src)}
    for m in section_mentions(s):
        if (m["code"], m["section"]) not in there and ("?", m["section"]) not in there and not (m["code"] == "?" and any(n == m["section"] for _, n in there)):
            problems.append("section" if not any(n == m["section"] for _, n in there) else "code")
    best = max(re.split(r"(?<=[.!?])\s+", src), key=lambda x: len(ws & set(re.findall(r"[a-z]{3,}", x.lower()))), default="")
    if share >= least and len(_NEGATION.findall(s)) % 2 != len(_NEGATION.findall(best)) % 2:
        problems.append("negation")
    return {"supported": not problems, "share": share, "problems": sorted(set(problems)), "best": best or None}


CLAIM_TYPE = "supported boolean, share double, problems array<string>, best string"


def check_claims(claims: DataFrame) -> DataFrame:
    """(query_id, n, sentence, supported, share, problems, best) of rows (query_id, n, sentence, source)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = pd.DataFrame([check_claim(s, t) for s, t in zip(b["sentence"], b["source"])], columns=["supported", "share", "problems", "best"], index=b.index)
            yield b[["query_id", "n", "sentence"]].join(got)

    rows = claims.select(F.col("query_id").cast("string").alias("query_id"), F.col("n").cast("int").alias("n"), "sentence", "source")
    return rows.mapInPandas(run, f"query_id string, n int, sentence string, {CLAIM_TYPE}")


def corrected(checked: DataFrame) -> DataFrame:
    """(query_id, n, sentence, action): kept, replaced by the source's sentence, or removed."""
    fix = F.col("best").isNotNull() & (F.col("share") >= 0.3)
    action = F.when(F.col("supported"), "kept").when(fix, "replaced").otherwise("removed")
    return checked.select("query_id", "n", F.when(F.col("supported"), F.col("sentence")).when(fix, F.col("best")).alias("sentence"), action.alias("action"))
