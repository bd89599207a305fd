"""Queries of this subpackage over the judgment tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import abuse, canon, consensus, langid, leakage, neardup, packing, pieces, sentences
from lexweave.tables import spread, table


def last_delivery(df: DataFrame, key: str, at: str, *cols: str) -> DataFrame:
    """``key`` and ``cols`` of the last row of each key, ties settled by the columns' order."""
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *cols)).alias("_r"))
    return kept.select(key, *[f"_r.{c}" for c in cols])


#: Short forms of the words that name a kind of court, words that say nothing about which court is meant, words
#: for a provision, and words of an act's name that don't tell it from others.
COURT_SHORT = {"hc": "high court", "sc": "supreme court", "ct": "court", "highcourt": "high court", "apex": "supreme"}
COURT_FILLER = {"in", "the", "of", "at", "judicature", "honble", "bench", "appellate", "side", "for", "state"}
PROVISION = {"section", "sections", "sec", "s", "ss", "us", "u", "article", "art", "dhara", "anuchchhed", "under", "r", "w"}
ACT_FILLER = {"in", "the", "of", "and", "act", "code", "law"}


def court_matcher(listed: list[tuple]) -> Callable[[str], str]:
    return canon.court_matcher(listed, COURT_SHORT, COURT_FILLER)


def provision_matcher(listed: list[tuple]) -> Callable[[str], str]:
    return canon.provision_matcher(listed, PROVISION, ACT_FILLER)


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, rec_id, pos, value) of every entry of jurisdiction (pos -1) and relevant_statutes."""
    parts = []
    for t in ("precedents", "query_cases"):
        df = table(spark, folder, t)
        parts.append(df.select(F.lit(t).alias("tbl"), F.col("id").alias("rec_id"), F.lit(-1).alias("pos"), F.col("jurisdiction").alias("value")))
        parts.append(df.select(F.lit(t).alias("tbl"), F.col("id").alias("rec_id"), F.posexplode("relevant_statutes").alias("pos", "value")))
    return reduce(DataFrame.unionByName, parts).where("value is not null")


def p2_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every non-null value with the court or provision it means; ``exact`` tells values that are an entry as they stand."""
    courts = table(spark, folder, "courts").select("court_name", "name_pattern", "level").distinct()
    statutes = table(spark, folder, "statutes").select("id", "provision_name").distinct()
    values = p2_values(spark, folder)
    by_list = []
    for rows, build, entry, picked in (
        (courts, court_matcher, 0, values.where("pos < 0")),
        (statutes, provision_matcher, 1, values.where("pos >= 0")),
    ):
        listed = sorted(tuple(r) for r in rows.where(F.col(rows.columns[0]).isNotNull()).limit(canon.MAX_ENTRIES + 1).collect())
        by_list.append(canon.mapped(picked, listed, build, entry=entry))
    return by_list[0].unionByName(by_list[1])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values that are not an entry as they stand, with what they mean or ``unmatched``."""
    return p2_mapped(spark, folder).where("not exact").select("tbl", "rec_id", "pos", "ref_id").distinct()


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report of unmatched values with their number."""
    return p2_mapped(spark, folder).where(F.col("ref_id") == canon.UNMATCHED).groupBy("tbl", "value").agg(F.count("*").alias("n"))


def p3_labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Every text of the three tables with its language segments and their confidence."""
    parts = []
    for t in ("e6_jurisdiction", "rag_questions"):
        df = last_delivery(table(spark, folder, t).select("id", "loaded_at", "text", "lang"), "id", "loaded_at", "text", "lang")
        parts.append(df.select(F.lit(t).alias("tbl"), F.col("id").alias("rec_id"), "text", F.col("lang").alias("label")))
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    parts.append(docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), "text", F.col("lang").alias("label")))
    texts = reduce(DataFrame.unionByName, parts)
    trained = langid.train(langid.training_rows(docs.select("text", "lang"), "text", "lang"))
    return langid.labelled(texts, trained)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The languages present in every text whose label is missing or wrong."""
    return langid.wrong_labels(p3_labelled(spark, folder))


def p4_texts(spark: SparkSession, folder: str) -> list[tuple[str, DataFrame, str | None]]:
    """(table, texts, column that orders the deliveries of a key)."""
    docs = spread(table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    prec = spread(table(spark, folder, "precedents").select("id", "loaded_at", F.concat_ws(" ", "text").alias("text")))
    return [("documents", docs, None), ("precedents", prec, "loaded_at")]


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of texts that share half of their three-word sequences."""
    parts = [neardup.pairs(df, "id", "text", 3, 0.5, v).select(F.lit(t).alias("tbl"), "key_a", "key_b") for t, df, v in p4_texts(spark, folder)]
    return parts[0].unionByName(parts[1])


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class and links of every text, at five words and a similarity of 0.8."""
    parts = [neardup.groups(df, "id", "text", version=v, short=True).withColumn("tbl", F.lit(t)) for t, df, v in p4_texts(spark, folder)]
    return parts[0].unionByName(parts[1])


#: The labels of each judged table, in order.
P5_CLASSES = {
    "e9_procedure_temporal": ["0", "1", "2"],
    "e4_multilingual": ["0", "1", "2"],
    "treatment": ["followed", "doubted", "overruled", "other"],
}


def p5_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(tbl, unit, doc_id, judge, label): each judge's last valid label of each item."""
    parts = []
    for t, unit in (("e9_procedure_temporal", "query_id"), ("e4_multilingual", "unit_id")):
        df = table(spark, folder, t)
        doc = F.lower(F.trim(F.col("doc_id"))).alias("doc_id")
        label = F.when(F.col("grade").isin(0, 1, 2), F.col("grade").cast("string")).alias("label")
        parts.append(df.select(F.lit(t).alias("tbl"), F.col(unit).alias("unit"), doc, "judge", F.col("judged_at").alias("at"), label))
    df = table(spark, folder, "treatment")
    typed = F.regexp_replace(F.lower("label_treatment"), "[^a-z]", "")
    near = [F.when((typed == x) | ((F.length(typed) > 3) & (F.levenshtein(typed, F.lit(x)) <= 2)), F.lit(x)) for x in P5_CLASSES["treatment"]]
    parts.append(df.select(F.lit("treatment").alias("tbl"), F.col("id").alias("unit"), F.lit("").alias("doc_id"), F.col("annotator").alias("judge"), F.col("labelled_at").alias("at"), F.coalesce(*near).alias("label")))
    return consensus.last_valid(reduce(DataFrame.unionByName, parts))


def p5_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with its consensus label, confidence and agreement."""
    return consensus.fit(p5_ratings(spark, folder), P5_CLASSES)[0]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The consensus of the items whose judges disagree."""
    return p5_items(spark, folder).where("n_labels > 1").select("tbl", "unit", "doc_id", "label")


def p5_judges(spark: SparkSession, folder: str) -> DataFrame:
    """The reliability of every judge."""
    return consensus.reliability(consensus.fit(p5_ratings(spark, folder), P5_CLASSES)[1], P5_CLASSES)


def p5_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Observed and chance-corrected agreement of every table."""
    ratings = p5_ratings(spark, folder)
    return consensus.agreement(consensus.fit(ratings, P5_CLASSES, rounds=1)[0], ratings)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The end of every sentence unit of documents and treatment passages."""
    docs = spread(table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), "text"))
    passages = table(spark, folder, "treatment").select(F.lit("treatment").alias("tbl"), F.col("id").alias("rec_id"), F.col("sentence").alias("text")).distinct()
    texts = docs.unionByName(passages)
    return sentences.units(texts, sentences.train(sentences.training_texts(docs, "text")))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every oversized document and paragraph."""
    docs = table(spark, folder, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_id"), F.lit(0).alias("para"), "text")
    parts = [pieces.split(docs, 6000, 200)]
    for t in ("precedents", "query_cases"):
        df = table(spark, folder, t).select("id", "loaded_at", F.transform("text", lambda x, i: F.struct(i.cast("int").alias("para"), x.alias("text"))).alias("paras"))
        # only the oversized paragraphs of each delivery are moved to find the last one
        big = df.select("id", "loaded_at", F.filter("paras", lambda p: F.length(p["text"]) > 1500).alias("paras"))
        last = last_delivery(big, "id", "loaded_at", "paras").select(F.lit(t).alias("tbl"), F.col("id").alias("rec_id"), F.inline("paras"))
        parts.append(pieces.split(last, 1500, 100))
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The oversized items that were cut into pieces."""
    return p7_pieces(spark, folder).select("tbl", "rec_id", "para").distinct()


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document or part of one."""
    return packing.packed(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_packed(spark, folder))


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and the test items it contains, with extent and place."""
    return leakage.leaked(spread(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id").distinct()


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The abuse score of every document."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    windows, labels = abuse.training_windows(docs, "text")
    return abuse.scored(docs, abuse.fit(windows, labels))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rate of abusive texts per source."""
    return abuse.rates(p10_scores(spark, folder))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p2_found": p2_found, "p2_mapped": p2_mapped, "p2_unmatched": p2_unmatched, "p3_found": p3_found, "p3_labelled": p3_labelled, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_items": p5_items, "p5_judges": p5_judges, "p5_agreement": p5_agreement, "p6_found": p6_found, "p7_found": p7_found, "p7_pieces": p7_pieces, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found, "p9_leaks": p9_leaks}
SQL: dict[str, str] = {
    "p4_found": r"""
        WITH t AS (SELECT 'documents' AS tbl, CAST(doc_id AS VARCHAR) AS k, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
          UNION ALL SELECT 'precedents', id, max({'a': loaded_at, 't': coalesce(array_to_string(text, ' '), '')}).t FROM precedents WHERE id IS NOT NULL GROUP BY id),
        w AS (SELECT tbl, k, list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda x: regexp_replace(x, '^[\p{P}\p{S}]+|[\p{P}\p{S}]+$', '', 'g')), lambda x: x <> '') AS w FROM t),
        g AS (SELECT DISTINCT tbl, k, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT tbl, k, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
        n AS (SELECT tbl, k, count(*) AS n FROM g GROUP BY ALL),
        p AS (SELECT a.tbl, a.k AS key_a, b.k AS key_b, count(*) AS c FROM g a JOIN g b ON a.tbl = b.tbl AND a.g = b.g AND a.k < b.k GROUP BY ALL)
        SELECT p.tbl, key_a, key_b FROM p JOIN n x ON x.tbl = p.tbl AND x.k = key_a JOIN n y ON y.tbl = p.tbl AND y.k = key_b WHERE c >= 0.5 * (x.n + y.n - c)""",
    "p7_found": """
        SELECT 'documents' AS tbl, CAST(doc_id AS VARCHAR) AS rec_id, 0 AS para FROM documents WHERE length(text) > 6000
        UNION ALL SELECT tbl, id, CAST(i - 1 AS INTEGER) FROM (
          SELECT tbl, id, unnest(generate_series(1, len(t))) AS i, t FROM (
            SELECT 'precedents' AS tbl, id, max({'a': loaded_at, 'b': text}).b AS t FROM precedents GROUP BY id
            UNION ALL SELECT 'query_cases', id, max({'a': loaded_at, 'b': text}).b FROM query_cases GROUP BY id)) WHERE length(t[i]) > 1500""",
}
