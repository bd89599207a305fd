"""Queries of the loaders, the composed search and the evaluation operators over the judgment tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.operators import agent as ag
from lexweave.operators import analyse as an
from lexweave.operators import engine as en
from lexweave.operators import experiments as ex
from lexweave.operators import index as ix
from lexweave.operators import score as sc
from lexweave.plans import search as se
from lexweave.sources import law
from lexweave.tables import spread, table

#: Stop words of the index.
STOP = frozenset("the of and a an to in is was for on that by with as at be or from this it are were which has had not he she his her they their its".split())


def engine_search(spark: SparkSession, folder: str) -> DataFrame:
    """The composed search of the evaluation items over all documents: filters, words and phrases, one document of a docket."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text", "state", "decision_date", "docket")).where("text is not null")
    docs = d.select("doc_id", "text", F.array(F.coalesce(F.lower("state"), F.lit("*"))).alias("states"), "decision_date")
    groups = d.where("docket is not null").select("doc_id", F.col("docket").alias("grp"))
    hits = en.search(en.Corpus(docs, groups=groups), se.items(spark, folder), an.Resources(STOP), ag.preset("interactive"))
    return hits.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def natural_cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The plain cosine baseline over all documents."""
    d = se.docs(spark, folder)
    post = ix.postings(ix.token_rows(d, "doc_id", "text"))
    stats = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(d.agg(F.count("*").alias("n"))))
    return se._round(sc.topk(ex.natural_cosine(sc.query_terms(se.items(spark, folder), "query_id", "text"), post, stats), 10), "score")


def recall_between(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the first twenty by BM25 the first twenty by tf-idf have."""
    a, b = (sc.topk(s, 20) for s in se.channels(spark, folder))
    return se._round(ex.recall_against(b, a), "recall")


def index_size(spark: SparkSession, folder: str) -> DataFrame:
    return ex.size_report(ix.postings(ix.token_rows(se.docs(spark, folder), "doc_id", "text")))


def balanced_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Five questions of each stated language, by the hash of their id."""
    q = table(spark, folder, "rag_questions").where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "lang")).alias("r"))
    return ex.balanced_sample(q.select(F.col("id").alias("query_id"), F.coalesce("r.lang", F.lit("")).alias("lang")), "lang", 5)


def natural_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every provision within its code, numbers before letters."""
    from pyspark.sql import Window

    s = table(spark, folder, "statutes").where("id is not null").select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("code"), F.split_part("id", F.lit(":"), F.lit(2)).alias("section")).distinct()
    return s.select("id", F.row_number().over(Window.partitionBy("code").orderBy(*law.natural(), "section")).alias("place"))


def _provisions(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "statutes").where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "provision_name", "text")).alias("r"))
    return s.select(F.col("id").alias("ref"), F.col("r.provision_name").alias("title"), F.concat_ws(" ", "r.text").alias("text"))


def statute_headings(spark: SparkSession, folder: str) -> DataFrame:
    """Provisions as documents: their heading paragraph and the number of paragraphs behind it."""
    return law.with_heading(_provisions(spark, folder)).select("doc_id", F.col("paragraphs")[0]["text"].alias("heading"), F.col("paragraphs")[0]["para_id"].alias("para_id"))


def provision_names(spark: SparkSession, folder: str) -> DataFrame:
    """Code, section and act as the provisions' names tell them."""
    got = _provisions(spark, folder).select("ref", law.provision_name(F.col("title"), {"vpc": "penal code", "vea": "evidence act"}).alias("p"))
    return got.select("ref", "p.code", "p.section", "p.act")


def cue_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of the judgments by the part their wording puts them in."""
    return law.cue_zones(se.paragraphs(spark, folder)).groupBy("zone").agg(F.count("*").alias("paragraphs"), F.count_distinct("doc_id").alias("docs"))


def store_snippets(spark: SparkSession, folder: str) -> DataFrame:
    return law.store_snippet(table(spark, folder, "documents").select("doc_id", "text").where("text is not null"))


def all_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Judgments, cases and provisions in one table, counted by kind; cases are not in the store."""
    kinds = (("precedents", "precedent"), ("query_cases", "query_case"), ("statutes", "statute"))
    parts = [table(spark, folder, t).where("id is not null").select(F.col("id").alias("doc_id"), F.lit(k).alias("doc_type")).distinct() for t, k in kinds]
    return law.doc_store(law.union_documents(*parts)).groupBy("doc_type").agg(F.count("*").alias("docs"))


def misspelled_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every evaluation item with a slip in its longest word."""
    return ex.typo_queries(table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), "text"))


_LAST = "s AS (SELECT id AS ref, max({'a': loaded_at, 'b': provision_name, 't': text}) AS r FROM statutes WHERE id IS NOT NULL GROUP BY id)"
_CUE = " ".join(f"WHEN regexp_matches(text, '{cue}') THEN '{zone}'" for zone, cue in law.CUES)
QUERIES = {
    f.__name__: f
    for f in (engine_search, natural_cosine_topk, recall_between, index_size, balanced_questions, natural_order, statute_headings, provision_names, cue_zones, store_snippets, all_documents, misspelled_questions)
}
SQL = {
    "natural_cosine_topk": f"""WITH {se.TOK}, w AS (SELECT term, doc_id, (1 + ln(tf)) * ln((1 + (SELECT n FROM n)) / (1.0 + df)) AS w FROM post JOIN stats USING (term)),
        nd AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM w GROUP BY 1), qq AS (SELECT query_id, term, (1 + ln(weight)) * ln((1 + (SELECT n FROM n)) / (1.0 + df)) AS qw FROM terms JOIN stats USING (term)),
        nq AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qq GROUP BY 1),
        s AS (SELECT query_id, doc_id, sum(w * qw) / (any_value(dn) * any_value(qn)) AS score FROM w JOIN qq USING (term) JOIN nd USING (doc_id) JOIN nq USING (query_id) WHERE dn > 0 AND qn > 0 GROUP BY 1, 2) {se.top('s')}""",
    "recall_between": f"""WITH {se.BM}{se.TF}, a AS ({se.top('bm', 20)}), b AS ({se.top('tf', 20)})
        SELECT a.query_id, round(count(b.doc_id) / count(*), 6) AS recall FROM a LEFT JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY 1""",
    "index_size": f"WITH {se.TOK} SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, count(*) AS postings FROM post",
    "balanced_questions": """WITH q AS (SELECT id AS query_id, coalesce(max({'a': loaded_at, 'l': lang}).l, '') AS lang FROM rag_questions WHERE id IS NOT NULL GROUP BY id)
        SELECT query_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(query_id), query_id) AS turn FROM q QUALIFY turn <= 5""",
    "natural_order": """WITH s AS (SELECT DISTINCT id, split_part(id, ':', 1) AS code, split_part(id, ':', 2) AS section FROM statutes WHERE id IS NOT NULL)
        SELECT id, row_number() OVER (PARTITION BY code ORDER BY TRY_CAST(regexp_extract(section, '^([0-9]+)', 1) AS INT) NULLS FIRST, regexp_extract(section, '^[0-9]+(.*)$', 1), section) AS place FROM s""",
    "statute_headings": f"WITH {_LAST} SELECT ref AS doc_id, 'Section ' || upper(split_part(ref, ':', 2)) || ' ' || upper(split_part(ref, ':', 1)) || '. ' || coalesce(r.b, '') AS heading, -1 AS para_id FROM s",
    "provision_names": f"""WITH {_LAST}, p AS (SELECT ref, lower(regexp_extract(r.b, '(?i)(?:section|article|rule)\\s+(\\d+[A-Za-z]*)', 1)) AS section, trim(regexp_extract(r.b, '(?i)\\bin\\s+(.+)$', 1)) AS act FROM s)
        SELECT ref, CASE WHEN lower(act) LIKE '%penal code%' THEN 'vpc' WHEN lower(act) LIKE '%evidence act%' THEN 'vea' WHEN act = '' THEN '?' ELSE replace(trim(regexp_replace(lower(act), '[^a-z0-9]+', ' ', 'g')), ' ', '-') END AS code,
        nullif(section, '') AS section, nullif(act, '') AS act FROM p""",
    "cue_zones": f"""WITH p0 AS (SELECT id AS doc_id, max({{'a': loaded_at, 't': text, 'r': rhetorical_roles}}).t AS t FROM precedents GROUP BY 1), p AS (SELECT doc_id, unnest(t) AS text, unnest(generate_series(1, len(t))) AS para FROM p0),
        c AS (SELECT doc_id, para, CASE {_CUE} END AS own FROM p WHERE text IS NOT NULL),
        z AS (SELECT doc_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'facts') AS zone FROM c)
        SELECT zone, count(*) AS paragraphs, count(DISTINCT doc_id) AS docs FROM z GROUP BY 1""",
    "store_snippets": r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substr(text, 1, 200), '\s+\S*\z', '…') END AS snippet FROM documents WHERE text IS NOT NULL",
    "all_documents": "SELECT 'precedent' AS doc_type, count(DISTINCT id) AS docs FROM precedents UNION ALL SELECT 'statute', count(DISTINCT id) FROM statutes",
}
