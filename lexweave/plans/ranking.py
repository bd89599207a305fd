"""Queries that combine rankings, citations and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.operators import graph as gr
from lexweave.operators import learn as ln
from lexweave.operators import score as sc
from lexweave.operators import versions as vs
from lexweave.plans import relations as re_
from lexweave.plans import search as se
from lexweave.tables import table


def graph_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = gr.degrees(re_._edges(spark, folder))
    return d.agg(F.count("*").alias("nodes"), F.sum("out_degree").alias("edges"), F.count_if(F.col("in_degree") > 0).alias("cited"), F.round(F.avg("in_degree"), 6).alias("mean_in"))


def jurisdiction_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    """Citations between judgments that bind in one state, those that bind everywhere included."""
    nodes = re_._cases(spark, folder).where(F.arrays_overlap("states", F.array(F.lit("keshal"), F.lit("*")))).select("doc_id")
    return gr.induced(re_._edges(spark, folder), nodes)


def similar_cases(spark: SparkSession, folder: str) -> DataFrame:
    """0.6 coupling and 0.4 co-citation of the judgments whose id is divisible by 20."""
    f = table(spark, folder, "precedents").select(F.col("id").alias("doc_id"), F.explode("relevant_statute_ids").alias("r")).select("doc_id", F.lower(F.trim("r")).alias("ref")).where("ref <> ''")
    a = gr.coupling(f, re_._seeds(spark, folder)).select("query_id", "doc_id", (0.6 * F.col("score")).alias("s"))
    b = gr.cocitation(re_._edges(spark, folder), re_._seeds(spark, folder)).select("query_id", "doc_id", (0.4 * F.col("score")).alias("s"))
    return a.unionByName(b).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))


def judging_pool(spark: SparkSession, folder: str) -> DataFrame:
    """What two systems rank in their first ten, once."""
    a, b = (sc.topk(s, 10).select("query_id", "doc_id") for s in se.channels(spark, folder))
    return a.union(b).distinct()


def run_difference(spark: SparkSession, folder: str) -> DataFrame:
    """What only one of two systems ranks in its first ten."""
    a, b = (sc.topk(s, 10).select("query_id", "doc_id") for s in se.channels(spark, folder))
    return a.exceptAll(b).withColumn("only", F.lit("bm25")).union(b.exceptAll(a).withColumn("only", F.lit("tfidf")))


def short_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 words of a case's facts as a query, where there are at least twelve."""
    q = table(spark, folder, "query_cases").select("id", "loaded_at", "text").groupBy("id").agg(F.max(F.struct("loaded_at", "text")).alias("r"))
    w = F.split(F.trim(F.regexp_replace(F.array_join("r.text", " "), r"\[MASK\]|\s+", " ")), " +")
    return q.select("id", w.alias("w")).where(F.size("w") >= 12).select("id", F.array_join(F.slice("w", 1, 40), " ").alias("text"))


def learned_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The weighted sum of three normalised channels."""
    bm25, tfidf = se.channels(spark, folder)
    f = ln.feature_table({"bm25": bm25, "tfidf": tfidf, "grams": se.gram_scores(spark, folder)})
    return se._round(sc.topk(sc.linear(f, {"bm25": 0.5, "tfidf": 0.2, "grams": 0.3}), 10), "score")


def latest_judgments(spark: SparkSession, folder: str) -> DataFrame:
    """The last grade of every judge for every pair, by aggregation so that a hot document is no single task."""
    e = table(spark, folder, "e9_procedure_temporal").where("grade is not null")
    last = e.groupBy("query_id", F.lower(F.trim("doc_id")).alias("doc_id"), "judge").agg(F.max(F.struct("judged_at", "grade")).alias("r"))
    return last.select("query_id", "doc_id", "judge", F.col("r.grade").alias("grade"))


def strong_disagreements(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose valid grades lie two apart."""
    e = table(spark, folder, "e9_procedure_temporal").where("grade in (0, 1, 2)")
    by = e.groupBy("query_id", F.lower(F.trim("doc_id")).alias("doc_id")).agg(F.min("grade").alias("low"), F.max("grade").alias("high"))
    return by.where("high - low >= 2")


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    """An annotation sheet: five passages of each cue, by the hash of their id."""
    t = table(spark, folder, "treatment").where("id is not null").select("id", "system_cue").distinct()
    r = F.row_number().over(Window.partitionBy("system_cue").orderBy(F.md5("id"), "id"))
    return t.withColumn("r", r).where("r <= 5").select("id", "system_cue")


def _section_offence(spark: SparkSession, folder: str) -> DataFrame:
    """The two penal codes' provisions of equal number stand for one offence."""
    s = table(spark, folder, "statutes").where("id rlike '^(vpc|vds):'").select(F.col("id").alias("ref")).distinct()
    return s.select("ref", F.concat(F.lit("off:"), F.regexp_extract("ref", r":(\d+)", 1)).alias("offence_id"))


def cited_offences(spark: SparkSession, folder: str) -> DataFrame:
    """Offences behind the provisions that judgments cite, whatever code they cite."""
    cites = re_._cases(spark, folder).select("doc_id", F.explode("cites").alias("ref"))
    return vs.offences(cites, _section_offence(spark, folder)).groupBy("offence_id").agg(F.count_distinct("doc_id").alias("docs"), F.round(F.sum("weight"), 6).alias("weight"))


def section_equivalents(spark: SparkSession, folder: str) -> DataFrame:
    return vs.equivalents(_section_offence(spark, folder))


_OFF = "so AS (SELECT DISTINCT id AS ref, 'off:' || regexp_extract(id, ':([0-9]+)', 1) AS offence_id FROM statutes WHERE regexp_matches(id, '^(vpc|vds):'))"
_RUN2 = f"WITH {se.BM}{se.TF}, a AS ({se.top('bm')}), b AS ({se.top('tf')})"
QUERIES = {f.__name__: f for f in (graph_stats, jurisdiction_subgraph, similar_cases, judging_pool, run_difference, short_queries, learned_ranking, latest_judgments, strong_disagreements, stratified_sample, cited_offences, section_equivalents)}
SQL = {
    "cited_offences": f"""{re_._CASES}, {_OFF}, ci AS (SELECT doc_id, unnest(cites) AS ref FROM c), u AS (SELECT doc_id, CASE WHEN ref IN (SELECT ref FROM so) THEN ref ELSE regexp_replace(ref, '^([^:]+:[0-9]+).*$', '\\1') END AS ref FROM ci)
        SELECT offence_id, count(DISTINCT doc_id) AS docs, round(sum(1.0 / k), 6) AS weight FROM u JOIN (SELECT *, count(*) OVER (PARTITION BY ref) AS k FROM so) USING (ref) GROUP BY 1""",
    "section_equivalents": f"WITH {_OFF} SELECT DISTINCT a.ref, b.ref AS other FROM so a JOIN so b USING (offence_id) WHERE split_part(a.ref, ':', 1) <> split_part(b.ref, ':', 1)",
    "graph_stats": f"{re_._EDGES}, d AS (SELECT doc_id, sum(i) AS i, sum(o) AS o FROM (SELECT dst AS doc_id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1) SELECT count(*) AS nodes, CAST(sum(o) AS BIGINT) AS edges, count(*) FILTER (i > 0) AS cited, round(avg(i), 6) AS mean_in FROM d",
    "jurisdiction_subgraph": f"{re_._CASES}, {re_._EDGES[5:]}, n AS (SELECT doc_id FROM c WHERE list_has_any(states, ['keshal', '*'])) SELECT * FROM e WHERE src IN (SELECT doc_id FROM n) AND dst IN (SELECT doc_id FROM n)",
    "similar_cases": f"""{re_._EDGES}, d AS (SELECT dst, count(*) AS n FROM e GROUP BY 1), x AS (SELECT q.dst AS query_id, o.dst AS doc_id, count(*) AS n FROM e q JOIN e o ON q.src = o.src AND q.dst <> o.dst WHERE TRY_CAST(substr(q.dst, 2) AS INT) % 20 = 0 GROUP BY 1, 2),
        co AS (SELECT query_id, doc_id, 0.4 * (x.n / sqrt(a.n * b.n)) AS s FROM x JOIN d a ON a.dst = query_id JOIN d b ON b.dst = doc_id),
        f AS (SELECT DISTINCT doc_id, ref FROM (SELECT id AS doc_id, lower(trim(unnest(relevant_statute_ids))) AS ref FROM precedents) WHERE ref <> ''), fs AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
        y AS (SELECT q.doc_id AS query_id, o.doc_id, count(*) AS c FROM f q JOIN f o ON q.ref = o.ref AND q.doc_id <> o.doc_id WHERE TRY_CAST(substr(q.doc_id, 2) AS INT) % 20 = 0 GROUP BY 1, 2),
        cu AS (SELECT query_id, y.doc_id, 0.6 * (c / (a.n + b.n - c)) AS s FROM y JOIN fs a ON a.doc_id = query_id JOIN fs b ON b.doc_id = y.doc_id)
        SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM co UNION ALL SELECT * FROM cu) GROUP BY 1, 2""",
    "judging_pool": f"{_RUN2} SELECT query_id, doc_id FROM a UNION SELECT query_id, doc_id FROM b",
    "run_difference": f"{_RUN2}, x AS (SELECT query_id, doc_id FROM a EXCEPT SELECT query_id, doc_id FROM b), y AS (SELECT query_id, doc_id FROM b EXCEPT SELECT query_id, doc_id FROM a) SELECT *, 'bm25' AS only FROM x UNION ALL SELECT *, 'tfidf' FROM y",
    "short_queries": r"""WITH l AS (SELECT id, max({'a': loaded_at, 't': text}).t AS t FROM query_cases GROUP BY 1), w AS (SELECT id, regexp_split_to_array(trim(regexp_replace(array_to_string(t, ' '), '\[MASK\]|\s+', ' ', 'g')), ' +') AS w FROM l)
        SELECT id, array_to_string(w[1:40], ' ') AS text FROM w WHERE len(w) >= 12""",
    "learned_ranking": f"""WITH {se.BM}{se.TF}{se.GRAM}, x AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS a FROM bm), y AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS b FROM tf), z AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS c FROM gram),
        m AS (SELECT query_id, doc_id, 0.5 * coalesce(a, 0) + 0.2 * coalesce(b, 0) + 0.3 * coalesce(c, 0) AS score FROM x FULL JOIN y USING (query_id, doc_id) FULL JOIN z USING (query_id, doc_id)) {se.top('m')}""",
    "latest_judgments": "SELECT query_id, lower(trim(doc_id)) AS doc_id, judge, max({'a': judged_at, 'g': grade}).g AS grade FROM e9_procedure_temporal WHERE grade IS NOT NULL GROUP BY 1, 2, 3",
    "strong_disagreements": "SELECT query_id, lower(trim(doc_id)) AS doc_id, min(grade) AS low, max(grade) AS high FROM e9_procedure_temporal WHERE grade IN (0, 1, 2) GROUP BY 1, 2 HAVING max(grade) - min(grade) >= 2",
    "stratified_sample": "SELECT id, system_cue FROM (SELECT DISTINCT id, system_cue FROM treatment WHERE id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY system_cue ORDER BY md5(id), id) <= 5",
}
