"""Queries of predicates, corpus transforms, graphs and evaluation over the judgment tables."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import evaluate as ev
from lexweave.operators import graph as gr
from lexweave.operators import index as ix
from lexweave.operators import predicates as pr
from lexweave.plans import search as se
from lexweave.tables import table


def _pos(spark: SparkSession, folder: str) -> DataFrame:
    return ix.token_rows(se.docs(spark, folder), "doc_id", "text")


def _tree(query: str):
    return pr.parse(query).tree


def phrase_match(spark: SparkSession, folder: str) -> DataFrame:
    return pr.phrase(_pos(spark, folder), ["of", "the", "deceased"])


def proximity_k(spark: SparkSession, folder: str) -> DataFrame:
    return pr.evaluate(_tree("police /5 recovered"), _pos(spark, folder), se.docs(spark, folder))


def boolean_cnf(spark: SparkSession, folder: str) -> DataFrame:
    wanted = spark.createDataFrame([("q1", 0, "murder"), ("q1", 0, "dacoity"), ("q1", 1, "knife"), ("q1", 1, "spade"), ("q2", 0, "extortion"), ("q2", 1, "ledger"), ("q2", 2, "bail")], "query_id string, clause int, term string")
    return pr.clauses(_pos(spark, folder), wanted)


def boolean_tree(spark: SparkSession, folder: str) -> DataFrame:
    return pr.evaluate(_tree('("boundary wall" OR extortion) AND knife AND NOT murder'), _pos(spark, folder), se.docs(spark, folder))


def boolean_not(spark: SparkSession, folder: str) -> DataFrame:
    return pr.evaluate(_tree("NOT the"), _pos(spark, folder), se.docs(spark, folder))


def wildcard_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The most frequent terms a pattern expands to."""
    post = ix.postings(_pos(spark, folder)).where(F.col("term").like("extort%") | F.col("term").like("%order") | F.col("term").like("mur%er"))
    return post.groupBy("term").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(30)


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, states, cites, date) of the last delivery of every precedent; the state comes from a court's exact name."""
    p = table(spark, folder, "precedents").select("id", "loaded_at", "jurisdiction", "relevant_statute_ids", "date")
    last = p.groupBy("id").agg(F.max(F.struct("loaded_at", "jurisdiction", "relevant_statute_ids", "date")).alias("r")).select(F.col("id").alias("doc_id"), "r.*")
    courts = table(spark, folder, "courts").select(F.col("court_name").alias("jurisdiction"), F.split("states", ";").alias("states"))
    date = F.try_to_date(F.substring("date", 1, 10), "yyyy-MM-dd")
    return last.join(courts, "jurisdiction", "left").select("doc_id", "states", F.coalesce("relevant_statute_ids", F.array().cast("array<string>")).alias("cites"), date.alias("date"))


def facet_filter(spark: SparkSession, folder: str) -> DataFrame:
    return pr.facets(table(spark, folder, "documents"), {"doc_type": "order", "state": "varnapur", "source": None}).select("doc_id")


def date_range_filter(spark: SparkSession, folder: str) -> DataFrame:
    return pr.facets(_cases(spark, folder), after="2010", before="2014-06-30").select("doc_id", "date")


def state_or_everywhere(spark: SparkSession, folder: str) -> DataFrame:
    return pr.facets(_cases(spark, folder), states=["keshal", "anvadi"]).select("doc_id")


def era_membership(spark: SparkSession, folder: str) -> DataFrame:
    cases = _cases(spark, folder)
    return cases.select("doc_id", pr.era_of(F.col("cites"), ["vds", "vps", "vsa"], ["vpc", "vcp", "vea"]).alias("era"), tx.code_in_force(F.col("date"), "2015-01-01").alias("code"))


def era_detection(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "rag_questions").where("text is not null").select("id", "text").distinct()
    return q.select("id", tx.era(F.col("text"), r"\b(sanhita|vds|vps|vsa)\b", r"\b(penal code|vpc|vcp|evidence act)\b").alias("era"), pr.case_query(F.col("text")).alias("is_case"))


def paragraph_split(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of every document: blank lines, or a line that begins with a number."""
    parts = F.split("text", r"\n\s*\n|\n(?=\d{1,3}\. )")
    rows = se.docs(spark, folder).select("doc_id", F.posexplode(parts).alias("para", "t")).where(F.trim("t") != "")
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.length("t")).alias("longest"))


def zone_carry_forward(spark: SparkSession, folder: str) -> DataFrame:
    """The zone of every paragraph; those without a label keep the one before."""
    z = F.when(F.col("zone") != "other", F.col("zone"))
    w = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    return se.paragraphs(spark, folder).select("doc_id", "para", F.coalesce(F.last(z, ignorenulls=True).over(w), F.lit("other")).alias("zone"))


def court_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The first court whose pattern occurs in a judgment's jurisdiction, by the order of the list's names; distinct values are matched once."""
    c = table(spark, folder, "courts").select("court_name", "name_pattern", "level")
    v = table(spark, folder, "precedents").select("jurisdiction").where("jurisdiction is not null").distinct()
    hit = v.join(F.broadcast(c), F.rlike(F.lower("jurisdiction"), F.col("name_pattern")))  # a fixed list of 26 patterns
    return hit.groupBy("jurisdiction").agg(F.min_by("court_name", F.struct(-F.length("name_pattern"), "court_name")).alias("court_name"))


def corpus_report(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.groupBy("doc_type", "source").agg(F.count("*").alias("docs"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("docket").isNull()).alias("no_docket"), F.sum(F.length("text")).alias("chars"))


def grouping_sets_report(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_type", "state", F.length("text").alias("n"))
    return spark.sql("SELECT doc_type, state, count(*) AS docs, sum(n) AS chars, CAST(grouping_id(doc_type, state) AS BIGINT) AS level FROM {d} GROUP BY GROUPING SETS ((doc_type, state), (doc_type), (state), ())", d=d)


def citation_shift_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Share of judgments loaded in a month that cite new, old or both codes."""
    p = table(spark, folder, "precedents").select("loaded_at", F.coalesce("relevant_statute_ids", F.array().cast("array<string>")).alias("c"))
    new = F.exists("c", lambda r: F.split_part(F.lower(F.trim(r)), F.lit(":"), F.lit(1)).isin("vds", "vps", "vsa"))
    old = F.exists("c", lambda r: F.split_part(F.lower(F.trim(r)), F.lit(":"), F.lit(1)).isin("vpc", "vcp", "vea"))
    share = lambda x: F.round(F.avg(F.when(x, 1.0).otherwise(0.0)), 6)
    return p.groupBy(F.date_format("loaded_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("docs"), share(new).alias("new"), share(old).alias("old"), share(new & old).alias("both"))


def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Decade and code counts over the judgments."""
    c = _cases(spark, folder)
    decade = c.select(F.lit("decade").alias("facet"), (F.floor(F.year("date") / 10) * 10).cast("string").alias("value"))
    code = c.select("doc_id", F.explode("cites").alias("r")).select("doc_id", F.split_part("r", F.lit(":"), F.lit(1)).alias("value")).distinct().select(F.lit("code").alias("facet"), "value")
    return decade.union(code).where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


# --- graphs -------------------------------------------------------------------------------------------------------------


def _cites(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "precedents").select(F.col("id").alias("src"), F.explode("relevant_precedent_ids").alias("d"))
    return p.select("src", F.upper(F.trim("d")).alias("dst"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return gr.edges(_cites(spark, folder), table(spark, folder, "precedents").select(F.col("id").alias("doc_id")))


def citation_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


def degree_stats(spark: SparkSession, folder: str) -> DataFrame:
    return gr.degrees(_edges(spark, folder))


def _seeds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "precedents").where("try_cast(substring(id, 2) as int) % 20 = 0").select(F.col("id").alias("doc_id")).distinct()


def cocitation(spark: SparkSession, folder: str) -> DataFrame:
    return gr.cocitation(_edges(spark, folder), _seeds(spark, folder)).withColumn("score", F.round("score", 6))


def coupling_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    f = table(spark, folder, "precedents").select(F.col("id").alias("doc_id"), F.explode("relevant_statute_ids").alias("r")).select("doc_id", F.lower(F.trim("r")).alias("ref")).where("ref <> ''")
    return gr.coupling(f, _seeds(spark, folder)).withColumn("score", F.round("score", 6))


def pagerank_fixed(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "precedents").select(F.col("id").alias("doc_id"))
    return gr.pagerank(nodes, _edges(spark, folder), rounds=5).select("doc_id", F.round(F.col("rank") * 1000, 6).alias("rank"))


def components(spark: SparkSession, folder: str) -> DataFrame:
    return gr.components(_edges(spark, folder), "src", "dst")


# --- evaluation ---------------------------------------------------------------------------------------------------------


def _qrels(spark: SparkSession, folder: str) -> DataFrame:
    """The rounded mean grade of every judged pair."""
    e = table(spark, folder, "e9_procedure_temporal").where("grade in (0, 1, 2)")
    return e.groupBy("query_id", F.lower(F.trim("doc_id")).alias("doc_id")).agg(F.floor(F.avg("grade") + 0.5).cast("int").alias("grade"))


def _judge_run(spark: SparkSession, folder: str, judge: str) -> DataFrame:
    """One judge's grades as a ranking of each query, ties by the larger id."""
    e = table(spark, folder, "e9_procedure_temporal").where((F.col("judge") == judge) & F.col("grade").isin(0, 1, 2))
    s = e.groupBy("query_id", F.lower(F.trim("doc_id")).alias("doc_id")).agg(F.max("grade").alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))))


def metrics_at_k(spark: SparkSession, folder: str) -> DataFrame:
    got = ev.per_query(_judge_run(spark, folder, "team-01"), _qrels(spark, folder), (1, 5))
    return got.select("query_id", *[F.round(c, 6).alias(c) for c in got.columns if c != "query_id"])


def map_mrr(spark: SparkSession, folder: str) -> DataFrame:
    got = ev.macro(ev.per_query(_judge_run(spark, folder, "team-01"), _qrels(spark, folder), (1, 5)))
    return got.select("queries", F.round("ap", 6).alias("map"), F.round("rr", 6).alias("mrr"), F.round("ndcg_5", 6).alias("ndcg_5"))


def best_k(spark: SparkSession, folder: str) -> DataFrame:
    return ev.best_k(_judge_run(spark, folder, "team-01"), _qrels(spark, folder)).withColumn("f1", F.round("f1", 6))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "e4_multilingual").where("grade in (0, 1, 2)").groupBy("unit_id", F.lower(F.trim("doc_id")).alias("d"), "judge").agg(F.max("grade").alias("g"))
    side = lambda c: e.select("unit_id", "d", F.col("judge").alias(f"judge_{c}"), F.col("g").alias(c))
    return side("a").join(side("b"), ["unit_id", "d"]).where("judge_a < judge_b")  # an item has at most as many rows as judges


def kappa_judges(spark: SparkSession, folder: str) -> DataFrame:
    got = ev.kappa(_pairs(spark, folder), by=("judge_a", "judge_b"))
    return got.withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder)
    got = ev.confusion(p, F.col("a") > 0, F.col("b") > 0)
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "macro_f1")})


def auc_midrank(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.length("text").alias("s"), (F.col("doc_type") == "judgment").alias("y")).where("s is not null and y is not null")
    return ev.auc(d, "s", "y").withColumn("auc", F.round("auc", 6))


def holm_adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Judges' rates of grade 2 as test values, adjusted."""
    t = table(spark, folder, "e4_multilingual").where("grade in (0, 1, 2)").groupBy(F.col("judge").alias("name")).agg(F.round(F.avg((F.col("grade") == 2).cast("int")) / 10, 6).alias("p"))
    return ev.holm(t).withColumn("p_holm", F.round("p_holm", 6))


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rag_questions").select("id", ev.hash_split(F.col("id")).alias("part")).distinct()


def cache_reuse_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    """Share of judged requests whose document was asked for before, by month."""
    e = table(spark, folder, "e9_procedure_temporal").select(F.lower(F.trim("doc_id")).alias("d"), "judged_at", "query_id", "judge")
    first = e.groupBy("d").agg(F.min(F.struct("judged_at", "query_id", "judge")).alias("f"))  # combines map-side, unlike a window over a hot document
    seen = e.join(first, "d").withColumn("again", F.struct("judged_at", "query_id", "judge") > F.col("f"))
    return seen.groupBy(F.date_format("judged_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("requests"), F.round(F.avg(F.col("again").cast("int")), 6).alias("reused"))


_W = se.W
_P = f"WITH p AS (SELECT doc_id, unnest(w) AS term, unnest(generate_series(0, len(w) - 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents WHERE text IS NOT NULL))"
_PH = lambda ts: "SELECT doc_id, CAST(pos AS INT) AS pos FROM (" + " UNION ALL ".join(f"SELECT doc_id, pos - {i} AS pos, {i} AS o FROM p WHERE term = '{t}'" for i, t in enumerate(ts)) + f") GROUP BY 1, 2 HAVING count(DISTINCT o) = {len(ts)}"
_CASES = """WITH l AS (SELECT id AS doc_id, max({'a': loaded_at, 'j': jurisdiction, 's': relevant_statute_ids, 'd': date}) AS r FROM precedents GROUP BY 1),
c AS (SELECT doc_id, string_split(states, ';') AS states, coalesce(r.s, []) AS cites, CASE WHEN regexp_full_match(left(r.d, 10), '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(left(r.d, 10) AS DATE) END AS date FROM l LEFT JOIN courts ON r.j = court_name)"""
_EDGES = """WITH ci AS (SELECT id AS src, upper(trim(unnest(relevant_precedent_ids))) AS dst FROM precedents),
e AS (SELECT src, dst, count(*) AS weight FROM ci WHERE src <> dst AND dst IN (SELECT id FROM precedents) GROUP BY 1, 2)"""
_QR = """WITH qr AS (SELECT query_id, lower(trim(doc_id)) AS doc_id, CAST(floor(avg(grade) + 0.5) AS INT) AS grade FROM e9_procedure_temporal WHERE grade IN (0, 1, 2) GROUP BY 1, 2),
rs AS (SELECT query_id, lower(trim(doc_id)) AS doc_id, max(grade) AS score FROM e9_procedure_temporal WHERE judge = 'team-01' AND grade IN (0, 1, 2) GROUP BY 1, 2),
run AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM rs),
rel AS (SELECT * FROM qr WHERE grade > 0), nr AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
j AS (SELECT run.query_id, run.doc_id, rank, n, coalesce(rel.grade, 0) AS grade FROM run JOIN nr USING (query_id) LEFT JOIN rel ON rel.query_id = run.query_id AND rel.doc_id = run.doc_id),
j2 AS (SELECT *, sum(CAST(grade > 0 AS INT)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS prec, (2 ** grade - 1) / log2(rank + 1) AS gain FROM j),
ip AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM rel),
idl AS (SELECT query_id, any_value(n) AS n, sum(CASE WHEN i <= 1 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS i1, sum(CASE WHEN i <= 5 THEN (2 ** grade - 1) / log2(i + 1) ELSE 0 END) AS i5 FROM ip JOIN nr USING (query_id) GROUP BY 1),
got AS (SELECT query_id, sum(CASE WHEN grade > 0 THEN prec ELSE 0 END) / any_value(n) AS ap, coalesce(1 / min(CASE WHEN grade > 0 THEN rank END), 0) AS rr,
  sum(CAST(grade > 0 AND rank <= 1 AS INT)) AS h1, sum(CAST(grade > 0 AND rank <= 5 AS INT)) AS h5, sum(CASE WHEN rank <= 1 THEN gain ELSE 0 END) AS d1, sum(CASE WHEN rank <= 5 THEN gain ELSE 0 END) AS d5 FROM j2 GROUP BY 1),
m AS (SELECT query_id, coalesce(ap, 0) AS ap, coalesce(rr, 0) AS rr, coalesce(h1, 0) / 1.0 AS p_1, coalesce(h1, 0) / n AS r_1, coalesce(h5, 0) / 5.0 AS p_5, coalesce(h5, 0) / n AS r_5, coalesce(d1, 0) / i1 AS ndcg_1, coalesce(d5, 0) / i5 AS ndcg_5 FROM idl LEFT JOIN got USING (query_id))"""
_R6 = lambda *cs: ", ".join(f"round({c}, 6) AS {c}" for c in cs)
_F1 = lambda k: f"round(CASE WHEN p_{k} + r_{k} > 0 THEN 2 * p_{k} * r_{k} / (p_{k} + r_{k}) ELSE 0 END, 6) AS f1_{k}"
_PAIRS = """WITH g AS (SELECT unit_id, lower(trim(doc_id)) AS d, judge, max(grade) AS g FROM e4_multilingual WHERE grade IN (0, 1, 2) GROUP BY 1, 2, 3),
pa AS (SELECT x.judge AS judge_a, y.judge AS judge_b, x.g AS a, y.g AS b FROM g x JOIN g y USING (unit_id, d) WHERE x.judge < y.judge)"""


def _pagerank_sql(rounds: int) -> str:
    out = _EDGES + """, nd AS (SELECT DISTINCT id AS doc_id FROM precedents), nn AS (SELECT count(*) AS n FROM nd), ew AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS w FROM e),
    r0 AS (SELECT doc_id, 1.0 / n AS rank, doc_id NOT IN (SELECT src FROM e) AS dg FROM nd, nn)"""
    for i in range(rounds):
        out += f""", r{i + 1} AS (SELECT doc_id, 0.15 / n + 0.85 * (coalesce(got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE dg) / n) AS rank, dg FROM r{i} LEFT JOIN
        (SELECT dst, sum(rank * w) AS got FROM ew JOIN r{i} ON doc_id = src GROUP BY 1) ON dst = doc_id, nn)"""
    return f"{out} SELECT doc_id, round(rank * 1000, 6) AS rank FROM r{rounds}"


QUERIES = {
    f.__name__: f
    for f in (
        phrase_match, proximity_k, boolean_cnf, boolean_tree, boolean_not, wildcard_terms, facet_filter, date_range_filter, state_or_everywhere, era_membership, era_detection, paragraph_split,
        zone_carry_forward, court_lookup, corpus_report, grouping_sets_report, citation_shift_monthly, facet_counts, citation_edges, degree_stats, cocitation, coupling_jaccard, pagerank_fixed, components,
        metrics_at_k, map_mrr, best_k, kappa_judges, confusion_metrics, auc_midrank, holm_adjust, hash_split, cache_reuse_first_seen,
    )
}
SQL = {
    "phrase_match": f"{_P} {_PH(['of', 'the', 'deceased'])}",
    "proximity_k": f"{_P} SELECT DISTINCT a.doc_id FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'police' AND b.term = 'recovered' AND abs(a.pos - b.pos) <= 5",
    "boolean_cnf": f"""{_P}, t AS (SELECT DISTINCT doc_id, term FROM p), c AS (SELECT * FROM (VALUES ('q1', 0, 'murder'), ('q1', 0, 'dacoity'), ('q1', 1, 'knife'), ('q1', 1, 'spade'), ('q2', 0, 'extortion'), ('q2', 1, 'ledger'), ('q2', 2, 'bail')) v(query_id, clause, term))
        SELECT query_id, doc_id FROM c JOIN t USING (term) GROUP BY 1, 2 HAVING count(DISTINCT clause) = (SELECT count(DISTINCT clause) FROM c x WHERE x.query_id = c.query_id)""",
    "boolean_tree": f"""{_P}, b AS ({_PH(['boundary', 'wall'])}) SELECT DISTINCT doc_id FROM documents WHERE (doc_id IN (SELECT doc_id FROM b) OR doc_id IN (SELECT doc_id FROM p WHERE term = 'extortion'))
        AND doc_id IN (SELECT doc_id FROM p WHERE term = 'knife') AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'murder')""",
    "boolean_not": f"{_P} SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'the')",
    "wildcard_terms": f"{_P} SELECT term, count(DISTINCT doc_id) AS df FROM p WHERE term LIKE 'extort%' OR term LIKE '%order' OR term LIKE 'mur%er' GROUP BY 1 ORDER BY df DESC, term LIMIT 30",
    "facet_filter": "SELECT doc_id FROM documents WHERE doc_type = 'order' AND state = 'varnapur'",
    "date_range_filter": f"{_CASES} SELECT doc_id, date FROM c WHERE date BETWEEN DATE '2010-01-01' AND DATE '2014-06-30'",
    "state_or_everywhere": f"{_CASES} SELECT doc_id FROM c WHERE list_has_any(states, ['keshal', 'anvadi', '*'])",
    "era_membership": f"""{_CASES}, x AS (SELECT doc_id, date, list_transform(cites, lambda r: split_part(r, ':', 1)) AS k FROM c)
        SELECT doc_id, CASE WHEN list_has_any(k, ['vds', 'vps', 'vsa']) THEN 'new' WHEN list_has_any(k, ['vpc', 'vcp', 'vea']) THEN 'old' END AS era, CASE WHEN date IS NULL THEN '?' WHEN date >= DATE '2015-01-01' THEN 'new' ELSE 'old' END AS code FROM x""",
    "era_detection": r"""WITH q AS (SELECT DISTINCT id, text, regexp_matches(lower(text), '\b(sanhita|vds|vps|vsa)\b') AS n, regexp_matches(lower(text), '\b(penal code|vpc|vcp|evidence act)\b') AS o FROM rag_questions WHERE text IS NOT NULL)
        SELECT id, CASE WHEN n AND NOT o THEN 'new' WHEN o AND NOT n THEN 'old' END AS era, len(regexp_split_to_array(trim(text), '\s+')) >= 50 AS is_case FROM q""",
    "paragraph_split": r"""WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\n(\d{1,3}\. )', E'\n\n\\1', 'g'), '\n\s*\n')) AS t FROM documents)
        SELECT doc_id, count(*) AS paragraphs, max(length(t)) AS longest FROM p WHERE trim(t) <> '' GROUP BY 1""",
    "zone_carry_forward": f"""WITH {se.ZONED.split('zr AS')[0].rstrip().rstrip(',')}, n AS (SELECT doc_id, unnest(generate_series(0, len(r.t) - 1)) AS para, unnest(r.t) AS text, unnest(r.r) AS role FROM p0),
        z AS (SELECT doc_id, para, CASE {se.ROLES} END AS z FROM n WHERE text IS NOT NULL)
        SELECT doc_id, CAST(para AS INT) AS para, coalesce(last_value(z IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para ROWS UNBOUNDED PRECEDING), 'other') AS zone FROM z""",
    "court_lookup": "SELECT jurisdiction, arg_min(court_name, {'a': -length(name_pattern), 'b': court_name}) AS court_name FROM (SELECT DISTINCT jurisdiction FROM precedents) JOIN courts ON regexp_matches(lower(jurisdiction), name_pattern) GROUP BY 1",
    "corpus_report": "SELECT doc_type, source, count(*) AS docs, count(*) FILTER (lang IS NULL) AS no_lang, count(*) FILTER (docket IS NULL) AS no_docket, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1, 2",
    "grouping_sets_report": "SELECT doc_type, state, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, grouping_id(doc_type, state) AS level FROM documents GROUP BY GROUPING SETS ((doc_type, state), (doc_type), (state), ())",
    "citation_shift_monthly": """WITH x AS (SELECT loaded_at, list_transform(coalesce(relevant_statute_ids, []), lambda r: split_part(lower(trim(r)), ':', 1)) AS k FROM precedents),
        y AS (SELECT loaded_at, list_has_any(k, ['vds', 'vps', 'vsa']) AS n, list_has_any(k, ['vpc', 'vcp', 'vea']) AS o FROM x)
        SELECT strftime(loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS docs, round(avg(CAST(n AS INT)), 6) AS new, round(avg(CAST(o AS INT)), 6) AS old, round(avg(CAST(n AND o AS INT)), 6) AS "both" FROM y GROUP BY 1""",
    "facet_counts": f"""{_CASES} SELECT facet, value, count(*) AS n FROM (SELECT 'decade' AS facet, CAST(CAST(floor(year(date) / 10) * 10 AS INT) AS VARCHAR) AS value FROM c
        UNION ALL SELECT 'code', value FROM (SELECT DISTINCT doc_id, split_part(r, ':', 1) AS value FROM (SELECT doc_id, unnest(cites) AS r FROM c))) WHERE value IS NOT NULL GROUP BY 1, 2""",
    "citation_edges": f"{_EDGES} SELECT * FROM e",
    "degree_stats": f"{_EDGES} SELECT doc_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT dst AS doc_id, 1 AS i, 0 AS o FROM e UNION ALL SELECT src, 0, 1 FROM e) GROUP BY 1",
    "cocitation": f"""{_EDGES}, d AS (SELECT dst, count(*) AS n FROM e GROUP BY 1), x AS (SELECT q.dst AS query_id, o.dst AS doc_id, count(*) AS n FROM e q JOIN e o ON q.src = o.src AND q.dst <> o.dst WHERE CAST(substr(q.dst, 2) AS INT) % 20 = 0 GROUP BY 1, 2)
        SELECT query_id, doc_id, round(x.n / sqrt(a.n * b.n), 6) AS score FROM x JOIN d a ON a.dst = query_id JOIN d b ON b.dst = doc_id""",
    "coupling_jaccard": """WITH f AS (SELECT DISTINCT doc_id, ref FROM (SELECT id AS doc_id, lower(trim(unnest(relevant_statute_ids))) AS ref FROM precedents) WHERE ref <> ''), s AS (SELECT doc_id, count(*) AS n FROM f GROUP BY 1),
        x AS (SELECT q.doc_id AS query_id, o.doc_id, count(*) AS c FROM f q JOIN f o ON q.ref = o.ref AND q.doc_id <> o.doc_id WHERE CAST(substr(q.doc_id, 2) AS INT) % 20 = 0 GROUP BY 1, 2)
        SELECT query_id, x.doc_id, round(c / (a.n + b.n - c), 6) AS score FROM x JOIN s a ON a.doc_id = query_id JOIN s b ON b.doc_id = x.doc_id""",
    "pagerank_fixed": _pagerank_sql(5),
    "components": _EDGES.replace("WITH", "WITH RECURSIVE", 1) + """, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT a AS node, a AS m FROM u UNION SELECT b, m FROM r JOIN u ON a = node)
        SELECT node, min(m) AS component FROM r GROUP BY 1""",
    "metrics_at_k": f"{_QR} SELECT query_id, {_R6('ap', 'rr', 'p_1', 'r_1', 'p_5', 'r_5', 'ndcg_1', 'ndcg_5')}, {_F1(1)}, {_F1(5)} FROM m",
    "map_mrr": f"{_QR} SELECT count(*) AS queries, round(avg(ap), 6) AS map, round(avg(rr), 6) AS mrr, round(avg(ndcg_5), 6) AS ndcg_5 FROM m",
    "best_k": f"""{_QR}, k AS (SELECT unnest(generate_series(1, 20)) AS k), h AS (SELECT k, query_id, n, count(*) AS h FROM j JOIN k ON rank <= k WHERE grade > 0 GROUP BY ALL)
        SELECT CAST(k AS INT) AS k, round(f, 6) AS f1 FROM (SELECT k, round(sum(2.0 * h / (k + n)) / (SELECT count(*) FROM nr), 9) AS f FROM h GROUP BY 1) ORDER BY f DESC, k LIMIT 1""",
    "kappa_judges": f"""{_PAIRS}, t AS (SELECT judge_a, judge_b, count(*) AS n, avg(CAST(a = b AS INT)) AS po FROM pa GROUP BY 1, 2), l AS (SELECT unnest([0, 1, 2]) AS v),
        mg AS (SELECT judge_a, judge_b, v, count(*) FILTER (a = v) AS ra, count(*) FILTER (b = v) AS rb FROM pa, l GROUP BY ALL), pe AS (SELECT judge_a, judge_b, sum(ra * rb) AS m FROM mg GROUP BY 1, 2)
        SELECT judge_a, judge_b, n, round(po, 6) AS agreement, round(CASE WHEN m / (n * n) < 1 THEN (po - m / (n * n)) / (1 - m / (n * n)) ELSE 1 END, 6) AS kappa FROM t JOIN pe USING (judge_a, judge_b)""",
    "confusion_metrics": f"""{_PAIRS}, t AS (SELECT count(*) FILTER (a > 0 AND b > 0) AS tp, count(*) FILTER (a = 0 AND b > 0) AS fp, count(*) FILTER (a > 0 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM pa)
        SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
        round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS macro_f1 FROM t""",
    "auc_midrank": """WITH d AS (SELECT length(text) AS s, doc_type = 'judgment' AS y FROM documents WHERE text IS NOT NULL AND doc_type IS NOT NULL), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM d)
        SELECT round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM r""",
    "holm_adjust": """WITH t AS (SELECT judge AS name, round(avg(CAST(grade = 2 AS INT)) / 10, 6) AS p FROM e4_multilingual WHERE grade IN (0, 1, 2) GROUP BY 1), s AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p) AS s FROM t)
        SELECT name, p, round(max(s) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""",
    "hash_split": "SELECT DISTINCT id, CASE WHEN CAST('0x' || right(md5(id), 1) AS INT) % 2 = 0 THEN 'dev' ELSE 'test' END AS part FROM rag_questions",
    "cache_reuse_first_seen": """WITH e AS (SELECT lower(trim(doc_id)) AS d, {'a': judged_at, 'b': query_id, 'c': judge} AS k, judged_at FROM e9_procedure_temporal)
        SELECT strftime(judged_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS requests, round(avg(CAST(k > f AS INT)), 6) AS reused FROM (SELECT *, min(k) OVER (PARTITION BY d) AS f FROM e) GROUP BY 1""",
}
