"""Index and search queries over the judgment tables. Query sets: evaluation items whose id is divisible by 20, against all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import ngrams, plain_words, words
from lexweave.operators import index as ix
from lexweave.operators import score as sc
from lexweave.operators import zoned as zn
from lexweave.session import cut
from lexweave.tables import small, spread, table

ZONES = {"facts": 1.0, "arguments": 0.5, "ratio": 2.0, "decision": 1.5}
#: Rhetorical role labels and the zones they stand for.
ROLE_ZONE = {"Facts": "facts", "Issue": "facts", "PetArg": "arguments", "RespArg": "arguments", "CourtRes": "ratio", "Conclusion": "decision"}


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text")).where("text is not null")


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "eval_items").where("item_id % 20 = 0 and text is not null").select(F.col("item_id").alias("query_id"), "text")


def _search(spark: SparkSession, folder: str, cosine: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, query terms, postings of these terms, their statistics): built once a query and shared by its channels."""
    d = docs(spark, folder)
    terms = sc.query_terms(items(spark, folder), "query_id", "text")
    return d, terms, *sc.query_tables(d, "doc_id", "text", terms, cosine=cosine)


def channels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(BM25 scores, tf-idf scores) from the same postings."""
    _, terms, post, stats = _search(spark, folder, cosine=True)
    return sc.bm25(terms, post, stats), sc.tfidf(terms, post, stats)


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def postings_stats(spark: SparkSession, folder: str) -> DataFrame:
    post = ix.postings(ix.token_rows(docs(spark, folder), "doc_id", "text"))
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def positional_index(spark: SparkSession, folder: str) -> DataFrame:
    post = ix.positional(ix.token_rows(docs(spark, folder), "doc_id", "text"))
    return post.select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"))


def idf_two_ways(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder)
    return _round(ix.term_stats(ix.postings(ix.token_rows(d, "doc_id", "text")), d.agg(F.count("*").alias("n"))), "idf_log10", "idf_bm25")


def doc_length_norms(spark: SparkSession, folder: str) -> DataFrame:
    return _round(ix.length_norms(ix.doc_lengths(docs(spark, folder), "doc_id", "text"), 0.7), "norm")


def query_term_pruning(spark: SparkSession, folder: str) -> DataFrame:
    _, terms, _, stats = _search(spark, folder)
    return _round(sc.prune(terms, stats, 10).select("query_id", "term", "weight", "idf_bm25"), "idf_bm25")


def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    _, terms, post, stats = _search(spark, folder)
    return sc.bm25(terms, post, stats)


def tfidf_scores(spark: SparkSession, folder: str) -> DataFrame:
    return channels(spark, folder)[1]


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(bm25_scores(spark, folder), 10), "score")


def tfidf_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(tfidf_scores(spark, folder), 10), "score")


def gram_scores(spark: SparkSession, folder: str) -> DataFrame:
    q = ix.gram_rows(items(spark, folder), "query_id", "text").withColumnRenamed("doc_id", "query_id")
    d = docs(spark, folder).select("doc_id", plain_words(F.col("text")).alias("_p"))  # once a text, not once a gram
    return sc.gram_bm25(q, *sc.query_tables(d, "doc_id", "_p", q, 0.9, ngrams(F.col("_p"), 3)))


def ngram_bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(gram_scores(spark, folder), 10), "score")


def _latest(p: DataFrame) -> DataFrame:
    """The last delivery (id, loaded_at, ...) of every id. Only texts that were delivered again are moved."""
    again = small(p.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1 or id is null").select(F.col("id").alias("_id")))
    same = F.col("id").eqNullSafe(F.col("_id"))
    rest = [c for c in p.columns if c != "id"]
    last = p.join(again, same, "left_semi").groupBy("id").agg(F.max(F.struct(*rest)).alias("r")).select("id", "r.*")
    return p.join(again, same, "left_anti").unionByName(last)


def judgments(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, z) of the last delivery of every precedent; z: its paragraphs and their roles."""
    p = spread(table(spark, folder, "precedents")).select("id", "loaded_at", F.arrays_zip("text", F.coalesce("rhetorical_roles", F.array().cast("array<string>")).alias("rhetorical_roles")).alias("z"))
    return _latest(p).select(F.col("id").alias("doc_id"), "z")


def _zone(role: Column) -> Column:
    return F.coalesce(*[F.when(role == r, F.lit(v)) for r, v in ROLE_ZONE.items()], F.lit("other"))


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, para, zone, text) of the last delivery of every precedent."""
    last = judgments(spark, folder).select("doc_id", F.posexplode("z").alias("para", "z"))
    return last.select("doc_id", "para", _zone(F.col("z.rhetorical_roles")).alias("zone"), F.col("z.text").alias("text")).where("text is not null")


def _blocks(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    """``df`` of the precedents in as few partitions as there are cores, and in more only where a task had too many documents."""
    n = table(spark, folder, "precedents").count()
    return df.coalesce(max(spark.sparkContext.defaultParallelism, -(-n // zn.TASK)))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, text) of the last delivery of every question."""
    q = table(spark, folder, "rag_questions").where("id is not null and text is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "text")).alias("r"))
    return q.select(F.col("id").alias("query_id"), F.col("r.text").alias("text"))


def zoned(spark: SparkSession, folder: str) -> zn.Zoned:
    """The index by zones of all precedents, for all questions."""
    place = F.transform("z", lambda z: F.coalesce(*[F.when(z["rhetorical_roles"] == r, F.lit(list(ZONES).index(v))) for r, v in ROLE_ZONE.items()], F.lit(len(ZONES))).cast("int"))
    rows = judgments(spark, folder).where("z is not null").select("doc_id", place.alias("zones"), F.transform("z", lambda z: F.coalesce(words(z["text"]), F.array().cast("array<string>"))).alias("words"))
    return zn.Zoned(_blocks(spark, folder, rows), questions(spark, folder), ZONES)


def _zone_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of the questions ``statute_bridge`` asks."""
    return sc.query_terms(questions(spark, folder).where("try_cast(substring(query_id, 2) as int) % 20 = 0"), "query_id", "text")


def _zoned(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(postings by zone, norms, query terms, lengths by zone)."""
    rows = paragraphs(spark, folder).select("doc_id", "zone", F.explode(words(F.col("text"))).alias("term"))
    post = cut(ix.postings(rows, ("zone",)))  # lengths, totals and scores read it; the texts are cut into words once
    lengths = post.groupBy("doc_id", "zone").agg(F.sum("tf").alias("len"))
    return post, ix.length_norms(lengths, 1.0, "zone"), _zone_terms(spark, folder), lengths


def bm25f_zones(spark: SparkSession, folder: str) -> DataFrame:
    z = zoned(spark, folder)
    return _round(z.named(z.head(10)).select("query_id", "doc_id", "score", "rank"), "score")


def zone_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    z = zoned(spark, folder)
    return _round(z.named(z.breakdown(cut(z.head(10).select("q", "doc_id")))).select("query_id", "doc_id", "zone", "share"), "share")


def zone_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _zoned(spark, folder)[3].groupBy("zone").agg(F.count("*").alias("docs"), F.sum("len").alias("words"), F.max("len").alias("longest"))


def champion_lists(spark: SparkSession, folder: str) -> DataFrame:
    post = ix.postings(ix.token_rows(docs(spark, folder), "doc_id", "text"))
    return ix.champions(post, _length_authority(spark, folder), 5)


def _length_authority(spark: SparkSession, folder: str) -> DataFrame:
    n = ix.doc_lengths(docs(spark, folder), "doc_id", "text")
    return n.select("doc_id", F.round(F.log10(F.col("len") + 1.0), 6).alias("g"))


def tier_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return ix.tier_one(_length_authority(spark, folder), 0.2)


def qpp_pre_post(spark: SparkSession, folder: str) -> DataFrame:
    d, terms, postings, stats = _search(spark, folder)
    pre = sc.qpp_pre(terms, stats, d.agg(F.count("*").alias("n")))
    post = sc.qpp_post(sc.topk(sc.bm25(terms, postings, stats), 10))
    both = pre.join(post, "query_id").withColumn("confidence", sc.confidence(F.col("max_idf"), F.col("gap")))
    return _round(both, "max_idf", "avg_idf", "scope", "gap", "top_ratio", "spread", "confidence")


def maxp_dense(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").where("embedding is not null")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return _round(sc.maxp(q, e.select(F.col("label").alias("doc_id"), "embedding")), "score")


def mix_max(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(sc.mix(bm25_scores(spark, folder), gram_scores(spark, folder), 0.4), 10), "score")


def fuse_minmax(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(sc.fuse(*channels(spark, folder), 0.7), 10), "score")


def fuse_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(sc.fuse(*channels(spark, folder), 0.7, sc.z_score), 10), "score")


def rrf(spark: SparkSession, folder: str) -> DataFrame:
    runs = [sc.topk(s, 50).withColumn("weight", F.lit(w)) for s, w in zip(channels(spark, folder), (1.0, 0.8))]
    return _round(sc.topk(sc.rrf(runs[0].unionByName(runs[1])), 10), "score")


def combsum(spark: SparkSession, folder: str) -> DataFrame:
    runs = [sc.topk(s, 50).withColumn("weight", F.lit(w)).withColumn("run", F.lit(n)) for s, n, w in zip(channels(spark, folder), "ab", (1.0, 0.8))]
    return _round(sc.topk(sc.combsum(runs[0].unionByName(runs[1])), 10), "score")


def net_score(spark: SparkSession, folder: str) -> DataFrame:
    return _round(sc.topk(sc.net_score(sc.max_normal(bm25_scores(spark, folder)), _length_authority(spark, folder)), 10), "score")


def statute_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Precedents boosted by the provisions the questions retrieve."""
    st = table(spark, folder, "statutes").groupBy("id").agg(F.max(F.struct("loaded_at", "text")).alias("r")).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "r.text").alias("text"))
    terms = _zone_terms(spark, folder)
    post, stats, norms = sc.search_tables(st, "doc_id", "text")
    hits = sc.bm25(terms, post, stats, norms).withColumn("score", F.round("score", 9))  # equal provisions tie exactly
    prec = table(spark, folder, "precedents").select(F.col("id").alias("doc_id"), F.explode("relevant_statute_ids").alias("ref")).where("ref is not null")
    return sc.topk(_round(sc.bridge(hits, prec).withColumnRenamed("boost", "score"), "score"), 10)


def explain_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Frequency, idf and part of every term of the best hit of a query."""
    _, terms, post, stats = _search(spark, folder)
    first = sc.topk(sc.bm25(terms, post, stats), 1).select("query_id", "doc_id")
    rows = first.join(terms, "query_id").join(post, ["doc_id", "term"]).join(stats, "term")
    part = F.col("weight") * F.col("idf_bm25") * F.col("tf") * 2.6 / (F.col("tf") + 1.6 * F.col("norm"))
    return _round(rows.select("query_id", "doc_id", "term", "tf", "df", part.alias("part")), "part")


W = r"[a-z0-9]+(?:''[a-z]+)?|[\x{0900}-\x{0DFF}\x{0600}-\x{06FF}]+"
TOK = f"""
d AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, unnest(w) AS term FROM d),
n AS (SELECT count(*) AS n FROM d),
post AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
stats AS (SELECT term, count(*) AS df, log10(max(n) / CAST(count(*) AS DOUBLE)) AS idf_log10,
          ln((max(n) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf_bm25 FROM post, n GROUP BY term),
len AS (SELECT doc_id, len(w) AS len FROM d),
q AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM eval_items WHERE item_id % 20 = 0),
terms AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS weight FROM q GROUP BY 1, 2)"""
BM = TOK + """,
norms AS (SELECT doc_id, len / (SELECT avg(len) FROM len) AS norm FROM len),
bm AS (SELECT query_id, doc_id, sum(weight * idf_bm25 * tf * 2.6 / (tf + 1.6 * norm)) AS score
       FROM terms JOIN stats USING (term) JOIN post USING (term) JOIN norms USING (doc_id) GROUP BY 1, 2)"""
TF = """,
dn AS (SELECT doc_id, sqrt(sum((1 + log10(tf)) ** 2)) AS dn FROM post GROUP BY 1),
tq AS (SELECT query_id, term, (CASE WHEN weight < 1 THEN weight ELSE 1 + log10(weight) END) * idf_log10 AS qw FROM terms JOIN stats USING (term) WHERE idf_log10 > 0),
qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM tq GROUP BY 1),
tf AS (SELECT query_id, doc_id, sum((1 + log10(tf)) * qw) / (any_value(dn) * any_value(qn)) AS score
       FROM tq JOIN post USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY 1, 2)"""
GRAM = """,
g0 AS (SELECT doc_id, regexp_extract_all(lower(replace(text, '[MASK]', ' ')), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
gl AS (SELECT doc_id, greatest(len(w) - 2, 0) AS len FROM g0),
gr AS (SELECT doc_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS term FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM g0)),
gp AS (SELECT term, doc_id, count(*) AS tf FROM gr GROUP BY 1, 2),
gs AS (SELECT term, ln(((SELECT count(*) FROM g0) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM gp GROUP BY 1),
gq0 AS (SELECT item_id AS query_id, regexp_extract_all(lower(replace(text, '[MASK]', ' ')), '[a-z0-9]+') AS w FROM eval_items WHERE item_id % 20 = 0),
gq AS (SELECT DISTINCT query_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS term FROM (SELECT query_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM gq0)),
ga AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.1 + 0.9 * len / (SELECT avg(len) FROM gl)))) AS score
       FROM gq JOIN gs USING (term) JOIN gp USING (term) JOIN gl USING (doc_id) GROUP BY 1, 2),
gram AS (SELECT * FROM ga QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) <= 300)"""


def top(source: str, k: int = 10) -> str:
    return f"SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank FROM {source} QUALIFY rank <= {k}"


ROLES = " ".join(f"WHEN role = '{r}' THEN '{z}'" for r, z in ROLE_ZONE.items())
ZW = " ".join(f"WHEN zone = '{z}' THEN {w}" for z, w in ZONES.items())
ZONED = f"""
p0 AS (SELECT id AS doc_id, max({{'a': loaded_at, 't': text, 'r': rhetorical_roles}}) AS r FROM precedents GROUP BY 1),
p1 AS (SELECT doc_id, unnest(r.t) AS text, unnest(r.r) AS role FROM p0),
zr AS (SELECT doc_id, CASE {ROLES} ELSE 'other' END AS zone, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM p1 WHERE text IS NOT NULL),
zp AS (SELECT term, doc_id, zone, count(*) AS tf FROM zr GROUP BY ALL),
zl AS (SELECT doc_id, zone, count(*) AS len FROM zr GROUP BY ALL),
zn AS (SELECT doc_id, zone, len / avg(len) OVER (PARTITION BY zone) AS norm FROM zl),
zs AS (SELECT term, ln(((SELECT count(DISTINCT doc_id) FROM zr) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5) + 1) AS idf FROM zp GROUP BY 1),
rq AS (SELECT id, max({{'a': loaded_at, 't': text}}).t AS text FROM rag_questions WHERE text IS NOT NULL GROUP BY 1),
zq AS (SELECT id AS query_id, term, count(*) AS weight FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM rq WHERE CAST(substr(id, 2) AS INT) % 20 = 0) GROUP BY 1, 2),
zt AS (SELECT query_id, doc_id, term, any_value(weight) AS qw, any_value(idf) AS idf, sum(CASE {ZW} END * tf / norm) AS tfn
       FROM zq JOIN zs USING (term) JOIN zp USING (term) JOIN zn USING (doc_id, zone) WHERE zone <> 'other' GROUP BY 1, 2, 3),
zf AS (SELECT query_id, doc_id, sum(qw * idf * tfn * 2.6 / (tfn + 1.6)) AS score FROM zt GROUP BY 1, 2)"""
ZONED_ALL = ZONED.replace(" WHERE CAST(substr(id, 2) AS INT) % 20 = 0", " WHERE id IS NOT NULL")  # every question
MM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"
ZZ = "CASE WHEN count(*) OVER w < 2 OR stddev_pop(score) OVER w = 0 THEN 0.0 ELSE (score - avg(score) OVER w) / stddev_pop(score) OVER w END"


def fused(normal: str) -> str:
    return f"""WITH {BM}{TF},
    a AS (SELECT query_id, doc_id, {normal} AS a FROM bm WINDOW w AS (PARTITION BY query_id)),
    b AS (SELECT query_id, doc_id, {normal} AS b FROM tf WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, doc_id, 0.7 * coalesce(a, min(a) OVER w) + 0.3 * coalesce(b, min(b) OVER w) AS score FROM a FULL JOIN b USING (query_id, doc_id) WINDOW w AS (PARTITION BY query_id))
    {top('f')}"""


RUNS = f"""WITH {BM}{TF},
    ra AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank, 1.0 AS weight, 'a' AS run FROM bm QUALIFY rank <= 50),
    rb AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank, 0.8 AS weight, 'b' AS run FROM tf QUALIFY rank <= 50),
    r AS (SELECT * FROM ra UNION ALL SELECT * FROM rb)"""
AUTH = ", auth AS (SELECT doc_id, round(log10(len + 1.0), 6) AS g FROM len)"

QUERIES = {
    f.__name__: f
    for f in (
        postings_stats, positional_index, idf_two_ways, doc_length_norms, query_term_pruning, bm25_topk, tfidf_topk, ngram_bm25_topk, bm25f_zones, zone_breakdown, zone_lengths,
        champion_lists, tier_candidates, qpp_pre_post, maxp_dense, mix_max, fuse_minmax, fuse_zscore, rrf, combsum, net_score, statute_bridge, explain_terms,
    )
}
SQL = {
    "postings_stats": f"WITH {TOK} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM post GROUP BY 1",
    "positional_index": f"""SELECT term, doc_id, count(*) AS tf, CAST(min(p) AS INT) AS first_pos, CAST(max(p) AS INT) AS last_pos FROM (
        SELECT doc_id, unnest(w) AS term, unnest(generate_series(0, len(w) - 1)) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents)) GROUP BY 1, 2""",
    "idf_two_ways": f"WITH {TOK} SELECT term, df, round(idf_log10, 6) AS idf_log10, round(idf_bm25, 6) AS idf_bm25 FROM stats",
    "doc_length_norms": f"WITH {TOK} SELECT doc_id, round(0.3 + 0.7 * len / (SELECT avg(len) FROM len), 6) AS norm FROM len",
    "query_term_pruning": f"WITH {TOK} SELECT query_id, term, weight, round(idf_bm25, 6) AS idf_bm25 FROM terms JOIN stats USING (term) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY stats.idf_bm25 * weight DESC, term) <= 10",
    "bm25_topk": f"WITH {BM} {top('bm')}",
    "tfidf_topk": f"WITH {TOK}{TF} {top('tf')}",
    "ngram_bm25_topk": f"WITH {GRAM[2:]} {top('gram')}",
    "bm25f_zones": f"WITH {ZONED_ALL} {top('zf')}",
    "zone_breakdown": f"""WITH {ZONED_ALL}, head AS ({top('zf')}),
        parts AS (SELECT query_id, doc_id, zone, sum(CASE {ZW} END * tf / norm) AS part FROM zq JOIN zp USING (term) JOIN zn USING (doc_id, zone) WHERE zone <> 'other' GROUP BY 1, 2, 3)
        SELECT query_id, doc_id, zone, round(part / sum(part) OVER (PARTITION BY query_id, doc_id), 6) AS share FROM parts SEMI JOIN head USING (query_id, doc_id)""",
    "zone_lengths": f"WITH {ZONED} SELECT zone, count(*) AS docs, CAST(sum(len) AS BIGINT) AS words, max(len) AS longest FROM zl GROUP BY 1",
    "champion_lists": f"WITH {TOK}{AUTH} SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY tf * (1 + g) DESC, doc_id DESC) AS rank FROM post JOIN auth USING (doc_id) QUALIFY rank <= 5",
    "tier_candidates": f"WITH {TOK}{AUTH} SELECT doc_id FROM auth WHERE g > 0 QUALIFY row_number() OVER (ORDER BY g DESC, doc_id DESC) <= round(0.2 * (SELECT count(*) FROM auth))",
    "qpp_pre_post": f"""WITH {BM},
        pre AS (SELECT query_id, max(idf_log10) AS max_idf, avg(idf_log10) AS avg_idf, least(1.0, sum(df) / (SELECT n FROM n)) AS scope FROM terms JOIN stats USING (term) WHERE idf_log10 > 0 GROUP BY 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS k FROM bm QUALIFY k <= 10),
        po AS (SELECT query_id, (max(score) FILTER (k = 1) - coalesce(max(score) FILTER (k = 2), 0)) / (max(score) FILTER (k = 1)) AS gap, (max(score) FILTER (k = 1)) / avg(score) AS top_ratio, stddev_pop(score) / avg(score) AS spread FROM r GROUP BY 1)
        SELECT query_id, round(max_idf, 6) AS max_idf, round(avg_idf, 6) AS avg_idf, round(scope, 6) AS scope, round(gap, 6) AS gap, round(top_ratio, 6) AS top_ratio, round(spread, 6) AS spread,
               round(0.5 * least(1.0, max_idf / 3) + 0.5 * least(1.0, gap / 0.2), 6) AS confidence FROM pre JOIN po USING (query_id)""",
    "maxp_dense": """SELECT q.vec_id AS query_id, p.label AS doc_id, round(max(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[]))), 6) AS score
        FROM embeddings q, embeddings p WHERE q.vec_id % 20 = 0 GROUP BY 1, 2""",
    "mix_max": f"""WITH {BM}{GRAM}, x AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS a FROM bm), y AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS b FROM gram),
        m AS (SELECT query_id, doc_id, 0.6 * coalesce(a, 0) + 0.4 * coalesce(b, 0) AS score FROM x FULL JOIN y USING (query_id, doc_id)) {top('m')}""",
    "fuse_minmax": fused(MM),
    "fuse_zscore": fused(ZZ),
    "rrf": f"{RUNS}, s AS (SELECT query_id, doc_id, sum(weight / (60 + rank)) AS score FROM r GROUP BY 1, 2) {top('s')}",
    "combsum": f"""{RUNS}, s0 AS (SELECT query_id, doc_id, weight * {MM} AS v FROM r WINDOW w AS (PARTITION BY query_id, run)), s AS (SELECT query_id, doc_id, sum(v) AS score FROM s0 GROUP BY 1, 2) {top('s')}""",
    "net_score": f"WITH {BM}{AUTH}, s AS (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) + 0.2 * g AS score FROM bm JOIN auth USING (doc_id)) {top('s')}",
    "statute_bridge": f"""WITH {ZONED}, s0 AS (SELECT id AS doc_id, max({{'a': loaded_at, 't': text}}).t AS t FROM statutes GROUP BY 1),
        sd AS (SELECT doc_id, regexp_extract_all(lower(array_to_string(t, ' ')), '{W}') AS w FROM s0), sl AS (SELECT doc_id, len(w) / avg(len(w)) OVER () AS norm FROM sd),
        sp AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM sd) GROUP BY 1, 2),
        ss AS (SELECT term, ln(((SELECT count(*) FROM sd) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM sp GROUP BY 1),
        sb AS (SELECT query_id, doc_id, round(sum(weight * idf * tf * 2.6 / (tf + 1.6 * norm)), 9) AS score FROM zq JOIN ss USING (term) JOIN sp USING (term) JOIN sl USING (doc_id) GROUP BY 1, 2),
        sh AS (SELECT * FROM sb QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) <= 10),
        sn AS (SELECT query_id, doc_id AS ref, score / max(score) OVER (PARTITION BY query_id) AS s FROM sh),
        ci AS (SELECT DISTINCT doc_id, ref FROM (SELECT id AS doc_id, unnest(relevant_statute_ids) AS ref FROM precedents) WHERE ref IS NOT NULL),
        bo AS (SELECT query_id, doc_id, sum(s) AS s FROM sn JOIN ci USING (ref) GROUP BY 1, 2), b2 AS (SELECT query_id, doc_id, round(0.3 * s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM bo) {top('b2')}""",
    "explain_terms": f"""WITH {BM}, f AS (SELECT query_id, doc_id FROM bm QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) = 1)
        SELECT query_id, doc_id, term, tf, df, round(weight * idf_bm25 * tf * 2.6 / (tf + 1.6 * norm), 6) AS part FROM f JOIN terms USING (query_id) JOIN post USING (doc_id, term) JOIN stats USING (term) JOIN norms USING (doc_id)""",
}
