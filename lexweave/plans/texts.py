"""Queries of text functions, comparison of provisions, tolerant retrieval, answers, research rounds and replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import legal, lexical
from lexweave.functions.text import char_bigrams, light_stem, words
from lexweave.operators import agent as ag
from lexweave.operators import answers as an
from lexweave.operators import compare as cp
from lexweave.operators import index as ix
from lexweave.operators import overlap as ov
from lexweave.operators import replay as rp
from lexweave.operators import score as sc
from lexweave.operators import spell as sp
from lexweave.plans import relations as re_
from lexweave.plans import search as se
from lexweave.session import cut
from lexweave.tables import spread, table


def _vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return ix.postings(ix.token_rows(se.docs(spark, folder), "doc_id", "text")).groupBy("term").agg(F.count("*").alias("df"))


def _latin(spark: SparkSession, folder: str) -> DataFrame:
    return _vocabulary(spark, folder).where("term rlike '^[a-z]{4,}$'")


def porter_stem(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the vocabulary: once per distinct term, to be joined back."""
    return _latin(spark, folder).select("term", lexical.vectorised(lexical.stem, "string")(F.col("term")).alias("stem"))


def suffix_stem(spark: SparkSession, folder: str) -> DataFrame:
    return _latin(spark, folder).select("term", light_stem(F.col("term")).alias("stem"))


def transliteration(spark: SparkSession, folder: str) -> DataFrame:
    """Devanagari terms in Latin, with folded spelling and phonetic key."""
    v = _vocabulary(spark, folder).where("term rlike '^[\\\\x{0900}-\\\\x{097F}]+$'")
    rom = v.select("term", lexical.vectorised(lexical.romanise, "string")(F.col("term")).alias("roman"))
    return rom.select("term", "roman", lexical.vectorised(lexical.normal_roman, "string")(F.col("roman")).alias("folded"), lexical.vectorised(lexical.hindi_soundex, "string")(F.col("roman")).alias("code"))


def soundex_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return sp.soundex_buckets(_latin(spark, folder))


def kgram_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours, among terms of 20 documents or more, of the terms of one, at 0.45 as its SQL has it; ``kgram_neighbours`` has all."""
    v = _latin(spark, folder)
    got = sp.kgram_candidates(v.where("df <= 1").select(F.col("term").alias("word")), v.where("df >= 20").select("term"), 0.45)
    return got.withColumn("jaccard", F.round("jaccard", 6))


def _rare_and_known(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Words of at most two documents, and the dictionary: terms of at least two. The vocabulary is built once."""
    v = cut(_latin(spark, folder))
    return v.where("df <= 2").select(F.col("term").alias("word")), v.where("df >= 2")


def kgram_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of all rare words in the whole dictionary, at the Jaccard of 0.3 from which a correction is looked for."""
    rare, known = _rare_and_known(spark, folder)
    return sp.kgram_candidates(rare, known.select("term")).withColumn("jaccard", F.round("jaccard", 6))


def spelling_best(spark: SparkSession, folder: str) -> DataFrame:
    """The best correction of every rare word from the whole dictionary."""
    return sp.corrections(*_rare_and_known(spark, folder))


def character_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    return _latin(spark, folder).select(F.explode(char_bigrams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def section_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """How often each provision is mentioned in the documents."""
    m = se.docs(spark, folder).select("doc_id", F.explode(lexical.vectorised(legal.section_mentions, legal.MENTION_TYPE)(F.col("text"))).alias("m"))
    return m.groupBy("m.code", "m.section").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


def decision_dates(spark: SparkSession, folder: str) -> DataFrame:
    return se.docs(spark, folder).select("doc_id", lexical.vectorised(legal.decision_date, "string")(F.col("text")).alias("date"))


def claim_quantities(spark: SparkSession, folder: str) -> DataFrame:
    q = se.docs(spark, folder).select("doc_id", F.explode(lexical.vectorised(legal.quantities, legal.QUANTITY_TYPE)(F.col("text"))).alias("q"))
    return q.groupBy("q.unit").agg(F.count("*").alias("n"), F.max("q.value").alias("most"))


def _statutes(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "statutes").groupBy("id").agg(F.max(F.struct("loaded_at", "provision_name", "text")).alias("r"))
    return s.select("id", F.split_part("id", F.lit(":"), F.lit(1)).alias("code"), F.split_part("id", F.lit(":"), F.lit(2)).alias("section"), F.concat_ws(" ", "r.text").alias("text"))


def punishment_extract(spark: SparkSession, folder: str) -> DataFrame:
    got = _statutes(spark, folder).select("id", lexical.vectorised(legal.punishment, legal.PUNISHMENT_TYPE)(F.col("text")).alias("p"))
    return got.select("id", "p.*")


def treatment_status(spark: SparkSession, folder: str) -> DataFrame:
    """The treatment each passage gives the case it cites, by its cues."""
    t = table(spark, folder, "treatment").where("sentence is not null").select("id", "sentence").distinct()
    return t.select("id", lexical.vectorised(legal.treatment, "string")(F.col("sentence")).alias("treatment"))


def _sides(spark: SparkSession, folder: str, code: str) -> DataFrame:
    return _statutes(spark, folder).where(F.col("code") == code).select("section", cp.legal_words(F.col("text")).alias("words"), "text")


def bigram_containment(spark: SparkSession, folder: str) -> DataFrame:
    """How much of an old provision stands in the new one of the same number."""
    a, b = _sides(spark, folder, "vpc"), _sides(spark, folder, "vds").select("section", F.col("words").alias("w2"))
    both = a.join(b, "section")
    return both.select("section", F.round(cp.containment(cp.bigrams(F.col("words")), cp.bigrams(F.col("w2"))), 6).alias("containment"), F.round(cp.jaccard(cp.bigrams(F.col("words")), cp.bigrams(F.col("w2"))), 6).alias("jaccard"))


def repealed_sections(spark: SparkSession, folder: str) -> DataFrame:
    got = cp.repealed(_sides(spark, folder, "vpc"), _sides(spark, folder, "vds"))
    return got.withColumn("best", F.round("best", 6))


def clause_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment, class of change and carry-over of the provisions of equal number."""
    cut = lexical.vectorised(cp.clauses, "array<string>")

    def side(code: str) -> DataFrame:
        rows = _sides(spark, folder, code).select(F.col("section").alias("pair"), F.posexplode(cut("text")).alias("i", "c"))
        return rows.select("pair", "i", cp.legal_words(F.col("c")).alias("words"))

    al = cp.align(side("vpc"), side("vds")).where("n_old > 0 and n_new > 0")
    texts = _sides(spark, folder, "vpc").select(F.col("section").alias("pair"), F.col("text").alias("t1")).join(_sides(spark, folder, "vds").select(F.col("section").alias("pair"), F.col("text").alias("t2")), "pair")
    pun = lexical.vectorised(legal.punishment, legal.PUNISHMENT_TYPE)
    x = al.join(texts, "pair").withColumn("mens", cp.mens_rea(F.col("t1")) != cp.mens_rea(F.col("t2"))).withColumn("pun", ~pun("t1").eqNullSafe(pun("t2")))
    cls = cp.change_class(F.col("retention"), F.col("novelty"), F.col("mens"), F.col("pun"), F.col("n_old") != F.col("n_new"), F.length("t2") > 0)
    keep = cp.carry_over(F.col("retention"), F.col("novelty"), F.col("added") / F.col("n_new"), F.col("mens"), F.col("pun"))
    return x.select("pair", "n_old", "n_new", F.round("retention", 6).alias("retention"), F.round("novelty", 6).alias("novelty"), cls.alias("drift_class"), keep.alias("carry_over"))


def code_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The old provisions nearest to each new one, by body and by the place and offence of its first words."""
    s = _statutes(spark, folder).where("code in ('vpc', 'vds')").select("code", "section", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words"))
    return cp.code_alignment(s.select("code", "section", F.slice("words", 1, 12).alias("title"), "words"), "vpc", "vds")


def rocchio_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback terms from the first five of each ranking against the next five."""
    d = se.docs(spark, folder)
    post = ix.postings(ix.token_rows(d, "doc_id", "text"))
    stats = ix.term_stats(post, d.agg(F.count("*").alias("n")))
    head = sc.topk(se.bm25_scores(spark, folder), 10).select("query_id", "doc_id", (F.col("rank") <= 5).alias("relevant"))
    return se._round(sc.rocchio(head, post, stats), "weight")


def duplicate_collapse(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking with one document of each docket."""
    g = table(spark, folder, "documents").where("docket is not null").select("doc_id", F.col("docket").alias("grp"))
    return se._round(sc.collapse(sc.topk(se.bm25_scores(spark, folder), 30), g, 10).select("query_id", "doc_id", "score", "rank"), "score")


def research_round(spark: SparkSession, folder: str) -> DataFrame:
    """Planned sub-queries of every item, searched in one batch and fused."""
    _, terms, post, stats = se._search(spark, folder)
    salient = sc.prune(terms, stats.select("term", "idf_bm25"), 8).select("query_id", "term")
    found = ag.run_round(ag.plan(se.items(spark, folder), salient), post, stats)
    return ag.fuse_round(found).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", F.array_join(F.transform("found_by", lambda x: x.cast("string")), ",").alias("found_by"))


def question_routes(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "rag_questions").where("text is not null").select("id", "text").distinct()
    return q.select("id", ag.route(F.col("text")).alias("route"))


def sub_query_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Provisions voted for by the judgments the questions retrieve."""
    z = se.zoned(spark, folder)
    cites = table(spark, folder, "precedents").select(F.col("id").alias("doc_id"), F.explode("relevant_statute_ids").alias("ref")).where("ref is not null")
    votes = ag.votes(z.head(10).withColumnRenamed("q", "query_id"), cites).withColumnRenamed("query_id", "q")
    return se._round(z.named(votes), "score")


def _answers(spark: SparkSession, folder: str, claims: bool = False) -> DataFrame:
    """(query_id, n, sentence, ...): sentences of the best paragraphs of the eight best judgments of every question."""
    z = se.zoned(spark, folder)
    head = cut(z.head(8).select("q", "doc_id", "rank"))
    d = se.judgments(spark, folder).where("z is not null")
    parts = F.transform("z", lambda p: an.sentences(an.clipped(p["text"])))
    bonus = F.transform("z", lambda p: F.when(p["text"].isNull(), F.lit(None)).when(p["rhetorical_roles"].isin(*[r for r, v in se.ROLE_ZONE.items() if v in ("ratio", "decision")]), 0.5).otherwise(0.0))
    read = d.select("doc_id", bonus.alias("bonus"), F.transform("z", lambda p: words(p["text"])).alias("words"), F.transform(parts, lambda x: F.transform(x, words)).alias("sentences"))
    chosen = cut(z.sentences(read, head))
    texts = d.select("doc_id", F.transform("z", lambda p: an.clipped(p["text"])).alias("sources"), parts.alias("sentences"))
    return z.named(z.quoted(texts, chosen, claims))


def answer_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder)


def checked_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Every extracted sentence held against its source, with what correction does to it."""
    return an.corrected(_answers(spark, folder, claims=True))


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    d, terms, post, stats = se._search(spark, folder)
    head = sc.topk(sc.bm25(terms, post, stats), 3)
    return an.snippet(head, d.select("doc_id", F.lit(0).alias("para"), "text"), terms)


def shingles_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Exact five-word Jaccard of every judgment whose id is divisible by 20 with every judgment it shares a shingle with."""
    p = se._latest(spread(table(spark, folder, "precedents")).select("id", "loaded_at", "text")).select("id", words(F.concat_ws(" ", "text")).alias("words"))
    return ov.jaccard(p, F.expr("try_cast(substring(id, 2) as int) % 20 = 0"), 5)


def cache_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Hit tokens of three policies and sizes, a trace per judge."""
    e = table(spark, folder, "e9_procedure_temporal").select("judge", "judged_at", "query_id", F.lower(F.trim("doc_id")).alias("key"))
    seq = F.concat(F.date_format("judged_at", "yyyyMMddHHmmss"), F.coalesce("query_id", F.lit("")))
    return rp.sweep(e.select(F.col("judge").alias("trace"), seq.alias("seq"), "key", F.length("key").alias("size")), [400, 1600, 6400])


def crosswalk_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Old and new provisions cited together in one judgment, by the kind of their relation."""
    c = re_._cases(spark, folder).select("doc_id", F.explode("cites").alias("r"))
    old = c.where("split_part(r, ':', 1) = 'vpc'").select("doc_id", F.col("r").alias("old"))
    new = c.where("split_part(r, ':', 1) = 'vds'").select("doc_id", F.col("r").alias("new"))
    return cp.relations(old.join(new, "doc_id").select("old", "new"))


_V = f"WITH {se.TOK}, v AS (SELECT term, df FROM stats WHERE regexp_full_match(term, '[a-z]{{4,}}'))"
_SIDE = """WITH s0 AS (SELECT id, max({'a': loaded_at, 'b': provision_name, 't': text}).t AS t FROM statutes GROUP BY 1), s1 AS (SELECT split_part(id, ':', 1) AS code, split_part(id, ':', 2) AS section, lower(array_to_string(t, ' ')) AS t FROM s0),
s2 AS (SELECT code, section, regexp_extract_all(replace(regexp_replace(regexp_replace(replace(regexp_replace(t, '^\\s*\\(?[a-z0-9]{1,3}\\)\\s*', ''), 'whosoever', 'whoever'), '\\brs\\.?\\s*', 'rupees ', 'g'), '(\\d),(\\d)', '\\1\\2', 'g'), 'sub-section', 'subsection'), '[a-z0-9]+') AS w FROM s1),
g AS (SELECT code, section, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM s2)"""
_SUFFIX = " ".join(f"WHEN term LIKE '%{s}' AND length(term) > {len(s) + 3} THEN left(term, length(term) - {len(s)})" for s in ("ingly", "ation", "ing", "ed", "es", "ly", "s"))

QUERIES = {
    f.__name__: f
    for f in (
        porter_stem, suffix_stem, transliteration, soundex_buckets, kgram_candidates, kgram_neighbours, spelling_best, character_bigrams, section_mentions, decision_dates, claim_quantities, punishment_extract,
        treatment_status, bigram_containment, repealed_sections, clause_alignment, code_alignment, rocchio_terms, duplicate_collapse, research_round, question_routes, sub_query_votes, answer_sentences,
        checked_answers, snippets, shingles_jaccard, cache_sweep, crosswalk_relations,
    )
}
SQL = {
    "code_alignment": """WITH s0 AS (SELECT split_part(id, ':', 1) AS code, split_part(id, ':', 2) AS section, regexp_extract_all(lower(array_to_string(max({'a': loaded_at, 'b': provision_name, 't': text}).t, ' ')), '[a-z]+') AS w FROM statutes GROUP BY id),
        s AS (SELECT * FROM s0 WHERE code IN ('vpc', 'vds')), n AS (SELECT count(*) AS n FROM s),
        r AS (SELECT 'b' AS k, code, section, unnest(w) AS t FROM s UNION ALL SELECT 't', code, section, unnest(w[1:12]) FROM s), tf AS (SELECT k, code, section, t, count(*) AS tf FROM r GROUP BY ALL),
        i AS (SELECT k, t, ln((SELECT n FROM n) / count(*)) AS idf FROM tf GROUP BY 1, 2), w AS (SELECT k, code, section, t, tf * idf AS w FROM tf JOIN i USING (k, t) WHERE tf * idf > 0),
        u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY k, code, section)) AS u FROM w), c AS (SELECT a.k, a.section AS old, b.section AS new, sum(a.u * b.u) AS s FROM u a JOIN u b ON a.k = b.k AND a.t = b.t AND a.code = 'vpc' AND b.code = 'vds' GROUP BY 1, 2, 3),
        m AS (SELECT old, new, round(sum(CASE WHEN k = 'b' THEN 0.65 * s ELSE 0.35 * s END), 6) AS sim FROM c GROUP BY 1, 2)
        SELECT old, new, sim FROM m WHERE sim >= 0.3 QUALIFY row_number() OVER (PARTITION BY new ORDER BY sim DESC, old) <= 4 AND sim >= 0.85 * max(sim) OVER (PARTITION BY new)""",
    "suffix_stem": f"{_V} SELECT term, CASE {_SUFFIX} ELSE term END AS stem FROM v",
    "character_bigrams": f"{_V}, c AS (SELECT term, '$' || term || '$' AS t FROM v), b AS (SELECT DISTINCT term, substr(t, i, 2) AS gram FROM (SELECT term, t, unnest(generate_series(1, length(t) - 1)) AS i FROM c)) SELECT gram, count(*) AS n FROM b GROUP BY 1",
    "kgram_candidates": f"""{_V}, c AS (SELECT term, df, '$' || term || '$' AS t FROM v), b AS (SELECT DISTINCT term, df, substr(t, i, 2) AS g FROM (SELECT term, df, t, unnest(generate_series(1, length(t) - 1)) AS i FROM c)), s AS (SELECT term, count(*) AS n FROM b GROUP BY 1),
        x AS (SELECT a.term AS word, b.term, count(*) AS c FROM b a JOIN b ON a.g = b.g AND a.df <= 1 AND b.df >= 20 AND abs(length(a.term) - length(b.term)) <= 2 GROUP BY 1, 2)
        SELECT word, x.term, round(c / (sa.n + sb.n - c), 6) AS jaccard FROM x JOIN s sa ON sa.term = word JOIN s sb ON sb.term = x.term WHERE c / (sa.n + sb.n - c) >= 0.45""",
    "bigram_containment": f"{_SIDE} SELECT a.section, round(len(list_intersect(a.g, b.g)) / len(a.g), 6) AS containment, round(len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))), 6) AS jaccard FROM g a JOIN g b USING (section) WHERE a.code = 'vpc' AND b.code = 'vds'",
    "repealed_sections": f"{_SIDE}, m AS (SELECT a.section, max(len(list_intersect(a.g, b.g)) / len(a.g)) AS best FROM g a, g b WHERE a.code = 'vpc' AND b.code = 'vds' GROUP BY 1) SELECT section, round(best, 6) AS best FROM m WHERE best < 0.5",
    "rocchio_terms": f"""WITH {se.BM}, h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r FROM bm QUALIFY r <= 10), nj AS (SELECT query_id, count(*) FILTER (r <= 5) AS np, count(*) FILTER (r > 5) AS nn FROM h GROUP BY 1),
        w AS (SELECT query_id, term, sum(CASE WHEN r <= 5 THEN (1 + log10(tf)) * idf_log10 ELSE 0 END) AS p, sum(CASE WHEN r > 5 THEN (1 + log10(tf)) * idf_log10 ELSE 0 END) AS q FROM h JOIN post USING (doc_id) JOIN stats USING (term) GROUP BY 1, 2),
        z AS (SELECT query_id, term, CASE WHEN np > 0 THEN p / np ELSE 0 END - 0.25 * CASE WHEN nn > 0 THEN q / nn ELSE 0 END AS weight FROM w JOIN nj USING (query_id))
        SELECT query_id, term, round(weight, 6) AS weight FROM z WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY z.weight DESC, term) <= 10""",
    "duplicate_collapse": f"""WITH {se.BM}, h AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS r FROM bm QUALIFY r <= 30),
        k AS (SELECT h.* FROM h JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(docket, CAST(doc_id AS VARCHAR)) ORDER BY r) = 1) {se.top('k')}""",
    "shingles_jaccard": f"""WITH p AS (SELECT id, regexp_extract_all(lower(array_to_string(max({{'a': loaded_at, 't': text}}).t, ' ')), '{se.W}') AS w FROM precedents GROUP BY 1),
        s AS (SELECT DISTINCT id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM p)), n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
        x AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id WHERE CAST(substr(a.id, 2) AS INT) % 20 = 0 GROUP BY 1, 2)
        SELECT a, b, round(c / (na.n + nb.n - c), 6) AS jaccard FROM x JOIN n na ON na.id = a JOIN n nb ON nb.id = b""",
    "crosswalk_relations": f"""{re_._CASES}, r AS (SELECT doc_id, unnest(cites) AS r FROM c), p AS (SELECT DISTINCT o.r AS old, n.r AS new FROM r o JOIN r n USING (doc_id) WHERE split_part(o.r, ':', 1) = 'vpc' AND split_part(n.r, ':', 1) = 'vds')
        SELECT old, new, CASE WHEN a > 1 AND b > 1 THEN 'both' WHEN a > 1 THEN 'split' WHEN b > 1 THEN 'merge' ELSE 'same' END AS relation FROM (SELECT *, count(*) OVER (PARTITION BY old) AS a, count(*) OVER (PARTITION BY new) AS b FROM p)""",
    "question_routes": r"""SELECT id, CASE WHEN len(regexp_split_to_array(trim(text), '\s+')) >= 50 THEN 'case_text' WHEN regexp_matches(text, '(?i)\b(section|sec\.|s\.|article|art\.|dhara)\s*\d+') THEN 'section_lookup' ELSE 'fact_question' END AS route
        FROM (SELECT DISTINCT id, text FROM rag_questions WHERE text IS NOT NULL)""",
}
