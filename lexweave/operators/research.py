"""Research over a batch of questions: family of law, issues, rounds with feedback, verified provisions, memo and structured answers.

Rounds are a bounded loop on the driver; within a round all questions and sub-questions are one search. Tables are keyed by
``query_id``. Defined results: questions without issues, hits or provisions keep a row with empty lists where a memo or answer
is made; nulls read as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import legal
from lexweave.functions import provisions as pv
from lexweave.functions.lexical import vectorised
from lexweave.functions.text import words
from lexweave.operators import agent as ag
from lexweave.operators import score as sc
from lexweave.session import cut


def code_of(ref: str) -> Column:
    return F.substring_index(F.col(ref), ":", 1)


def is_content(term: str) -> Column:
    """Whether a term says something: no section or offence token, no number, at least three characters."""
    t = F.col(term)
    return ~t.contains(":") & ~t.rlike(r"^\d+$") & (F.length(t) >= 3)


def section_text(ref: str) -> Column:
    """How a question would name a reference: vpc:302 as VPC Section 302."""
    return F.concat(F.upper(code_of(ref)), F.lit(" Section "), F.upper(F.substring_index(F.col(ref), ":", -1)))


def family(hits: DataFrame, cues: DataFrame, offences: DataFrame, cites: DataFrame, families: dict[str, str], top: int = 5) -> DataFrame:
    """(query_id, family): the family of codes that speaks loudest in the first provisions (1/rank), at most two cue words (a half each),
    the offences named (one each) and the codes of the precedents found (a quarter each); ties by name.

    hits (query_id, doc_id, rank), cues (query_id, family, n), offences (query_id, ref), cites (query_id, ref); ``families`` maps codes.
    """
    name = lambda ref: F.coalesce(*[F.when(code_of(ref) == c, F.lit(f)) for c, f in families.items()])
    parts = [
        hits.where(F.col("rank") <= top).select("query_id", name("doc_id").alias("family"), (1 / F.col("rank")).alias("w")),
        cues.select("query_id", "family", (0.5 * F.least(F.lit(2), F.col("n"))).alias("w")),
        offences.select("query_id", name("ref").alias("family"), F.lit(1.0).alias("w")), cites.select("query_id", name("ref").alias("family"), F.lit(0.25).alias("w")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("family is not null")
    sums = every.groupBy("query_id", "family").agg(F.sum("w").alias("w"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "family"))
    return sums.withColumn("r", first).where("r = 1").select("query_id", "family")


def family_questions(queries: DataFrame, chosen: DataFrame, families: dict[str, str]) -> DataFrame:
    """(query_id, sub, kind, text, weight): the question asked once for every code of its family."""
    codes = queries.sparkSession.createDataFrame([(f, c) for c, f in sorted(families.items())], "family string, code string")
    rows = queries.join(chosen, "query_id").join(F.broadcast(codes), "family")
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("code"))
    return rows.select("query_id", (10 + n).alias("sub"), F.lit("family").alias("kind"), F.concat(F.lit("code:"), "code", F.lit(" "), "text").alias("text"), F.lit(0.5).alias("weight"))


def issues(queries: DataFrame, idf: DataFrame, keep: int = 4, most: int = 5, least: int = 2) -> DataFrame:
    """(query_id, issue, terms): what a question asks, clause by clause: the ``keep`` most telling terms of each, no set twice.

    ``idf`` has (term, idf).
    """
    parts = F.split(F.lower("text"), r"[.;?!]|,\s+(?:and|but|or|whether|when)\b|\band whether\b")
    rows = queries.select("query_id", F.posexplode(parts).alias("i", "c")).select("query_id", "i", F.explode(words(F.col("c"))).alias("term")).distinct()
    told = rows.where(is_content("term")).join(idf, "term")
    rank = F.row_number().over(Window.partitionBy("query_id", "i").orderBy(F.desc("idf"), "term"))
    by = told.withColumn("r", rank).where(F.col("r") <= keep).groupBy("query_id", "i").agg(F.array_sort(F.collect_list("term")).alias("terms")).where(F.size("terms") >= least)
    one = by.groupBy("query_id", "terms").agg(F.min("i").alias("i"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("i"))
    return one.withColumn("issue", n).where(F.col("issue") <= most).select("query_id", "issue", "terms")


def coverage(found: DataFrame, asked: DataFrame, docs: DataFrame, top: int = 10, share: float = 0.5) -> DataFrame:
    """(query_id, issue, doc_id): the best document that has at least ``share`` of an issue's terms, null where none has.

    found (query_id, doc_id, rank), asked as ``issues`` gives, docs (doc_id, text).
    """
    head = found.where(F.col("rank") <= top).join(docs.select("doc_id", words(F.col("text")).alias("w")), "doc_id")
    both = asked.join(head, "query_id").where(F.size(F.array_intersect("terms", "w")) >= share * F.size("terms"))
    best = both.groupBy("query_id", "issue").agg(F.min(F.struct("rank", "doc_id")).alias("b"))
    return asked.join(best, ["query_id", "issue"], "left").select("query_id", "issue", "terms", F.col("b.doc_id").alias("doc_id"))


def rounds(queries: DataFrame, subs: DataFrame, search: Callable[[DataFrame], DataFrame], reformulate: Callable[[DataFrame], DataFrame], confidence: DataFrame, most: int = 2, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank, found_by, rounds): search, fuse, and ask again what found little, at most ``most`` rounds.

    ``search`` maps sub-questions to (query_id, sub, doc_id, score, rank, weight), ``reformulate`` a fused list to new sub-questions.
    """
    found, n = cut(search(subs)), queries.select("query_id", F.lit(1).alias("rounds"))
    for i in range(1, most):
        fused = ag.fuse_round(found, k)
        again = cut(ag.wants_more(fused, confidence, k))
        if again.isEmpty():
            break
        more = search(reformulate(fused.join(again, "query_id", "left_semi")))
        found = cut(found.unionByName(more))
        n = n.join(again.withColumn("a", F.lit(i + 1)), "query_id", "left").select("query_id", F.coalesce("a", "rounds").alias("rounds"))
    return ag.fuse_round(found, k).join(n, "query_id")


def issue_round(found: DataFrame, open_issues: DataFrame, search: Callable[[DataFrame], DataFrame], k: int = 10) -> DataFrame:
    """One extra round for the issues that no document covers, fused with what was found."""
    subs = open_issues.where("doc_id is null").select("query_id", (100 + F.col("issue")).alias("sub"), F.lit("issue").alias("kind"), F.array_join("terms", " ").alias("text"), F.lit(0.6).alias("weight"))
    return ag.fuse_round(found.unionByName(search(subs)), k)


def heading_overlap(question: Column, heading: Column) -> Column:
    """Jaccard of the short stems of a question and a heading."""
    stems = vectorised(lambda t: sorted({pv.short_stem(w) for w in pv.law_words(t) if len(w) > 2 and w not in pv.STOP}), "array<string>")
    a, b = stems(F.coalesce(question, F.lit(""))), stems(F.coalesce(heading, F.lit("")))
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(0.0)


def verified(hits: DataFrame, queries: DataFrame, statutes: DataFrame, chosen: DataFrame, families: dict[str, str], general: tuple[str, ...] = (), keep: int = 5, depth: int = 20) -> DataFrame:
    """(query_id, ref, score, rank, rescued): provisions by 1/rank, a half for the question's family, a half for law in force,
    the heading's overlap, less one for sections that fit any question; beside the first ``keep`` the best of the next by its heading.

    hits (query_id, doc_id, rank), queries (query_id, text, in_force: codes or null), statutes (ref, title).
    """
    rows = hits.where(F.col("rank") <= depth).select("query_id", F.col("doc_id").alias("ref"), "rank").join(statutes.select("ref", "title"), "ref").join(queries.select("query_id", "text", "in_force"), "query_id").join(chosen, "query_id", "left")
    rows = rows.withColumn("overlap", heading_overlap(F.col("text"), F.col("title")))
    own = F.coalesce(*[F.when(code_of("ref") == c, F.lit(f)) for c, f in families.items()])
    score = 1 / F.col("rank") + F.when(own == F.col("family"), 0.5).otherwise(0.0) + F.when(F.array_contains("in_force", code_of("ref")), 0.5).otherwise(0.0) + F.col("overlap")
    rows = rows.withColumn("score", F.round(score - F.when(F.col("ref").isin(*general), 1.0).otherwise(0.0), 9))
    w = Window.partitionBy("query_id")
    rows = rows.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "rank", "ref")))
    late = F.when(F.col("r") > keep, F.col("overlap"))
    rows = rows.withColumn("best", F.max(F.struct(late.alias("o"), -F.col("r"))).over(w))
    saved = (F.col("r") > keep) & (F.col("overlap") > 0) & (late == F.col("best.o")) & (-F.col("r") == F.col("best.col2"))
    return rows.withColumn("rescued", F.coalesce(saved, F.lit(False))).where((F.col("r") <= keep) | F.col("rescued")).select("query_id", "ref", "score", F.col("r").alias("rank"), "rescued")


def chapter_match(queries: DataFrame, toc: DataFrame, idf: DataFrame, top: int = 2) -> DataFrame:
    """(query_id, code, chapter, score): the chapters (code, chapter, sections, terms) whose words are a question's, by idf cosine."""
    q = queries.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(idf, "term")
    t = toc.select("code", "chapter", F.explode("terms").alias("term")).join(idf, "term")
    qn, tn = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qn")), t.groupBy("code", "chapter").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("tn"))
    dot = q.select("query_id", "term", F.col("idf").alias("a")).join(t, "term").groupBy("query_id", "code", "chapter").agg(F.sum(F.col("a") * F.col("idf")).alias("dot"))
    s = dot.join(qn, "query_id").join(tn, ["code", "chapter"]).select("query_id", "code", "chapter", F.round(F.col("dot") / (F.col("qn") * F.col("tn")), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "code", "chapter"))
    return s.withColumn("r", rank).where((F.col("r") <= top) & (F.col("score") > 0)).drop("r")


def chapter_boost(provisions: DataFrame, matched: DataFrame, toc: DataFrame, weight: float = 0.3) -> DataFrame:
    """(query_id, ref, score): provisions raised by weight / (60 + rank) of their chapter among those matched."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "code", "chapter"))
    b = matched.withColumn("rank", rank).join(toc, ["code", "chapter"]).select("query_id", F.explode(F.transform("sections", lambda s: F.concat_ws(":", "code", s))).alias("ref"), (weight / (60 + F.col("rank"))).alias("b"))
    best = b.groupBy("query_id", "ref").agg(F.max("b").alias("b"))
    return provisions.join(best, ["query_id", "ref"], "left").select("query_id", "ref", (F.col("score") + F.coalesce("b", F.lit(0.0))).alias("score"))


def recovered_heading(title: Column, text: Column) -> Column:
    """A bare title ("Section 5 in an act") replaced by the heading with which the text begins, if it has one."""
    bare = F.coalesce(title, F.lit("")).rlike(r"(?i)^\s*(?:(?:section|article)\s+\d+\w*.*)?$")
    head = F.regexp_extract(text, r"^\s*(?:\d+\w*\.\s*)?([A-Z][^.—–]{3,80})(?:\.\s*[—–-]|[—–])", 1)
    return F.when(bare & (head != ""), head).otherwise(title)


def memo(queries: DataFrame, law: DataFrame, covered: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, question, law, issues, open_issues, authorities, note): one nested row for each question."""
    by_law = law.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda x: x["ref"]).alias("law"))
    by_issue = covered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("issue", F.array_join("terms", " ").alias("terms"), "doc_id"))).alias("issues"), F.count_if(F.col("doc_id").isNull()).alias("open_issues"))
    by_doc = found.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("authorities"))
    out = queries.select("query_id", F.col("text").alias("question")).join(by_law, "query_id", "left").join(by_issue, "query_id", "left").join(by_doc, "query_id", "left")
    none = F.array().cast("array<string>")
    note = F.when(F.coalesce("open_issues", F.lit(0)) > 0, F.concat(F.col("open_issues").cast("string"), F.lit(" issue(s) without an authority"))).when(F.col("authorities").isNull(), "nothing was found")
    return out.select("query_id", "question", F.coalesce("law", none).alias("law"), "issues", F.coalesce("open_issues", F.lit(0)).alias("open_issues"), F.coalesce("authorities", none).alias("authorities"), note.alias("note"))


def version_flags(answers: DataFrame, in_force: DataFrame, equivalents: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """(query_id, flag): sections an answer cites under a code that isn't in force, with what replaced them, and bare numbers.

    answers (query_id, text), in_force (query_id, codes), equivalents (ref, other); ``known`` are the codes that have versions.
    """
    mention = vectorised(legal.section_mentions, legal.MENTION_TYPE)
    rows = answers.select("query_id", F.explode(mention(F.coalesce("text", F.lit("")))).alias("m")).select("query_id", F.concat_ws(":", "m.code", "m.section").alias("ref")).distinct()
    held = rows.join(in_force, "query_id", "left")
    wrong = held.where(code_of("ref").isin(*known) & ~F.coalesce(F.array_contains("codes", code_of("ref")), F.lit(True)))
    other = equivalents.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_set("other")), ", ").alias("other"))
    a = wrong.join(other, "ref", "left").select("query_id", F.concat(F.lit("wrong code for the date: "), "ref", F.coalesce(F.concat(F.lit(", now "), "other"), F.lit(""))).alias("flag"))
    return a.unionByName(rows.where(code_of("ref") == "?").select("query_id", F.concat(F.lit("no code named: section "), F.substring_index("ref", ":", -1)).alias("flag")))


def era_quote(chunks: DataFrame, dated: DataFrame, change: str, top: int = 3) -> DataFrame:
    """(query_id, chunk, doc_id, note): the quotation of an answer: a judgment decided since the change among the first ``top``, else the first.

    chunks (query_id, chunk, doc_id), dated (doc_id, decision_date).
    """
    rows = chunks.where(F.col("chunk") <= top).join(dated.select("doc_id", "decision_date"), "doc_id", "left")
    fresh = F.coalesce(F.col("decision_date") >= change, F.lit(False))
    best = rows.groupBy("query_id").agg(F.min(F.struct((~fresh).alias("old"), "chunk", "doc_id", "decision_date")).alias("b"))
    note = F.when(F.col("b.decision_date").isNull(), "undated").when(F.col("b.old"), "decided under the old law").otherwise("decided under the new law")
    return best.select("query_id", "b.chunk", "b.doc_id", note.alias("note"))


def structured_answer(law: DataFrame, statutes: DataFrame, quotes: DataFrame, flags: DataFrame) -> DataFrame:
    """(query_id, provisions, quote, notes): the law in force with the punishment of each sub-section, the quoted case, and what to mind.

    law (query_id, ref, rank), statutes (ref, title, text), quotes as ``era_quote`` gives, flags (query_id, flag).
    """
    punish = vectorised(lambda t: [pv.punishment_text(legal.punishment(c)) for c in pv.clauses(t) if pv.states_punishment(legal.punishment(c))], "array<string>")
    rows = law.join(statutes, "ref").withColumn("p", punish(F.coalesce("text", F.lit(""))))
    by = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref", "title", F.col("p").alias("punishments")))).alias("provisions"))
    notes = flags.groupBy("query_id").agg(F.array_sort(F.collect_set("flag")).alias("notes"))
    q = quotes.select("query_id", F.struct("doc_id", "note").alias("quote"))
    return by.join(q, "query_id", "full").join(notes, "query_id", "left").select("query_id", "provisions", "quote", F.coalesce("notes", F.array().cast("array<string>")).alias("notes"))


def version_note(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ref, note): what a crosswalk (old, new, relation) says about a section of either side."""
    said = F.create_map(*[F.lit(x) for kv in {"same": "is now", "merge": "was merged into", "split": "was split into", "both": "was rearranged into"}.items() for x in kv])
    rows = pairs.groupBy("old", "relation").agg(F.array_join(F.array_sort(F.collect_set("new")), ", ").alias("n")).select(F.col("old").alias("ref"), F.concat_ws(" ", "old", F.coalesce(said[F.col("relation")], F.lit("corresponds to")), "n").alias("note"))
    back = pairs.groupBy("new").agg(F.array_join(F.array_sort(F.collect_set("old")), ", ").alias("o")).select(F.col("new").alias("ref"), F.concat_ws(" ", "new", F.lit("was"), "o").alias("note"))
    return refs.select("ref").distinct().join(rows.unionByName(back), "ref")


def answer_figures(answers: DataFrame) -> DataFrame:
    """(query_id, supported, law_flags, stale_flags) of (query_id, checks array<boolean>, flags array<string>)."""
    n = F.size(F.filter("flags", lambda f: f.startswith("law changed")))
    supported = F.when(F.size("checks") > 0, F.size(F.filter("checks", lambda c: c)) / F.size("checks"))
    return answers.select("query_id", supported.alias("supported"), n.alias("law_flags"), F.size(F.filter("flags", lambda f: f.startswith("stale"))).alias("stale_flags"))


def top_authorities(authority: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """The ``k`` documents of highest authority, overall or in each state, ties to the larger id."""
    if by is None:
        return authority.orderBy(F.desc("g"), F.desc("doc_id")).limit(k)
    return sc.topk(authority, k, by, "g")
