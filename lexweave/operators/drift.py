"""What changed where one code replaced another: reports per new section, carry-over per pair, sections that were dropped.

``sections`` has (section, title, text), one row for each section; ``crosswalk`` has (old, new, relation, note). Sections are
numbers of one family of codes, or code:number of several, which are then done together. The work on a pair of sections is local to its row, so a table of pairs is mapped; what is shuffled are the
texts of the sections that the crosswalk pairs. A new section's predecessors come together in one row, of which the crosswalk
has a handful; the map from old to new numbers is sent to the tasks behind a check of its size.

Defined results: sections without text, and pairs whose sections are missing, are ``UNVERIFIED`` with the prior of their
relation; a new section without predecessors is ``NEW``; empty inputs give empty outputs; repeated rows count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import legal
from lexweave.functions import provisions as pv
from lexweave.functions.lexical import vectorised
from lexweave.operators import compare as cp

#: Thresholds and weights of the class and the carry-over, and priors by relation for what can't be judged.
NOVELTY, RETENTION, IDENTICAL, W_NOVELTY, W_ADDED, M_MENS, M_LIMIT, M_PUNISHMENT, W_SENTENCE, INFERRED = 0.25, 0.7, 0.97, 0.5, 0.15, 0.6, 0.7, 0.5, 0.15, 0.5
PRIOR = {"same": 0.95, "merge": 0.85, "split": 0.8, "modified": 0.6}
#: The most rows of a crosswalk whose numbers are sent to the tasks.
MAX_CROSSWALK = 200_000
_SECTION = "struct<section:string,title:string,text:string>"
_FEATURES = ", ".join(f"{f}:double" for f in pv.FEATURES)
DETAIL = f"struct<{_FEATURES}, added:array<string>, lost:array<string>, mens_rea_added:array<string>, mens_rea_removed:array<string>, direction:string, punishment_old:string, punishment_new:string>"


def sources(crosswalk: DataFrame) -> DataFrame:
    """(old, new, relation, note): one row for each pair of base sections; a note that is only a similarity is none."""
    base = lambda c: F.lower(F.trim(F.substring_index(F.col(c), "(", 1)))
    note = F.when(~F.coalesce("note", F.lit("")).startswith("sim="), F.lower(F.trim("note")))
    rows = crosswalk.select(base("old").alias("old"), base("new").alias("new"), "relation", note.alias("note")).where("old <> '' and new <> ''")
    return rows.groupBy("old", "new").agg(F.min("relation").alias("relation"), F.max("note").alias("note"))


def numbers(pairs: DataFrame) -> dict[str, dict[str, str]]:
    """By code ('' where sections are bare numbers), old numbers with exactly one successor, and its number."""
    one = pairs.groupBy("old").agg(F.min("new").alias("new"), F.count_distinct("new").alias("n")).where("n = 1")
    rows = one.select("old", "new").limit(MAX_CROSSWALK + 1).collect()
    if len(rows) > MAX_CROSSWALK:
        raise ValueError(f"the crosswalk has more than {MAX_CROSSWALK} sections, the stated bound")
    out: dict[str, dict[str, str]] = {}
    for r in rows:
        code, _, number = r["old"].rpartition(":")
        out.setdefault(code, {})[number] = r["new"].rpartition(":")[2]
    return out


def with_numbers(sections: DataFrame, own: dict[str, dict[str, str]], others: dict[str, tuple[str, dict[str, str]]] | None = None) -> DataFrame:
    """The sections with their references in the numbers of the code that replaced theirs."""
    swap = _mapped(lambda section, text: pv.renumbered(text, own.get((section or "").rpartition(":")[0], {}), others), "string")
    return sections.withColumn("text", swap("section", "text"))


def _groups(old: DataFrame, new: DataFrame, pairs: DataFrame) -> DataFrame:
    """(new_section, new_title, new_text, olds, split, note, relation): each new section with its predecessors."""
    many = pairs.groupBy("old").agg((F.count_distinct("new") > 1).alias("many"))
    held = pairs.join(many, "old").join(old.select(F.col("section").alias("old"), F.struct("section", "title", "text").alias("o")), "old")
    by_new = held.groupBy("new").agg(F.sort_array(F.collect_list(F.struct("o", "note", "relation"))).alias("h"), F.bool_or("many").alias("split"))
    both = new.select(F.col("section").alias("new"), F.col("title").alias("new_title"), F.col("text").alias("new_text")).join(by_new, "new", "left")
    return both.select(F.col("new").alias("new_section"), "new_title", "new_text", F.col("h.o").alias("olds"), F.col("h.note").alias("notes"), F.col("h.relation").alias("relations"), F.coalesce("split", F.lit(False)).alias("split"))


def _detail(olds: list[dict] | None, text: str | None, title: str | None, split: bool) -> dict | None:
    if olds is None or not len(olds):
        return None
    f, d = pv.features([o["text"] or "" for o in olds], [o["title"] or "" for o in olds], text or "", title or "", legal.punishment, len(olds) > 1, bool(split))
    el, al = d["elements"], d["alignment"]
    return f | {"added": al["added"], "lost": al["lost"], "mens_rea_added": el["mens_rea_added"], "mens_rea_removed": el["mens_rea_removed"], "direction": d["change"]["direction"], "punishment_old": d["punishment_old"], "punishment_new": d["punishment_new"]}


def _mapped(fn, kind: str):
    """An Arrow UDF of several columns, row by row within a batch."""
    import pandas as pd

    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*row) for row in zip(*cols)], dtype=object)

    def struct(*cols: pd.Series) -> pd.DataFrame:
        names = [p.split(":")[0].strip() for p in kind[7:-1].replace("array<string>", "list").split(",")]
        return pd.DataFrame([fn(*row) or dict.fromkeys(names) for row in zip(*cols)], columns=names)

    run.__annotations__ = {"cols": pd.Series, "return": pd.Series}
    struct.__annotations__ = {"cols": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(struct if kind.startswith("struct<") else run, kind)


def drift_class(f) -> Column:
    """The class of a change from its features; ``f`` gives the column of a feature."""
    lost = (f("lost_clauses") >= 1) & (f("split") == 0)
    grave = (f("mens_rea_changed") == 1) | (f("threshold_changed") == 1) | (f("added_clauses") >= 1) | lost | (f("novelty") >= NOVELTY) | ((f("retention") <= RETENTION) & (f("split") == 0))
    return (
        F.when((f("old_incomplete") == 1) & (f("punishment_changed") == 1), "PUNISHMENT").when(f("old_incomplete") == 1, "UNVERIFIED").when(grave, "SUBSTANTIVE")
        .when(f("punishment_changed") == 1, "PUNISHMENT").when((f("merge") == 1) | (f("split") == 1), "RESTRUCTURED").when(f("edit_similarity") >= IDENTICAL, "IDENTICAL").otherwise("COSMETIC")
    )


def carry_over(f, relation: Column) -> Column:
    """How far what was held on the old provision carries over; the relation's prior where the text can't tell."""
    prior = F.coalesce(*[F.when(relation == k, F.lit(v)) for k, v in PRIOR.items()], F.lit(0.8))
    punished = F.when(f("punishment_changed") == 1, M_PUNISHMENT).otherwise(1.0)
    guilt = f("retention") * (1 - W_NOVELTY * f("novelty_matched")) * (1 - W_ADDED * f("added_share"))
    guilt = guilt * F.when(f("mens_rea_changed") == 1, M_MENS).otherwise(1.0) * F.when(f("threshold_changed") == 1, M_LIMIT).otherwise(1.0)
    told = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 - W_SENTENCE) * guilt + W_SENTENCE * guilt * punished))
    return F.round(F.when(f("old_incomplete") == 1, prior * F.pow(punished, F.lit(W_SENTENCE))).otherwise(told), 4)


def _unexplained(notes: Column, texts: Column) -> Column:
    """Whether a note says that the new section comes from an Explanation which the old text doesn't have."""
    return F.coalesce(notes.contains("explanation"), F.lit(False)) & ~F.coalesce(F.lower(texts).rlike(r"\bexplanation\b"), F.lit(False))


def reports(old: DataFrame, new: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(new_section, title, old_sections, drift_class, carry_over, features..., flags, reasons): one row for each new section."""
    pairs = sources(crosswalk)
    rows = _groups(with_numbers(old, numbers(pairs)), new, pairs)
    rows = rows.withColumn("d", _mapped(_detail, DETAIL)("olds", "new_text", "new_title", "split"))
    unexplained = F.forall(F.arrays_zip("olds", "notes"), lambda z: _unexplained(z["notes"], z["olds"]["text"]))
    f = lambda name: F.when(unexplained, 1.0).otherwise(F.col("d.old_incomplete")) if name == "old_incomplete" else F.col(f"d.{name}")
    fresh = F.coalesce(F.size("olds"), F.lit(0)) <= 0
    flags = ("mens_rea_changed", "threshold_changed", "punishment_changed", "merge", "split", "old_incomplete")
    cls = F.when(fresh, "NEW").otherwise(drift_class(f))
    share = lambda c: F.concat(F.round(100 * F.col(c)).cast("int").cast("string"), F.lit("%"))
    head = F.create_map(*[F.lit(x) for kv in HEADS.items() for x in kv])[cls]
    reasons = F.when(fresh, F.array(F.lit("new: no provision of the old code corresponds"))).otherwise(F.array_compact(F.array(
        head, F.when(f("old_incomplete") == 0, F.concat(share("d.retention"), F.lit(" of the old text survives; "), share("d.novelty"), F.lit(" of the new text is new"))),
        F.when(F.size("d.mens_rea_added") > 0, F.concat(F.lit("mental state added: "), F.array_join("d.mens_rea_added", ", "))),
        F.when(F.size("d.mens_rea_removed") > 0, F.concat(F.lit("mental state dropped: "), F.array_join("d.mens_rea_removed", ", "))),
        F.when(f("punishment_changed") == 1, F.concat(F.lit("punishment "), F.col("d.direction"), F.lit(": "), F.col("d.punishment_old"), F.lit(" -> "), F.col("d.punishment_new"))),
        F.when(f("added_clauses") > 0, F.concat(F.col("d.added_clauses").cast("int").cast("string"), F.lit(" clause(s) without a counterpart"))),
        F.when(f("merge") == 1, F.concat(F.lit("merges "), F.size("olds").cast("string"), F.lit(" sections"))), F.when(f("split") == 1, "part of a section that was split"),
    )))
    return rows.select(
        "new_section", F.col("new_title").alias("title"), F.coalesce(F.col("olds.section"), F.array().cast("array<string>")).alias("old_sections"), cls.alias("drift_class"),
        F.when(fresh, 0.0).otherwise(carry_over(f, F.element_at("relations", 1))).alias("carry_over"), *[F.round(f(x), 6).alias(x) for x in pv.FEATURES],
        F.array_compact(F.array(*[F.when(f(x) == 1, F.lit(x)) for x in flags])).alias("flags"), reasons.alias("reasons"), F.col("d.added").alias("added"), F.col("d.lost").alias("lost"),
    )


#: The first reason of each class.
HEADS = {
    "IDENTICAL": "same text", "COSMETIC": "same law, reworded", "RESTRUCTURED": "same law, sections merged or split", "PUNISHMENT": "same offence, different punishment",
    "SUBSTANTIVE": "the provision itself changed", "UNVERIFIED": "the old text is incomplete; change not verified",
}


def _pair(olds: list[dict], at: int, text: str | None, title: str | None, split: bool, union: str | None) -> dict:
    texts, titles = [o["text"] or "" for o in olds], [o["title"] or "" for o in olds]
    if len(olds) > 1:
        f = pv.attributed(at, texts, titles, text or "", title or "", legal.punishment, bool(split))
    else:
        f, _ = pv.features(texts, titles, text or "", title or "", legal.punishment, False, bool(split))
    if union:  # a section that was split is kept as far as all its successors keep it
        f["retention"] = pv.aligned(pv.law_clauses(texts[at]), pv.law_clauses(union))["retention"]
    return f


def pair_drift(old: DataFrame, new: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(old_section, new_section, relation, drift_class, retention, carry_over) of every pair of the crosswalk."""
    pairs = sources(crosswalk)
    rows = _groups(with_numbers(old, numbers(pairs)), new, pairs).where("olds is not null")
    each = rows.select("new_section", "new_title", "new_text", "olds", "split", F.posexplode(F.arrays_zip("olds", "notes", "relations")).alias("at", "z"))
    both = pairs.join(new.select(F.col("section").alias("new"), "text"), "new").groupBy("old").agg(F.count("*").alias("n"), F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("new", "text"))), lambda x: x["text"])).alias("u"))
    union = both.where("n > 1").select(F.col("old").alias("old_section"), F.col("u").alias("union"))
    each = each.withColumn("old_section", F.col("z.olds.section")).join(union, "old_section", "left")
    each = each.withColumn("d", _mapped(_pair, f"struct<{_FEATURES}>")("olds", "at", "new_text", "new_title", "split", "union"))
    unexplained = _unexplained(F.col("z.notes"), F.col("z.olds.text"))
    f = lambda name: F.when(unexplained, 1.0).otherwise(F.col("d.old_incomplete")) if name == "old_incomplete" else F.col(f"d.{name}")
    judged = each.select("old_section", "new_section", F.col("z.relations").alias("relation"), drift_class(f).alias("drift_class"), F.round("d.retention", 6).alias("retention"), carry_over(f, F.col("z.relations")).alias("carry_over"))
    have = judged.select(F.col("old_section").alias("old"), F.col("new_section").alias("new"))
    prior = F.coalesce(*[F.when(F.col("relation") == k, F.lit(v)) for k, v in PRIOR.items()], F.lit(0.8))
    rest = pairs.join(have, ["old", "new"], "left_anti").select(F.col("old").alias("old_section"), F.col("new").alias("new_section"), "relation", F.lit("UNVERIFIED").alias("drift_class"), F.lit(None).cast("double").alias("retention"), prior.alias("carry_over"))
    return judged.unionByName(rest)


def dropped(old: DataFrame, new: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(section, title, inferred, share): old sections without a successor that were not repealed before.

    ``inferred`` is the new section that holds at least half of the wording, if one does; without it the section was dropped.
    """
    pairs = sources(crosswalk)
    left = with_numbers(old, numbers(pairs)).join(pairs.select(F.col("old").alias("section")).distinct(), "section", "left_anti")
    head = F.concat_ws(" ", F.regexp_replace("title", r"^[\[ ]+", ""), F.regexp_replace(F.substring("text", 1, 60), r"^[\[ ]+", ""))
    left = left.where(~F.coalesce(head.rlike("(?i)" + pv.PRE_REPEALED.pattern), F.lit(False)))
    words = vectorised(pv.law_words, "array<string>")
    a = left.select("section", "title", words("text").alias("w")).select("section", "title", "w", cp.bigrams(F.col("w")).alias("g"))
    b = new.select(F.col("section").alias("other"), words("text").alias("w")).select("other", F.explode(cp.bigrams(F.col("w"))).alias("gram"))
    hit = a.where(F.size("w") >= 5).select("section", F.size("g").alias("n"), F.explode("g").alias("gram")).join(b, "gram").groupBy("section", "other").agg((F.count("*") / F.first("n")).alias("share"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("share"), "other"))
    best = hit.withColumn("r", rank).where((F.col("r") == 1) & (F.col("share") >= INFERRED)).select("section", F.col("other").alias("inferred"), F.round("share", 3).alias("share"))
    return a.select("section", "title").join(best, "section", "left")


def carried(pairs: DataFrame, gone: DataFrame, asked: DataFrame) -> DataFrame:
    """(section, carry_over): of each asked old section the mean over its pairs, 0 where it was dropped, null where nothing is known."""
    mean = pairs.groupBy(F.col("old_section").alias("section")).agg(F.avg("carry_over").alias("c"))
    out = gone.where("inferred is null").select("section", F.lit(0.0).alias("z"))
    return asked.select("section").distinct().join(mean, "section", "left").join(out, "section", "left").select("section", F.round(F.coalesce("c", "z"), 6).alias("carry_over"))


def summary(report: DataFrame) -> DataFrame:
    """(drift_class, sections, carry_over): how many new sections changed in which way."""
    return report.groupBy("drift_class").agg(F.count("*").alias("sections"), F.round(F.avg("carry_over"), 6).alias("carry_over"))


def targets(asked: DataFrame, offences: DataFrame, new_code: str) -> DataFrame:
    """(query_id, target): the new sections that a question names, else those of the offences behind what it names.

    ``asked`` has (query_id, ref), ``offences`` (ref, offence_id); references are code:section.
    """
    code = F.substring_index("ref", ":", 1)
    named = asked.where(code == new_code).select("query_id", F.col("ref").alias("target")).distinct()
    other = asked.join(named, "query_id", "left_anti").join(offences, "ref").select("query_id", "offence_id").distinct()
    found = other.join(offences.where(code == new_code), "offence_id").select("query_id", F.col("ref").alias("target")).distinct()
    return named.unionByName(found)


def answer_flags(cited: DataFrame, report: DataFrame, gone: DataFrame, old_code: str, new_code: str) -> DataFrame:
    """(query_id, flag): sections that a sentence cites under the old code and that changed or were dropped.

    ``cited`` has (query_id, ref); equal flags of a question come once.
    """
    mine = cited.where(F.substring_index("ref", ":", 1) == old_code).select("query_id", F.substring_index("ref", ":", -1).alias("section")).distinct()
    moved = report.where(F.col("drift_class").isin("SUBSTANTIVE", "PUNISHMENT")).select(F.explode("old_sections").alias("section"), "new_section", F.element_at("reasons", 1).alias("why"))
    name = F.concat(F.lit(f"law changed: {old_code} "), F.col("section"))
    a = mine.join(moved, "section").select("query_id", F.concat(name, F.lit(f" -> {new_code} "), F.col("new_section"), F.lit(" ("), F.col("why"), F.lit(")")).alias("flag"))
    b = mine.join(gone.where("inferred is null").select("section"), "section").select("query_id", F.concat(name, F.lit(" was not re-enacted")).alias("flag"))
    return a.unionByName(b).distinct()


def stale_precedents(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, doc_id, flag) of judgments whose law carries over by less than ``least``; ``scores`` are those of ``compare.transfer``."""
    return scores.where(F.col("transfer") < least).select("query_id", "doc_id", F.concat(F.lit("stale precedent: "), F.round("transfer", 2).cast("string")).alias("flag"))


def what_changed(report: DataFrame, asked: DataFrame) -> DataFrame:
    """(ref, note): one text about each asked section of either code, from the reports that name it."""
    note = F.concat_ws("; ", F.concat(F.lit("section "), F.col("new_section"), F.lit(": "), F.lower("drift_class")), F.array_join("reasons", "; "))
    rows = report.select(F.explode(F.concat(F.array("new_section"), "old_sections")).alias("ref"), note.alias("note")).distinct()
    return asked.select(pv_base(F.col("ref")).alias("ref")).distinct().join(rows, "ref").groupBy("ref").agg(F.array_join(F.sort_array(F.collect_set("note")), " | ").alias("note"))


def pv_base(section: Column) -> Column:
    return F.lower(F.trim(F.substring_index(section, "(", 1)))


def gold_status(notes: DataFrame) -> DataFrame:
    """(new, gold): new, changed or retained, from the relations and notes (new, relation, note) that a crosswalk lists."""
    told = F.lower(F.coalesce("note", F.lit("")))
    fresh = F.bool_and(F.col("relation") == "new")
    changed = F.bool_or(told.rlike(r"chang|amend|modif|increas|reduc|add|omit|substitut|enhanc|widen") | (F.col("relation") == "modified"))
    return notes.groupBy("new").agg(F.when(fresh, "new").when(changed, "changed").otherwise("retained").alias("gold"))
