"""Loading judgments, provisions and crosswalks: reading what comes in many shapes into the tables the operators take.

Scans keep their filters and columns where the reader can use them; parsing happens in column expressions where SQL has them.
Defined results: null texts and names give nulls, unknown names ``?``; of several rows of a section the first number, or the
longest text, holds, as said; empty inputs give empty outputs.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import legal
from lexweave.functions.lexical import vectorised
from lexweave.functions.text import words
from lexweave.tables import small

#: Wording that begins a part of a judgment, tried in order.
CUES = (
    ("decision", r"(?i)\b(?:appeal|petition|application)s?\s+(?:is|are|stands?)\s+(?:hereby\s+)?(?:allowed|dismissed)|\bordered accordingly\b"),
    ("ratio", r"(?i)\bwe (?:hold|find)\b|\bit is (?:well )?settled\b|\bin (?:our|my) (?:view|opinion)\b"),
    ("arguments", r"(?i)\blearned counsel\b|\b(?:contended|submitted|argued)\b"), ("facts", r"(?i)\bfacts of the case\b|\bprosecution (?:case|story)\b|\bbriefly stated\b"),
)


def union_documents(*tables: DataFrame) -> DataFrame:
    """All documents of several tables, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def natural(section: str = "section") -> list[Column]:
    """The order of sections: by number, then by letter."""
    return [F.expr(f"try_cast(regexp_extract({section}, '^([0-9]+)', 1) as int)"), F.regexp_extract(section, r"^\d+(.*)$", 1)]


def bare_act(spark: SparkSession, folder: str) -> DataFrame:
    """(section, title, text, chapter) of a folder of JSON files, one section each or a list of them."""
    df = spark.read.schema("section string, number string, title string, heading string, text string, chapter string").option("multiLine", True).json(folder)
    got = df.select(F.lower(F.trim(F.coalesce("section", "number"))).alias("section"), F.coalesce("title", "heading").alias("title"), "text", "chapter")
    return first_number_wins(got.where("section <> ''"))


def first_number_wins(sections: DataFrame, keep_repealed: bool = False) -> DataFrame:
    """One row for each section: of repeats the longest text; repealed ones go unless asked for."""
    rows = sections if keep_repealed else sections.where(~F.coalesce(F.concat_ws(" ", "title", F.substring("text", 1, 60)).rlike(r"(?i)^\W*(?:rep\.|repealed|omitted)\b"), F.lit(False)))
    others = [c for c in sections.columns if c != "section"]
    longest = F.max(F.struct(F.length(F.coalesce("text", F.lit(""))).alias("_n"), *others)).alias("r")
    return rows.groupBy("section").agg(longest).select("section", *[f"r.{c}" for c in others])


def central_act(spark: SparkSession, path: str, act: str) -> DataFrame:
    """(section, title, text) of one act of a table of all acts; only four columns and the act's rows are read."""
    rows = spark.read.parquet(path).select("act_id", "section", "title", "text").where(F.col("act_id") == act)
    return first_number_wins(rows.select(F.lower("section").alias("section"), "title", "text"))


def judgments_since(spark: SparkSession, path: str, since: str, wording: str, chars: int = 20_000) -> DataFrame:
    """Judgments from a day on whose first ``chars`` characters have a wording: the reading of a large corpus down to a topic."""
    df = spark.read.parquet(path)
    pick = lambda *names: F.col(next(n for n in names if n in df.columns))
    rows = df.select(pick("id", "doc_id").alias("doc_id"), pick("title", "case_title").alias("title"), pick("date", "decision_date").cast("string").alias("date"), pick("text", "body").alias("text"))
    return rows.where((F.col("date") >= since) & F.substring("text", 1, chars).rlike(wording))


def monthly_sample(df: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """At most ``n`` rows of each court and month (court, month, doc_id), the same on every run."""
    rank = F.row_number().over(Window.partitionBy("court", "month").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    return df.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def doc_store(docs: DataFrame, kinds_out: tuple[str, ...] = ("query_case",)) -> DataFrame:
    """The documents that may be looked up: all but those of certain kinds."""
    return docs.where(~F.coalesce(F.col("doc_type").isin(*kinds_out), F.lit(False)))


def store_snippet(docs: DataFrame, chars: int = 200) -> DataFrame:
    """(doc_id, snippet): the beginning of each text, cut at a word."""
    head = F.substring("text", 1, chars)
    return docs.select("doc_id", F.when(F.length("text") <= chars, F.col("text")).otherwise(F.regexp_replace(head, r"\s+\S*\z", "…")).alias("snippet"))


def cue_zone(text: Column) -> Column:
    """The part of a judgment that a paragraph's wording begins, null where it doesn't tell."""
    return F.coalesce(*[F.when(text.rlike(cue), F.lit(zone)) for zone, cue in CUES])


def cue_zones(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para, zone): each paragraph's own cue, else the zone before it, facts at the start."""
    own = cue_zone(F.col("text"))
    carried = F.last(own, ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("para"))
    return paragraphs.select("doc_id", "para", F.coalesce(carried, F.lit("facts")).alias("zone"))


def provision_name(name: Column, acts: dict[str, str]) -> Column:
    """{code, section, act} of "Section 302 in The X Code, 1868"; ``acts`` has patterns of act names by code, others get a slug."""
    section = F.lower(F.regexp_extract(name, r"(?i)(?:section|article|rule)\s+(\d+[A-Za-z]*)", 1))
    act = F.trim(F.regexp_extract(name, r"(?i)\bin\s+(.+)$", 1))
    slug = F.regexp_replace(F.trim(F.regexp_replace(F.lower(act), r"[^a-z0-9]+", " ")), " ", "-")
    code = F.coalesce(*[F.when(F.lower(act).rlike(p), F.lit(c)) for c, p in acts.items()], F.when(slug != "", slug), F.lit("?"))
    return F.struct(code.alias("code"), F.nullif(section, F.lit("")).alias("section"), F.nullif(act, F.lit("")).alias("act"))


def sub_sections(text: Column) -> Column:
    """The sub-sections of a provision; a number in brackets after a word that refers to one doesn't begin another."""
    return F.filter(F.transform(F.split(text, r"(?<!section )(?<!sub-section )(?<!clause )(?=\(\d{1,2}\) )"), lambda x: F.trim(x)), lambda x: x != "")


def with_heading(docs: DataFrame) -> DataFrame:
    """Statutes (ref, title, text) as documents whose paragraph -1 is their heading."""
    head = F.concat(F.lit("Section "), F.upper(F.substring_index("ref", ":", -1)), F.lit(" "), F.upper(F.substring_index("ref", ":", 1)), F.lit(". "), F.coalesce("title", F.lit("")))
    para = lambda t, i: F.struct(t.alias("text"), F.lit("statute").alias("zone"), i.alias("para_id"))
    subs = F.transform(sub_sections(F.coalesce("text", F.lit(""))), lambda t, i: para(t, i.cast("int")))
    return docs.select(F.col("ref").alias("doc_id"), F.lit("statute").alias("doc_type"), "title", F.concat(F.array(para(head, F.lit(-1))), subs).alias("paragraphs"))


def enriched(docs: DataFrame, courts: DataFrame, chars: int = 1500) -> DataFrame:
    """``docs`` (doc_id, jurisdiction, date, text) with court, states and date from what is given, else from the head of the text.

    ``courts`` is the fixed list (court_name, name_pattern, level, states); the first that matches, by name, holds.
    """
    head = F.lower(F.concat_ws(" ", F.coalesce("jurisdiction", F.lit("")), F.substring("text", 1, chars)))
    listed = courts.select("court_name", F.lower("name_pattern").alias("p"), "states").where("p is not null").distinct()
    hit = docs.select("doc_id", head.alias("h")).join(small(listed), F.expr("h rlike p")).groupBy("doc_id").agg(F.min(F.struct("court_name", "states")).alias("c"))
    given = F.expr("cast(try_to_date(substring(date, 1, 10)) as string)")
    found = vectorised(legal.decision_date, "string")(F.substring("text", 1, chars))
    return docs.join(hit, "doc_id", "left").select(docs["*"], F.col("c.court_name").alias("court"), F.split("c.states", ";").alias("states"), F.coalesce(given, found).alias("decision_date"))


def reference_strings(text: str | None) -> list[str]:
    """The sections of a crosswalk's cell: lists, ranges of up to 80, "(2)" as another sub-section of the one before; words of status are skipped."""
    out: list[str] = []
    flat = re.sub(r"\b(?:new|deleted|omitted|repealed|modified|added|no|corresponding|section|sections|sec|ss|s)\b\.?", " ", (text or "").lower())
    for part in re.split(r"[,;&/]|\band\b|\n", flat):
        part = re.sub(r"\b[a-z]{2,}\b", " ", part).strip()
        span = re.fullmatch(r"(\d{1,3})\s*(?:-|–|to)\s*(\d{1,3})", part)
        if span and 0 < int(span[2]) - int(span[1]) <= 80:
            out += map(str, range(int(span[1]), int(span[2]) + 1))
        elif re.fullmatch(r"(?:\(\d+\))+", part) and out:
            out.append(out[-1].split("(")[0] + part)
        else:
            out += [m.replace(" ", "") for m in re.findall(r"\d{1,3}\s?[a-z]{0,2}(?:\s?\([0-9a-z]+\))*", part)]
    return list(dict.fromkeys(out))


def crosswalk_rows(cells: DataFrame) -> DataFrame:
    """(old, new, note) of rows (old_cell, new_cell, note), every section of one cell with every one of the other."""
    read = vectorised(reference_strings, "array<string>")
    both = cells.select(read(F.coalesce("old_cell", F.lit(""))).alias("o"), read(F.coalesce("new_cell", F.lit(""))).alias("n"), "note")
    return both.select(F.explode("o").alias("old"), "n", "note").select("old", F.explode("n").alias("new"), "note").distinct()


def source_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(old, new, only): pairs that only one of two crosswalks has."""
    x, y = a.select("old", "new").distinct(), b.select("old", "new").distinct()
    return x.join(y, ["old", "new"], "left_anti").withColumn("only", F.lit("a")).unionByName(y.join(x, ["old", "new"], "left_anti").withColumn("only", F.lit("b")))


def shared_ids(components: DataFrame, new_code: str) -> DataFrame:
    """(ref, provision_id): the sections of a component named after its lowest new section; ``components`` has (node, component), nodes code:section."""
    section = F.substring_index("node", ":", -1)
    is_new = F.substring_index("node", ":", 1) == new_code
    number, letter = F.expr("try_cast(regexp_extract(substring_index(node, ':', -1), '^([0-9]+)', 1) as int)"), F.regexp_extract(section, r"^\d+(.*)$", 1)
    low = components.where(is_new).groupBy("component").agg(F.min(F.struct(number.alias("n"), letter.alias("l"), F.col("node"))).alias("r"))
    return components.join(low, "component").select(F.col("node").alias("ref"), F.concat(F.lit("prov:"), F.translate("r.node", ":", "-")).alias("provision_id"))


def alignment_accuracy(aligned: DataFrame, known: DataFrame) -> DataFrame:
    """(pairs, accuracy): the share of known pairs (old, new) that an alignment has."""
    hit = known.select("old", "new").distinct().join(aligned.select("old", "new").distinct().withColumn("h", F.lit(1)), ["old", "new"], "left")
    return hit.agg(F.count("*").alias("pairs"), F.avg(F.coalesce("h", F.lit(0)).cast("double")).alias("accuracy"))


def judgment_documents(docs: DataFrame, least: int = 8) -> DataFrame:
    """(doc_id, statutes_cited, by_code, paragraphs) of plain judgments (doc_id, text): paragraphs of ``least`` words, sections cited, their number by code."""
    mention = vectorised(legal.section_mentions, legal.MENTION_TYPE)
    rows = docs.where("text is not null").withColumn("m", mention("text"))
    refs = F.array_distinct(F.transform("m", lambda x: F.concat_ws(":", x["code"], x["section"])))
    paras = F.filter(F.split("text", r"\n\s*\n"), lambda p: F.size(F.split(F.trim(p), r"\s+")) >= least)
    codes = F.array_distinct(F.transform("m", lambda x: x["code"]))
    counts = F.map_from_arrays(codes, F.transform(codes, lambda c: F.size(F.filter("m", lambda x: x["code"] == c))))
    return rows.select("doc_id", refs.alias("statutes_cited"), counts.alias("by_code"), paras.alias("paragraphs"))


def chapters(sections: DataFrame) -> DataFrame:
    """(code, chapter, sections, terms): the table of contents, sections in their order; a code's chapter is a bounded group."""
    rows = sections.where("chapter is not null").select("code", "chapter", "section", *[c.alias(n) for c, n in zip(natural(), ("n", "l"))], words(F.col("title")).alias("w"))
    by = rows.groupBy("code", "chapter").agg(F.sort_array(F.collect_list(F.struct("n", "l", "section"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("terms"))
    return by.select("code", "chapter", F.col("s.section").alias("sections"), "terms")


def case_name(title: Column) -> Column:
    """A case's name without a trailing stop or date; untitled ones say so."""
    t = F.regexp_replace(F.regexp_replace(F.trim(title), r"(?i)\s+on\s+\d{1,2}\s+\w+,?\s+\d{4}$", ""), r"[.\s]+$", "")
    return F.when(F.coalesce(t, F.lit("")) == "", "untitled case").otherwise(t)


def write_table(parts: list[DataFrame], path: str) -> None:
    """Rows of several shapes as one CSV; columns in the order in which they come up."""
    union_documents(*parts).write.mode("overwrite").option("header", True).csv(path)


def save_lists(df: DataFrame, path: str, sep: str = ";") -> None:
    """A table with lists as CSV, lists joined, nulls and not-a-numbers blank."""
    flat = [F.array_join(c, sep).alias(c) if k.startswith("array") else F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def load_lists(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...], sep: str = ";") -> DataFrame:
    """What ``save_lists`` wrote; ``schema`` has the lists as strings, blank ones are empty lists."""
    df = spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)
    return df.withColumns({c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, sep)) for c in lists})


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def save_vectors(df: DataFrame, path: str) -> None:
    """(doc_id, embedding) with unit length, as floats; vectors without a length are left out."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    df.where(n > 0).select("doc_id", F.transform("embedding", lambda x: (x / n).cast("float")).alias("embedding")).write.mode("overwrite").parquet(path)
