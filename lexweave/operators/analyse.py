"""From a question to weighted terms: filters, era, wildcards, language, spelling, lexicon, sections, offences.

The same word pipeline serves documents and questions: words with section tokens, stop words out, stems, bare section numbers
resolved by the words around them, offences beside the sections that state them. Questions are a stated batch; what they are
looked up in (vocabulary, lexicon, section tables) is joined, never sent.

Defined results: null and empty texts have no terms; a question that is only filters has none either; terms that several
steps give keep their largest weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import legal, lexical
from lexweave.functions.text import WORD, char_bigrams, era
from lexweave.operators import predicates as pr
from lexweave.operators import score as sc
from lexweave.operators import spell as sp
from lexweave.operators import versions as vs

#: Weights of wildcard, corrected, same-sounding and other-code terms; words up to which spelling is corrected.
W_WILDCARD, W_SPELLING, W_SOUND, W_OTHER_CODE, MAX_WORDS, CONTEXT = 0.8, 0.9, 0.3, 0.8, 40, 10
#: Hindi function words in Latin letters.
HINGLISH = frozenset("mera mere meri mujhe hai hain tha thi the ka ki ke ko se ne mein par aur ya kya kyun kaise nahi ho gaya gayi diya kiya kar raha rahi wala woh yeh ye unhone usne maine hum aap".split())
_TOKEN = re.compile(rf"sec:[a-z?]+:[0-9a-z()]+|{WORD.replace(chr(92) + 'x{0900}-' + chr(92) + 'x{0DFF}' + chr(92) + 'x{0600}-' + chr(92) + 'x{06FF}', 'ऀ-෿؀-ۿ')}")
_WILD = re.compile(r"\S*\*\S*")


@dataclass(frozen=True)
class Resources:
    """Fixed, bounded tables of the word pipeline: stop words, codes of a bare number, telling words of a code, new codes, the day of change."""

    stop: frozenset[str] = frozenset()
    codes_of: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keywords: dict[str, frozenset[str]] = field(default_factory=dict)
    new: frozenset[str] = frozenset()
    change: str = "2024-07-01"


def language(text: str) -> str:
    """hi with Devanagari, hinglish from a fifth of its function words on, else en."""
    if re.search("[ऀ-ॿ]", text):
        return "hi"
    words = re.findall("[a-z]+", text.lower())
    clear = [w for w in words if w in HINGLISH and w not in ("the", "par", "ho", "hum")]
    return "hinglish" if clear and sum(w in HINGLISH for w in words) >= 0.2 * len(words) else "en"


def resolved(tokens: list[str], res: Resources, when: str | None, sure: float = 0.7) -> list[str]:
    """Bare section tokens by the ten tokens on both sides; the runner-up comes too where the best reading is under ``sure``."""
    out = []
    for i, t in enumerate(tokens):
        kind, _, rest = t.partition(":")
        code, _, number = rest.partition(":")
        options = res.codes_of.get(number, ()) if kind == "sec" and code == "?" else ()
        if not options:
            out.append(t)
            continue
        around = {*tokens[max(0, i - CONTEXT) : i], *tokens[i + 1 : i + 1 + CONTEXT]}
        readings = legal.resolve_collision(list(options), around, res.keywords, set(res.new), when)
        out += [f"sec:{c}:{number}" for c, share in readings[: 1 if readings[0][1] >= sure else 2]]
    return out


def pipeline(text: str | None, res: Resources, when: str | None = None, stems: bool = True) -> list[str]:
    """The index terms of a text."""
    tokens = [t for t in _TOKEN.findall(legal.section_tokens(text).lower()) if t.startswith("sec:") or t not in res.stop]
    return resolved([_stem(t) for t in tokens] if stems else tokens, res, when)


_stem = lru_cache(maxsize=200_000)(lexical.stem)


def document_tokens(docs: DataFrame, text: str, res: Resources, stems: bool = True) -> DataFrame:
    """``docs`` with a column ``tokens``."""
    return docs.withColumn("tokens", lexical.vectorised(lambda t: pipeline(t, res, None, stems), "array<string>")(F.col(text)))


def _read(q: pd.Series, res: Resources) -> dict:
    parsed = pr.parse(q["text"] or "")
    filters = dict(parsed.filters)
    for key, edge, rest in (("after", "date_from", "-01-01"), ("before", "date_to", "-12-31")):
        if key in filters:
            filters.setdefault(edge, filters[key] + rest if re.fullmatch(r"\d{4}", filters[key]) else filters[key])
    text = " ".join(pr.positive_words(parsed.tree)) if parsed.tree is not None else parsed.text
    wild = [w.lower() for w in _WILD.findall(parsed.text) if len(w.replace("*", "")) >= 2]
    text = _WILD.sub(" ", text)
    lang = q.get("lang") or language(text)
    roman = lexical.romanise(text) if lang == "hi" else text
    kept = {i for m in legal.section_mentions(roman) for i in range(m["start"], m["end"])} if lang in ("hi", "hinglish") else set()
    normal = re.sub("[A-Za-z]+", lambda m: m[0] if m.start() in kept else lexical.normal_roman(m[0]) or m[0], roman) if lang in ("hi", "hinglish") else roman
    date = q.get("incident_date") or filters.get("date")
    when = None if not date else "new" if str(date) >= res.change else "old"
    meant = normal if lang == "en" else re.sub("[A-Za-z]+", lambda m: "" if m[0].lower() in HINGLISH else m[0], normal)
    tokens = pipeline(meant, res, when)
    words = [w for w in re.findall(r"[^\W\d_]+", normal.lower()) if w not in HINGLISH and w not in res.stop]
    return {
        "lang": lang, "normal": normal, "tokens": tokens, "words": words, "wild": wild, "filters": filters, "tree": pr.show(parsed.tree) if parsed.tree is not None else None,
        "when": when or "?", "n_words": len(normal.split()), "state": q.get("state") or filters.get("state"),
    }


READ = "query_id string, text string, lang string, normal string, tokens array<string>, words array<string>, wild array<string>, filters map<string,string>, tree string, when string, n_words int, state string"


def read(queries: DataFrame, res: Resources) -> DataFrame:
    """Questions (query_id, text, lang?, state?, incident_date?) taken apart: language, normal spelling, tokens, wildcards, filters, tree, law in force."""
    cols = [c for c in ("lang", "state", "incident_date") if c in queries.columns]
    rows = queries.select(F.col("query_id").cast("string").alias("query_id"), "text", *[F.col(c).cast("string").alias(c) for c in cols])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [{"query_id": q["query_id"], "text": q["text"], **_read(q, res)} for q in b.to_dict("records")]
            yield pd.DataFrame(got, columns=[p.split()[0] for p in READ.replace("map<string,string>", "map").split(", ")])

    return rows.mapInPandas(run, READ)


def wildcards(asked: DataFrame, vocabulary: DataFrame, most: int = 30) -> DataFrame:
    """(query_id, pattern, term): vocabulary terms that match a pattern, the most frequent ``most``, through an index of letter pairs."""
    p = asked.select("query_id", F.explode("wild").alias("pattern")).distinct()
    framed = F.concat(F.lit("$"), "pattern", F.lit("$"))
    pieces = F.filter(F.split(framed, r"\*"), lambda x: F.length(x) >= 2)
    key = F.substring(F.element_at(F.array_sort(pieces, lambda a, b: F.length(b) - F.length(a)), 1), 1, 2)
    keyed = p.withColumn("k", key).where("k is not null")
    v = vocabulary.select("term", "df", F.explode(char_bigrams(F.col("term"))).alias("k"))
    hit = v.join(keyed, "k").where(F.expr("term like replace(replace(pattern, '_', '\\\\_'), '*', '%')"))
    rank = F.row_number().over(Window.partitionBy("query_id", "pattern").orderBy(F.desc("df"), "term"))
    return hit.select("query_id", "pattern", "term", "df").distinct().withColumn("r", rank).where(F.col("r") <= most).select("query_id", "pattern", "term")


def terms(asked: DataFrame, vocabulary: DataFrame, lexicon: DataFrame | None = None, section_offence: DataFrame | None = None) -> DataFrame:
    """(query_id, term, weight) of questions that ``read`` took apart, against a vocabulary (term, df)."""
    own = asked.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))
    parts = [own, wildcards(asked, vocabulary).select("query_id", "term", F.lit(W_WILDCARD).alias("weight"))]
    plain = own.where(~F.col("term").contains(":") & F.col("term").rlike("^[a-z]{4,}$"))
    short = asked.where(F.col("n_words") <= MAX_WORDS).select("query_id")
    unseen = plain.join(short, "query_id", "left_semi").join(vocabulary.select("term"), "term", "left_anti").select("query_id", F.col("term").alias("word"))
    fixed = sp.corrections(unseen.select("word").distinct(), vocabulary.where("df >= 2"))
    parts.append(unseen.join(fixed.select("word", "term"), "word").select("query_id", "term", F.lit(W_SPELLING).alias("weight")))
    hindi = asked.where(F.col("lang").isin("hi", "hinglish")).select("query_id", F.explode("words").alias("word")).distinct()
    if lexicon is not None:
        found = sp.lexicon_lookup(hindi.select("word").distinct(), lexicon)
        stem = lexical.vectorised(lexical.stem, "string")
        parts.append(hindi.join(found, "word").select("query_id", F.explode(F.split(F.lower("english"), r"\s+")).alias("term"), "weight").select("query_id", stem("term").alias("term"), "weight"))
    code = lexical.vectorised(lexical.hindi_soundex, "string")
    sound = hindi.where(F.length("word") >= 5).join(vocabulary.select(F.col("term").alias("word")), "word", "left_anti").select("query_id", "word", code("word").alias("p"))
    near = sound.join(vocabulary.where(F.col("term").rlike("^[a-z]{5,}$")).select("term", code("term").alias("p")), "p")
    few = near.withColumn("n", F.count("*").over(Window.partitionBy("query_id", "word"))).where("n <= 3")
    parts.append(few.select("query_id", "term", F.lit(W_SOUND).alias("weight")))
    if section_offence is not None:
        named = own.where("term like 'sec:%'").select("query_id", F.substring("term", 5, 200).alias("ref"))
        other = named.join(vs.equivalents(section_offence), "ref").select("query_id", F.concat(F.lit("sec:"), "other").alias("term"), F.lit(W_OTHER_CODE).alias("weight"))
        meant = vs.offences(named, section_offence).select("query_id", F.col("offence_id").alias("term"), "weight")
        parts += [other, meant]
    return sc.merge_terms(*parts)


def with_era(asked: DataFrame, new: str, old: str) -> DataFrame:
    """The questions with ``era``, the law their wording asks for."""
    return asked.withColumn("era", era(F.col("text"), new, old))


def corrected_text(asked: DataFrame, fixes: DataFrame) -> DataFrame:
    """(query_id, text): the question with its corrections (query_id, word, term) put in word by word, by the word or its stem."""
    stem = lexical.vectorised(lexical.stem, "string")
    words = asked.select("query_id", F.posexplode(F.split("text", r"\s+")).alias("i", "w")).withColumn("k", F.lower("w")).withColumn("s", stem("k"))
    f = fixes.select("query_id", F.col("word").alias("fw"), F.col("term").alias("ft"))
    both = words.join(f, "query_id", "left").withColumn("hit", F.when((F.col("k") == F.col("fw")) | (F.col("s") == F.col("fw")), F.col("ft")))
    one = both.groupBy("query_id", "i", "w").agg(F.max("hit").alias("hit"))
    return one.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("hit", "w").alias("w")))), lambda x: x["w"]), " ").alias("text"))


def fuse_short(lexical_: DataFrame, grams: DataFrame, dense: DataFrame | None, asked: DataFrame, confidence: DataFrame, trigram: float = 0.2, dense_max: float = 0.5, least: float = 0.3) -> DataFrame:
    """(query_id, doc_id, score) of short questions: the weaker the lexical list, the more the vectors carry.

    Word trigrams count from three words on, and not where a section is named. ``confidence`` has (query_id, confidence).
    """
    allowed = asked.where((F.col("n_words") >= 3) & ~F.exists("tokens", lambda t: t.startswith("sec:"))).select("query_id")
    ng = sc.max_normal(grams.join(allowed, "query_id", "left_semi")).select("query_id", "doc_id", F.col("score").alias("g"))
    dn = sc.min_max(dense).select("query_id", "doc_id", F.col("score").alias("v")) if dense is not None else None
    both = lexical_.select("query_id", "doc_id", F.col("score").alias("l")).join(ng, ["query_id", "doc_id"], "full")
    both = both.join(dn, ["query_id", "doc_id"], "full") if dn is not None else both.withColumn("v", F.lit(None).cast("double"))
    w = Window.partitionBy("query_id")
    c = both.join(confidence.select("query_id", "confidence"), "query_id", "left")
    has = lambda name: F.max(F.col(name).isNotNull()).over(w)
    c = c.withColumn("wv", F.when(has("v"), dense_max * (1 - F.coalesce("confidence", F.lit(0.5)))).otherwise(0.0)).withColumn("wg", F.when(has("g"), trigram).otherwise(0.0))
    c = c.withColumn("wl", F.greatest(F.lit(least), 1 - F.col("wv") - F.col("wg")))
    zero = lambda name: F.coalesce(name, F.lit(0.0))
    score = (F.col("wl") * zero("l") + F.col("wg") * zero("g") + F.col("wv") * zero("v")) / (F.col("wl") + F.col("wg") + F.col("wv"))
    return c.select("query_id", "doc_id", score.alias("score"))


def fuse_long(lexical_: DataFrame, grams: DataFrame, dense: DataFrame | None, confidence: DataFrame, beta: float = 0.8) -> DataFrame:
    """(query_id, doc_id, score) of pasted judgments: trigrams lead; vectors join by 0.4 + 0.5 confidence, 0.7 without one."""
    mixed = sc.mix(lexical_, grams, beta)
    if dense is None:
        return mixed
    x, y = sc.min_max(mixed).withColumnRenamed("score", "a"), sc.min_max(dense).withColumnRenamed("score", "b")
    w = Window.partitionBy("query_id")
    both = x.join(y, ["query_id", "doc_id"], "full").join(confidence.select("query_id", "confidence"), "query_id", "left")
    alpha = F.coalesce(0.4 + 0.5 * F.col("confidence"), F.lit(0.7))
    low = lambda c: F.coalesce(F.col(c), F.min(c).over(w), F.lit(0.0))
    return both.select("query_id", "doc_id", (alpha * low("a") + (1 - alpha) * low("b")).alias("score"))
