"""Filters over postings and facets: Boolean trees, phrases, proximity, wildcards, dates, states, eras."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = {"AND", "OR", "NOT"}
FILTERS = ("state", "date", "code", "court", "type", "after", "before", "era")


@dataclass(frozen=True)
class Node:
    """A Boolean query: TERM, PHRASE, AND, OR, NOT or PROX over parts; PROX has a distance."""

    kind: str
    terms: tuple[str, ...] = ()
    parts: tuple["Node", ...] = ()
    distance: int = 0


@dataclass
class Parsed:
    text: str
    filters: dict[str, str] = field(default_factory=dict)
    tree: Node | None = None


def parse(query: str, max_words: int = 60) -> Parsed:
    """Split off ``name:value`` filters and read the rest as a Boolean query; what can't be read is free text.

    Precedence from the tightest: proximity (/k), NOT, AND (also by adjacency), OR.
    """
    filters = {}

    def take(m: re.Match) -> str:
        filters[m[1].lower()] = m[2].strip('"')
        return " "

    text = re.sub(rf"\b({'|'.join(FILTERS)}):(\"[^\"]*\"|\S+)", take, query).strip()
    tokens = re.findall(r'"[^"]*"|[()]|/\d+|[^\s()"]+', text)
    if len(tokens) > max_words or not any(t in KEYWORDS or t[0] in '"(/' or "*" in t for t in tokens):
        return Parsed(text, filters)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def unit() -> Node:
        nonlocal at
        t = peek()
        if t is None or t in ("AND", "OR", ")") or t.startswith("/"):
            raise ValueError
        at += 1
        if t == "(":
            inner = either()
            if peek() != ")":
                raise ValueError
            at += 1
            return inner
        if t.startswith('"'):
            words = re.findall(r"\w+", t.lower())
            if not words:
                raise ValueError
            return Node("PHRASE", tuple(words)) if len(words) > 1 else Node("TERM", tuple(words))
        return Node("TERM", (t.lower(),))

    def near() -> Node:
        nonlocal at
        left = unit() if peek() != "NOT" else negated()
        while (t := peek()) and re.fullmatch(r"/\d+", t):
            at += 1
            left = Node("PROX", parts=(left, unit()), distance=int(t[1:]))
        return left

    def negated() -> Node:
        nonlocal at
        if peek() == "NOT":
            at += 1
            return Node("NOT", parts=(negated(),))
        return near()

    def both() -> Node:
        nonlocal at
        parts = [negated()]
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                at += 1
            parts.append(negated())
        return parts[0] if len(parts) == 1 else Node("AND", parts=tuple(parts))

    def either() -> Node:
        nonlocal at
        parts = [both()]
        while peek() == "OR":
            at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else Node("OR", parts=tuple(parts))

    try:
        tree = either()
        return Parsed(text, filters, tree if at == len(tokens) else None)
    except ValueError:
        return Parsed(text, filters)


def show(node: Node) -> str:
    """A readable form of a tree."""
    if node.kind == "TERM":
        return node.terms[0]
    if node.kind == "PHRASE":
        return '"' + " ".join(node.terms) + '"'
    if node.kind == "NOT":
        return f"(NOT {show(node.parts[0])})"
    word = f" /{node.distance} " if node.kind == "PROX" else f" {node.kind} "
    return "(" + word.join(map(show, node.parts)) + ")"


def positive_words(node: Node) -> list[str]:
    """The words that are not under a NOT, for ranking."""
    if node.kind == "NOT":
        return []
    return [*node.terms, *(w for p in node.parts for w in positive_words(p))]


def _like(term: str) -> Column:
    return F.col("term") == term if "*" not in term else F.col("term").like(term.replace("_", r"\_").replace("*", "%"))


def evaluate(node: Node, positions: DataFrame, universe: DataFrame, stop: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id): the documents a tree matches. ``positions`` has (doc_id, pos, term); a stop word constrains nothing."""
    if node.kind == "TERM":
        if node.terms[0] in stop:
            return universe.select("doc_id")
        return positions.where(_like(node.terms[0])).select("doc_id").distinct()
    if node.kind == "PHRASE":
        return phrase(positions, [t for t in node.terms if t not in stop]).select("doc_id").distinct()
    if node.kind == "AND":
        plus = [p for p in node.parts if p.kind != "NOT"]
        out = reduce(lambda a, b: a.join(b, "doc_id", "left_semi"), [evaluate(p, positions, universe, stop) for p in plus]) if plus else universe.select("doc_id")
        for p in node.parts:
            if p.kind == "NOT":
                out = out.join(evaluate(p.parts[0], positions, universe, stop), "doc_id", "left_anti")
        return out
    if node.kind == "OR":
        return reduce(DataFrame.union, [evaluate(p, positions, universe, stop) for p in node.parts]).distinct()
    if node.kind == "NOT":
        return universe.select("doc_id").join(evaluate(node.parts[0], positions, universe, stop), "doc_id", "left_anti")
    sides = [p for p in node.parts if not (p.kind == "TERM" and p.terms[0] in stop)]
    if len(sides) < 2:
        return evaluate(sides[0], positions, universe, stop) if sides else universe.select("doc_id")
    return near(_starts(sides[0], positions), _starts(sides[1], positions), node.distance)


def _starts(node: Node, positions: DataFrame) -> DataFrame:
    if node.kind == "PHRASE":
        return phrase(positions, list(node.terms))
    if node.kind == "TERM":
        return positions.where(_like(node.terms[0])).select("doc_id", "pos")
    return reduce(DataFrame.union, [_starts(p, positions) for p in node.parts])


def phrase(positions: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, pos) of the phrase's starts: one aggregation over the wanted terms, no join."""
    if not terms:
        return positions.select("doc_id", "pos").limit(0)
    off = F.explode(F.coalesce(*[F.when(F.col("term") == t, F.array(*[F.lit(i) for i, x in enumerate(terms) if x == t])) for t in dict.fromkeys(terms)])).alias("off")
    hits = positions.where(F.col("term").isin(terms)).select("doc_id", "pos", off)
    return hits.groupBy("doc_id", (F.col("pos") - F.col("off")).alias("pos")).agg(F.count_distinct("off").alias("n")).where(F.col("n") == len(terms)).select("doc_id", "pos")


def near(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(doc_id) with places of both sides at most ``k`` apart, by buckets of k + 1 so the join has keys besides the document."""
    x = a.select("doc_id", F.col("pos").alias("p1"), F.floor(F.col("pos") / (k + 1)).alias("cell"))
    y = b.select("doc_id", F.col("pos").alias("p2"), F.explode(F.array(*[F.floor(F.col("pos") / (k + 1)) + d for d in (-1, 0, 1)])).alias("cell"))
    return x.join(y, ["doc_id", "cell"]).where(F.abs(F.col("p1") - F.col("p2")) <= k).select("doc_id").distinct()


def clauses(positions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, doc_id) that hit every clause of (query_id, clause, term): relational division for a batch of queries."""
    need = wanted.groupBy("query_id").agg(F.count_distinct("clause").alias("need"))
    hit = positions.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count_distinct("clause").alias("have"))
    return hit.join(need, "query_id").where("have = need").select("query_id", "doc_id")


def facets(docs: DataFrame, equal: dict[str, str | None] | None = None, states: list[str] | None = None, state_col: str = "states", cites: list[str] | None = None, cite_col: str = "cites", date_col: str = "date", after: str | None = None, before: str | None = None) -> DataFrame:
    """The conjunction of facet filters; ``None`` constrains nothing, ``*`` among the states binds everywhere, undated fails a date range."""
    out = docs
    for c, v in (equal or {}).items():
        if v is not None:
            out = out.where(F.col(c) == v)
    if states is not None:
        out = out.where(F.arrays_overlap(F.col(state_col), F.array(*[F.lit(s) for s in [*states, "*"]])))
    if cites is not None:
        out = out.where(F.arrays_overlap(F.col(cite_col), F.array(*[F.lit(s) for s in cites])))
    if after:
        out = out.where(F.col(date_col) >= F.to_date(F.lit(f"{after}-01-01" if len(after) == 4 else after)))
    if before:
        out = out.where(F.col(date_col) <= F.to_date(F.lit(f"{before}-12-31" if len(before) == 4 else before)))
    return out


def era_of(cites: Column, new: list[str], old: list[str]) -> Column:
    """``new`` when a new code is cited, else ``old`` when an old one is, else null."""
    has = lambda codes: F.exists(cites, lambda r: F.split_part(r, F.lit(":"), F.lit(1)).isin(codes))
    return F.when(has(new), "new").when(has(old), "old")


def case_query(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+")) >= 50


def tiered(first: DataFrame, second: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id): the first tier's matches, and the second's where the first has fewer than ``least``."""
    n = first.groupBy("query_id").agg(F.count("*").alias("n"))
    rest = second.join(n, "query_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("query_id", "doc_id")
    return first.select("query_id", "doc_id").union(rest).distinct()
