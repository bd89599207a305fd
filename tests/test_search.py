import math

import pytest

from lexweave.operators import index as ix
from lexweave.operators import predicates as pr
from lexweave.operators import score as sc

DOCS = [(1, "the bail was refused"), (2, "bail bail granted on appeal"), (3, "murder on the canal bridge"), (4, ""), (5, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").cache()


def test_bm25_by_hand(spark, docs):
    d = docs.where("text is not null")
    post, stats, norms = sc.search_tables(d, "doc_id", "text")
    terms = sc.query_terms(spark.createDataFrame([(7, "bail appeal bail")], "query_id long, text string"), "query_id", "text")
    got = {r.doc_id: r.score for r in sc.bm25(terms, post, stats, norms).collect()}
    lengths = {i: len((t or "").split()) for i, t in DOCS if t is not None}
    avg = sum(lengths.values()) / len(lengths)

    def part(w, df, tf, n):
        return w * math.log((4 - df + 0.5) / (df + 0.5) + 1) * tf * 2.6 / (tf + 1.6 * n / avg)

    assert got == pytest.approx({1: part(2, 2, 1, 4), 2: part(2, 2, 2, 5) + part(1, 1, 1, 5)})


def test_ties_go_to_the_larger_id(spark):
    s = spark.createDataFrame([("q", "a", 1.0), ("q", "b", 1.0), ("q", "c", 2.0)], "query_id string, doc_id string, score double")
    assert [(r.doc_id, r.rank) for r in sc.topk(s, 2).orderBy("rank").collect()] == [("c", 1), ("b", 2)]


def test_fusion(spark):
    runs = spark.createDataFrame([("q", "a", 1, 1.0), ("q", "b", 2, 1.0), ("q", "b", 1, 1.0)], "query_id string, doc_id string, rank int, weight double")
    assert {r.doc_id: r.score for r in sc.rrf(runs).collect()} == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61})
    c = spark.createDataFrame([("q", 1, "a", 4.0, 1.0), ("q", 1, "b", 3.0, 1.0), ("q", 1, "c", 2.0, 1.0), ("q", 2, "b", 5.0, 1.0)], "query_id string, run int, doc_id string, score double, weight double")
    assert {r.doc_id: r.score for r in sc.combsum(c).collect()} == pytest.approx({"a": 1.0, "b": 1.5, "c": 0.0})
    a = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0)], "query_id string, doc_id string, score double")
    b = spark.createDataFrame([("q", "c", 9.0)], "query_id string, doc_id string, score double")
    assert {r.doc_id: r.score for r in sc.mix(a, b, 0.5).collect()} == pytest.approx({"a": 0.5, "b": 0.25, "c": 0.5})
    assert {r.doc_id: r.score for r in sc.fuse(a, b, 0.5).collect()} == pytest.approx({"a": 1.0, "b": 0.5, "c": 0.5})


def test_boolean_queries(spark, docs):
    pos, universe = ix.token_rows(docs, "doc_id", "text"), docs

    def found(q):
        return sorted(r.doc_id for r in pr.evaluate(pr.parse(q).tree, pos, universe, frozenset({"was"})).collect())

    assert found("bail AND NOT granted") == [1]
    assert found('"on the canal"') == [3] and found("NOT bail") == [3, 4, 5]
    assert found("(murder OR appeal) AND on") == [2, 3] and found("gran* OR refus*") == [1, 2]
    assert found("murder /4 bridge") == [3] and found("bridge /3 murder") == [] and found("was AND bail") == [1, 2]


def test_parser():
    p = pr.parse('state:keshal after:2010 theft AND (bail OR "boundary wall") NOT murder')
    assert p.filters == {"state": "keshal", "after": "2010"} and pr.show(p.tree) == '(theft AND (bail OR "boundary wall") AND (NOT murder))'
    assert pr.positive_words(p.tree) == ["theft", "bail", "boundary", "wall"]
    assert pr.parse("(bail AND").tree is None and pr.parse("plain words").tree is None


def test_facets(spark):
    d = spark.sql("SELECT * FROM VALUES (1, array('keshal'), DATE'2012-05-01'), (2, array('*'), NULL), (3, array('anvadi'), DATE'2020-01-01') AS t(doc_id, states, date)")
    assert sorted(r.doc_id for r in pr.facets(d, states=["keshal"]).collect()) == [1, 2]
    assert sorted(r.doc_id for r in pr.facets(d, after="2012", before="2019").collect()) == [1]


def test_empty_corpus(spark, docs):
    post, stats, norms = sc.search_tables(docs.limit(0), "doc_id", "text")
    terms = sc.query_terms(spark.createDataFrame([(1, "bail")], "query_id long, text string"), "query_id", "text")
    assert sc.bm25(terms, post, stats, norms).count() == 0
