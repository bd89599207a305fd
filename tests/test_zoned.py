import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import index as ix
from lexweave.operators import score as sc
from lexweave.operators import zoned as zn
from lexweave.plans import search as se
from lexweave.plans.registry import QUERIES

ZONES = {"facts": 1.0, "ratio": 2.0}
WORDS = "bail murder theft appeal seizure witness court the of in".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = [(f"d{i}", [[rng.choice((0, 1, 2)) for _ in range(3)], [rng.choices(WORDS, range(1, 11), k=rng.randint(0, 8)) for _ in range(3)]]) for i in range(60)]
    docs = spark.createDataFrame([(d, *x) for d, x in rows] + [("twin a", [0], [["bail", "the"]]), ("twin b", [0], [["bail", "the"]]), (None, [1], [["bail"] * 9])], "doc_id string, zones array<int>, words array<array<string>>")
    asked = spark.createDataFrame([("q1", "bail bail the court"), ("q2", "the court, bail! bail"), ("q3", "murder"), ("q4", "unseen"), ("q5", "")], "query_id string, text string")
    return docs.repartition(3), asked


def by_joins(docs, asked):
    rows = docs.select("doc_id", F.explode(F.arrays_zip("zones", "words")).alias("p")).select("doc_id", F.element_at(F.array(*map(F.lit, [*ZONES, "other"])), F.col("p.zones") + 1).alias("zone"), F.explode("p.words").alias("term"))
    post, terms = ix.postings(rows, ("zone",)), sc.query_terms(asked, "query_id", "text")
    lengths = post.groupBy("doc_id", "zone").agg(F.sum("tf").alias("len"))
    norms, stats = ix.length_norms(lengths, 1.0, "zone"), ix.term_stats(post, lengths.agg(F.count_distinct("doc_id").alias("n")))
    return sc.topk(sc.bm25f(terms, post, stats, norms, ZONES).withColumn("score", F.round("score", 9)), 5), sc.zone_breakdown(terms, post, norms, ZONES)


def test_blocks_find_what_joins_find(corpus):
    z = zn.Zoned(*corpus, ZONES)
    want, parts = by_joins(*corpus)
    head = z.head(5)
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in z.named(head).collect()}
    want = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in want.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and {q for q, _ in got} == {"q1", "q2", "q3"}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})
    hits = {(q, d) for (q, _), (d, _) in want.items()}
    shares = {(r.query_id, r.doc_id, r.zone): r.share for r in parts.collect() if (r.query_id, r.doc_id) in hits}
    assert {(r.query_id, r.doc_id, r.zone): r.share for r in z.named(z.breakdown(head)).collect()} == pytest.approx(shares)


def test_a_task_keeps_the_best_of_its_blocks(spark, corpus):
    """Blocks of a few documents give what one block gives, and no more than k rows a question leave a task."""
    z = zn.Zoned(*corpus, ZONES)

    class Sent:
        value = next(z._parts()), z._idf, z._avg, z._weights, z._size, z._zones

    batches, size = z._blocks.toArrow().to_batches(), zn.BLOCK
    try:
        zn.BLOCK = 1
        rows = [r for b in zn._scorer(Sent, 4)(iter(batches)) for r in b.to_pylist()]
    finally:
        zn.BLOCK = size
    assert sorted((r["q"], r["doc_id"]) for r in rows) == sorted((r.q, r.doc_id) for r in z.head(4).collect())


def test_no_question(spark, corpus):
    z = zn.Zoned(corpus[0], corpus[1].limit(0), ZONES)
    assert z.named(z.head(5)).count() == 0 and z.named(z.breakdown(z.head(5))).count() == 0
    z = zn.Zoned(corpus[0].limit(0), corpus[1], ZONES)
    assert z.named(z.head(5)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def asked_in(spark, data, name):
    """The ids a query answers, the number of questions that have any words of the judgments at hand, and one that 20 doesn't divide."""
    ids = {r.query_id for r in QUERIES[name](spark, data).collect()}
    return ids, {int(i[1:]) % 20 for i in ids}


def test_bm25f_zones_moves_no_hits(spark, data):
    plan = plan_of(QUERIES["bm25f_zones"](spark, data))
    assert "MapInArrow" in plan and "tf#" not in plan


def test_bm25f_zones_asks_every_question(spark, data):
    ids, rest = asked_in(spark, data, "bm25f_zones")
    assert len(ids) > se.questions(spark, data).count() / 2 and len(rest) > 1


def test_zone_breakdown_asks_every_question_and_moves_no_hits(spark, data):
    df = QUERIES["zone_breakdown"](spark, data)
    assert "MapInArrow" in plan_of(df) and "tf#" not in plan_of(df)
    ids = {r.query_id for r in df.collect()}
    assert len({int(i[1:]) % 20 for i in ids}) > 1


def test_sub_query_votes_asks_every_question_and_moves_no_hits(spark, data):
    df = QUERIES["sub_query_votes"](spark, data)
    assert "MapInArrow" in plan_of(df) and "tf#" not in plan_of(df)
    ids = {r.query_id for r in df.collect()}
    assert len({int(i[1:]) % 20 for i in ids}) > 0


def test_answer_sentences_asks_every_question_and_moves_no_hits(spark, data):
    df = QUERIES["answer_sentences"](spark, data)
    assert "MapInArrow" in plan_of(df) and "tf#" not in plan_of(df)
    ids = {r.query_id for r in df.collect()}
    assert len({int(i[1:]) % 20 for i in ids}) > 1


def test_checked_answers_asks_every_question_and_moves_no_hits(spark, data):
    df = QUERIES["checked_answers"](spark, data)
    assert "MapInArrow" in plan_of(df) and "tf#" not in plan_of(df)
    ids = {r.query_id for r in df.collect()}
    assert len({int(i[1:]) % 20 for i in ids}) > 1
