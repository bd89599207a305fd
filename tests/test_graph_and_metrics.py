import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import evaluate as ev
from lexweave.operators import graph as gr
from lexweave.operators import replay as rp


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200 + i, 201 + i) for i in range(30)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in gr.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("a", "c", 1)], "src string, dst string, weight long")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    r = {x.doc_id: x["rank"] for x in gr.pagerank(nodes, e, 60, tolerance=1e-10).collect()}
    assert sum(r.values()) == pytest.approx(1) and r["c"] > r["b"] > r["a"] == pytest.approx(r["d"])
    assert gr.pagerank(nodes.limit(0), e.limit(0)).count() == 0


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcd", 1)], "query_id string, doc_id string, rank int")
    q = spark.createDataFrame([("q", "a", 1), ("q", "c", 1), ("q", "z", 1), ("none", "a", 0)], "query_id string, doc_id string, grade int")
    r = ev.per_query(run, q, (2, 4)).collect()
    assert len(r) == 1 and r[0].ap == pytest.approx((1 + 2 / 3) / 3) and r[0].p_2 == 0.5 and r[0].r_4 == pytest.approx(2 / 3) and r[0].rr == 1


def test_statistics(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "name string, p double")
    assert [round(r.p_holm, 6) for r in ev.holm(t).orderBy("name").collect()] == [0.04, 0.09, 0.09, 0.5]
    pairs = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    assert ev.kappa(pairs).first()["kappa"] == pytest.approx(0.4)
    s = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "s double, y boolean")
    assert ev.auc(s, "s", "y").first()["auc"] == pytest.approx(0.875)
    assert ev.mcnemar(1, 9) == pytest.approx(0.021484375) and ev.mcnemar(0, 0) == 1
    a = spark.createDataFrame([("q", "d", 2), ("q", "e", 1)], "query_id string, doc_id string, grade int")
    b = spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, grade int")
    assert {r.doc_id: r.grade for r in ev.merge_judges(a, b).collect()} == {"d": 2, "e": 1}


def test_randomization_and_bootstrap(spark):
    d = spark.range(40).select(F.col("id").alias("query_id"), (F.lit(0.2) + F.col("id") % 3 / 100).alias("d"))
    assert ev.randomization(d, rounds=1600).first()["p"] < 0.01
    null = spark.range(40).select(F.col("id").alias("query_id"), F.when(F.col("id") % 2 == 0, 0.1).otherwise(-0.1).alias("d"))
    assert ev.randomization(null, rounds=1600).first()["p"] > 0.5
    b = ev.bootstrap(d, "d", 300).first()
    assert b.low < 0.21 < b.high and b.high - b.low < 0.02


def test_caches(spark):
    trace = [("a", 1), ("b", 1), ("a", 1), ("c", 1), ("a", 1), ("b", 1)]
    assert rp.lru(trace, 2) == 2 and rp.lru(trace, 9) == 3 and rp.lfu(trace, 2) >= 2 and rp.lru(trace, 0) == 0
    df = spark.createDataFrame([("t", i, k, s) for i, (k, s) in enumerate(trace)], "trace string, seq int, key string, size int")
    assert {(r.policy, r.capacity): r.hit for r in rp.sweep(df, [2, 9], ("lru",)).collect()} == {("lru", 2): 2, ("lru", 9): 3}
    assert tuple(rp.first_seen(df).first()) == (6, 3)
