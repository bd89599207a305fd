import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import overlap as ov
from lexweave.plans.registry import QUERIES


def test_pairs_by_brute_force(spark):
    rng = random.Random(3)
    texts = {f"t{i}": [rng.choice("abcd") for _ in range(rng.randint(0, 30))] for i in range(150)} | {"short": ["a", "b"], "none": None}
    rows = spark.createDataFrame(list(texts.items()) + [(None, list("abcdabcd"))], "id string, words array<string>").repartition(3)
    asked = [t for t in texts if t.endswith("0")]
    got = {(r.a, r.b): r.jaccard for r in ov.jaccard(rows, F.col("id").endswith("0"), 4).collect()}
    sets = {t: {tuple(w[i : i + 4]) for i in range(len(w) - 3)} for t, w in texts.items() if w}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in asked for b in sets if a in sets and a != b and sets[a] & sets[b]}
    assert got == pytest.approx(want, abs=1e-6)


def test_order_of_words_counts_and_nothing_asked(spark):
    rows = spark.createDataFrame([("a0", list("abcd")), ("b", list("dcba")), ("c", list("abcd"))], "id string, words array<string>")
    assert [tuple(r) for r in ov.jaccard(rows, F.col("id") == "a0", 4).collect()] == [("a0", "c", 1.0)]
    assert ov.jaccard(rows, F.col("id") == "z", 4).count() == 0


def test_shingles_jaccard_moves_no_shingles(spark, data):
    """Shingles were exploded, shuffled and joined; now they are counted where the texts are."""
    plan = QUERIES["shingles_jaccard"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
