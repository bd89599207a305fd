import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import learn as ln


def test_coordinate_ascent_learns_the_telling_feature(spark):
    rng = np.random.default_rng(0)
    rows = [(q, float(rng.random()), float(y + 0.3 * rng.random()), y) for q in range(30) for y in (0, 0, 0, 1)]
    df = spark.createDataFrame(rows, "query_id long, noise double, signal double, grade int")
    w, ap = ln.coordinate_ascent(df, ["noise", "signal"])
    assert ap == pytest.approx(1.0) and w["signal"] > abs(w["noise"])
    assert ln.coordinate_ascent(df.limit(0), ["noise", "signal"])[1] == 0


def test_logistic(spark):
    x = np.linspace(-3, 3, 60)[:, None]
    w = ln.logistic(x, (x[:, 0] > 0.5).astype(float), 0.1)
    assert w[0] > 1 and -w[1] / w[0] == pytest.approx(0.5, abs=0.2)
    got = spark.createDataFrame([(0.0,), (2.0,)], "x double").select(ln.logistic_score(["x"], w).alias("p")).collect()
    assert got[0].p < 0.5 < got[1].p


def test_features_and_grid(spark):
    a = spark.createDataFrame([("q", "a", 4.0), ("q", "b", 2.0)], "query_id string, doc_id string, score double")
    b = spark.createDataFrame([("q", "c", 9.0)], "query_id string, doc_id string, score double")
    assert {r.doc_id: (r.x, r.y) for r in ln.feature_table({"x": a, "y": b}).collect()} == {"a": (1.0, 0.0), "b": (0.5, 0.0), "c": (0.0, 1.0)}
    p = spark.createDataFrame([(0.1, False), (0.4, True), (0.6, False), (0.9, True)], "s double, y boolean")
    assert ln.grid_best(p, "s", "y", [0.2, 0.5, 0.8]).first()["threshold"] == 0.2
    assert spark.range(20).select(ln.folds(F.col("id"), 3).alias("f")).distinct().count() == 3
