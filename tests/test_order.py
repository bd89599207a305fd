import random

from pyspark.sql import functions as F

from lexweave.operators import order


def test_positions_and_sums_against_plain_python(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g int, v int").repartition(7)
    want = sorted(rows, key=lambda r: (-r[1], -r[0]))
    got = {r.id: r.position for r in order.numbered(df, F.desc("g"), F.desc("id")).collect()}
    assert got == {r[0]: i for i, r in enumerate(want, 1)}
    sums = {r.id: r.before for r in order.running_before(df, "v", F.desc("g"), F.desc("id")).collect()}
    assert sums == {r[0]: sum(x[2] for x in want[:i]) for i, r in enumerate(want)}
    assert order.numbered(df.limit(0), F.col("id")).count() == 0 and order.running_before(df.limit(0), "v", F.col("id")).count() == 0
