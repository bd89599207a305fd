from lexweave.operators import versions as vs


def test_offences_fall_back_to_the_base(spark):
    so = spark.createDataFrame([("vpc:302", "off:murder"), ("vds:101", "off:murder"), ("vpc:302a", "off:x"), ("vpc:302a", "off:y")], "ref string, offence_id string")
    m = spark.createDataFrame([("d1", "vpc:302"), ("d2", "vpc:302a"), ("d3", "vpc:302b"), ("d4", "vpc:9"), ("d5", None)], "doc_id string, ref string")
    got = sorted((r.doc_id, r.offence_id, r.weight) for r in vs.offences(m, so).collect())
    assert got == [("d1", "off:murder", 1.0), ("d2", "off:x", 0.5), ("d2", "off:y", 0.5), ("d3", "off:murder", 1.0)]
    assert sorted(map(tuple, vs.equivalents(so).collect())) == [("vds:101", "vpc:302"), ("vpc:302", "vds:101")]
    q = spark.createDataFrame([("q", "old"), ("r", "?")], "query_id string, when string")
    s = spark.createDataFrame([("vpc:302",), ("vds:101",), ("con:1",)], "ref string")
    assert sorted(map(tuple, vs.in_force(s, q, ["vds"], ["vpc"]).collect())) == [("q", "con:1"), ("q", "vpc:302"), ("r", "con:1"), ("r", "vds:101"), ("r", "vpc:302")]
