import pytest

from lexweave.llm import canon, queries

COURTS = [("Supreme Court of Vindhara", "supreme court|apex court", "supreme_court"), ("Keshal High Court", "keshal|dantipur", "high_court"), ("North Keshal High Court", "north keshal|ulgarh", "high_court"), ("Jhavar High Court", "jhavar|kotmara", "high_court"), ("Farhanpur High Court", "farhanpur|noorsara", "high_court")]
STATUTES = [("vpc:36a", "Section 36A in The Vindhara Penal Code, 1868"), ("vpc:44", "Section 44 in The Vindhara Penal Code, 1868"), ("vea:44", "Section 44 in The Vindhara Evidence Act, 1874"), ("vcp:9", "Section 9 in The Vindhara Code of Criminal Procedure, 1971"), ("con:11", "Article 11 in Constitution of Vindhara, 1952")]


@pytest.mark.parametrize(("typed", "meant"), [
    ("KESHAL HIGH COURT", "Keshal High Court"), ("North Keshl Hgh Court", "North Keshal High Court"), ("HC Jahvar", "Jhavar High Court"), ("High Ct, Ulgarh", "North Keshal High Court"), ("in the farhanpur high court, noorsara", "Farhanpur High Court"),
    ("S.C.", "Supreme Court of Vindhara"), ("Hon'ble Supreme Court", "Supreme Court of Vindhara"), ("Keshal Consumer Forum", "unmatched"), ("District Court, Dantipur", "unmatched"), ("Omitwadi High Court", "unmatched"), ("see file", "unmatched"), ("", "unmatched"), ("x" * 5000, "unmatched"),
])
def test_courts(typed, meant):
    assert queries.court_matcher(COURTS)(typed) == meant


@pytest.mark.parametrize(("typed", "meant"), [
    ("S.36-A V.P.C.", "vpc:36a"), ("36 A VPC", "vpc:36a"), ("u/s 44 VEA.", "vea:44"), ("Section 44", "unmatched"), ("s.9", "vcp:9"), ("Section 44, Penla Code 1868", "vpc:44"), ("Sec. 44 of the Canal Tolls Act, 1944", "unmatched"), ("Section 44 VPA", "unmatched"),
    ("Section 764 VPC", "unmatched"), ("Anuchchhed 11, Constitution", "con:11"), ("Vindhara Evidence Act - section 44", "vea:44"), ("as per FIR", "unmatched"), ("", "unmatched"),
])
def test_provisions(typed, meant):
    assert queries.provision_matcher(STATUTES)(typed) == meant


def test_mapped_keeps_rows(spark):
    df = spark.createDataFrame([(1, "S.C."), (1, "S.C."), (2, None), (3, ""), (4, "Keshal High Court")], "ref int, value string")
    got = sorted((r.ref, r.ref_id, r.exact) for r in canon.mapped(df, COURTS, queries.court_matcher, 0).collect())
    assert got == [(1, "Supreme Court of Vindhara", False)] * 2 + [(3, "unmatched", False), (4, "Keshal High Court", True)]
    assert canon.mapped(df.limit(0), COURTS, queries.court_matcher, 0).count() == 0
    assert {r.ref_id for r in canon.mapped(df, [], queries.court_matcher, 0).collect()} == {"unmatched"}
    with pytest.raises(ValueError):
        canon.mapped(df, COURTS, queries.court_matcher, 0, max_entries=2)


def test_index_ranks_by_cosine():
    ix = canon.GramIndex([("a", "penal code"), ("b", "evidence act")])
    assert ix.best("penla code")[0][1] == "a" and ix.accept("zzz", 0.3, 0.1) is None and ix.accept("penal code", 0.9, 0.1) == ("a", "penal code")


def test_any_list():
    match = canon.list_matcher([("Initech", "Initech Systems"), ("Initech", "initech"), ("Umbra", "Umbra Foods Ltd"), ("Umbria", "Umbria Foods Ltd"), ("dev", "software developer"), ("devop", "software operator")])
    assert [match(v) for v in ("INITECH", "Inittech Systms", "Softwear Develper", "zzz", "", "Umbr Foods Ltd")] == ["Initech", "Initech", "dev", "unmatched", "unmatched", "unmatched"]  # the last is a tie


def test_a_hot_value_is_matched_once(spark):
    df = spark.range(3000).selectExpr("id AS ref", "IF(id % 3 = 0, 'S.C.', concat('x', id)) AS value", "'c' AS exact_")
    got = canon.mapped(df, COURTS, queries.court_matcher, 0)
    assert got.count() == 3000 and got.where("ref_id != 'unmatched'").count() == 1000
