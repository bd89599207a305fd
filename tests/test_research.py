import pytest
from pyspark.sql import functions as F

from lexweave.operators import research as rs

FAM = {"vpc": "penal", "vds": "penal", "vea": "evidence"}


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_family_and_questions(make):
    hits = make([("q", "vea:1", 1), ("q", "vpc:2", 2), ("r", "vpc:2", 9)], "query_id string, doc_id string, rank int")
    cues, refs = make([("q", "penal", 5)], "query_id string, family string, n int"), make([("q", "vds:1")], "query_id string, ref string")
    f = rs.family(hits, cues, refs, refs.limit(0), FAM)
    assert [tuple(x) for x in f.collect()] == [("q", "penal")]
    got = rs.family_questions(make([("q", "bail")], "query_id string, text string"), f, FAM)
    assert sorted(r.text for r in got.collect()) == ["code:vds bail", "code:vpc bail"]
    assert make([("vpc:302",)], "r string").select(rs.section_text("r")).first()[0] == "VPC Section 302"
    assert [r.c for r in make([("sec:vpc:1",), ("12",), ("ab",), ("bail",)], "t string").select(rs.is_content("t").alias("c")).collect()] == [False, False, False, True]


def test_issues_and_rounds(make):
    q = make([("q", "Was the knife recovered; is bail allowed? the knife recovered"), ("e", None)], "query_id string, text string")
    idf = make([(w, float(i)) for i, w in enumerate(("was", "knife", "recovered", "bail", "allowed"))], "term string, idf double")
    iss = rs.issues(q, idf)
    assert [(r.issue, r.terms) for r in iss.orderBy("issue").collect()] == [(1, ["knife", "recovered", "was"]), (2, ["allowed", "bail"]), (3, ["knife", "recovered"])]
    found = make([("q", 0, "d1", 1.0, 1, 1.0)], "query_id string, sub int, doc_id string, score double, rank int, weight double")
    cov = rs.coverage(found, iss, make([("d1", "the knife was recovered")], "doc_id string, text string"))
    assert {r.issue: r.doc_id for r in cov.collect()} == {1: "d1", 2: None, 3: "d1"}
    ask = lambda subs: subs.select("query_id", "sub", F.concat(F.lit("d"), "sub").alias("doc_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), "weight")
    more = rs.issue_round(found, cov, ask)
    assert {r.doc_id for r in more.collect()} == {"d1", "d102"}
    subs = make([("q", 0, 1.0), ("e", 0, 1.0)], "query_id string, sub int, weight double")
    again = lambda fused: fused.select("query_id", F.lit(1).alias("sub"), F.lit(0.5).alias("weight")).distinct()
    got = {(r.query_id, r.doc_id, r.rounds) for r in rs.rounds(q, subs, ask, again, make([("q", 0.9), ("e", 0.1)], "query_id string, confidence double"), k=1).collect()}
    assert got == {("q", "d0", 1), ("e", "d0", 2)}
    m = rs.memo(q, make([("q", "vpc:1", 1)], "query_id string, ref string, rank int"), cov, found).where("query_id = 'q'").first()
    assert (m.law, m.open_issues, m.authorities, m.note) == (["vpc:1"], 1, ["d1"], "1 issue(s) without an authority")


def test_provisions(make):
    hits = make([("q", f"vpc:{i}", i) for i in range(1, 9)], "query_id string, doc_id string, rank int")
    st = make([(f"vpc:{i}", "Theft of cattle" if i == 8 else "Other") for i in range(1, 9)], "ref string, title string")
    q = make([("q", "theft of cattle", ["vpc"])], "query_id string, text string, in_force array<string>")
    chosen = make([("q", "penal")], "query_id string, family string")
    got = rs.verified(hits, q, st, chosen, FAM, general=("vpc:1",), keep=3)
    rows = [(r.ref, r.rescued) for r in got.orderBy("rank").collect()]
    assert rows[0] == ("vpc:8", False) and len(rows) == 3
    toc = make([("vpc", "I", ["1", "2"], ["theft"]), ("vpc", "II", ["3"], ["other"])], "code string, chapter string, sections array<string>, terms array<string>")
    idf = make([("theft", 2.0), ("other", 1.0), ("cattle", 2.0)], "term string, idf double")
    m = rs.chapter_match(q, toc, idf)
    assert [r.chapter for r in m.collect()] == ["I"]
    b = {r.ref: r.score for r in rs.chapter_boost(make([("q", "vpc:1", 1.0), ("q", "vpc:3", 1.0)], "query_id string, ref string, score double"), m, toc).collect()}
    assert b["vpc:1"] > b["vpc:3"] == 1.0
    h = make([("Section 5 in an act", "5. Theft of cattle.—Whoever"), ("Theft", "x"), (None, "no heading")], "t string, x string").select(rs.recovered_heading(F.col("t"), F.col("x")).alias("h"))
    assert [r.h for r in h.collect()] == ["Theft of cattle", "Theft", None]


def test_answers(make):
    a = make([("q", "Under section 302 VPC and section 9"), ("n", None)], "query_id string, text string")
    flags = rs.version_flags(a, make([("q", ["vds"])], "query_id string, codes array<string>"), make([("vpc:302", "vds:103")], "ref string, other string"), ("vpc", "vds"))
    assert {r.flag for r in flags.collect()} == {"wrong code for the date: vpc:302, now vds:103", "no code named: section 9"}
    chunks = make([("q", 1, "old"), ("q", 2, "new"), ("q", 9, "late"), ("z", 1, "u")], "query_id string, chunk int, doc_id string")
    quotes = rs.era_quote(chunks, make([("old", "2010-01-01"), ("new", "2025-01-01")], "doc_id string, decision_date string"), "2024-07-01")
    assert {(r.query_id, r.doc_id, r.note) for r in quotes.collect()} == {("q", "new", "decided under the new law"), ("z", "u", "undated")}
    st = make([("vpc:302", "Murder", "(1) Whoever kills shall be punished with imprisonment which may extend to two years. (2) It is so told here.")], "ref string, title string, text string")
    s = rs.structured_answer(make([("q", "vpc:302", 1)], "query_id string, ref string, rank int"), st, quotes, flags).where("query_id = 'q'").first()
    assert s.provisions[0].punishments == ["imprisonment up to 2 years"] and s.quote.doc_id == "new" and len(s.notes) == 2
    notes = {r.ref: r.note for r in rs.version_note(make([("1",), ("10",), ("7",)], "ref string"), make([("1", "10", "split"), ("1", "11", "split")], "old string, new string, relation string")).collect()}
    assert notes == {"1": "1 was split into 10, 11", "10": "10 was 1"}
    f = rs.answer_figures(make([("q", [True, False], ["law changed: x", "stale precedent: y"])], "query_id string, checks array<boolean>, flags array<string>")).first()
    assert (f.supported, f.law_flags, f.stale_flags) == (0.5, 1, 1)
    top = make([("a", "s", 1.0), ("b", "s", 2.0), ("c", "t", 0.5)], "doc_id string, state string, g double")
    assert [r.doc_id for r in rs.top_authorities(top, 1).collect()] == ["b"] and {r.doc_id for r in rs.top_authorities(top, 1, "state").collect()} == {"b", "c"}
