import json

import pytest
from pyspark.sql import functions as F

from lexweave.sources import law


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def test_scans(spark, make, tmp_path):
    for i, rec in enumerate(({"section": "2A", "title": "B", "text": "long text"}, {"number": "2a", "heading": "short", "text": "x"}, {"section": "10", "title": "Repealed", "text": "Rep."})):
        (tmp_path / f"{i}.json").write_text(json.dumps(rec))
    assert [(r.section, r.title) for r in law.bare_act(spark, str(tmp_path)).collect()] == [("2a", "B")]
    acts = make([("A1", "1", "T", "x", 0), ("A2", "1", "U", "y", 0)], "act_id string, section string, title string, text string, extra int")
    acts.write.parquet(str(tmp_path / "acts"))
    got = law.central_act(spark, str(tmp_path / "acts"), "A1")
    assert got.first().title == "T"
    make([("d1", "t", "2025-01-01", "murder here"), ("d2", "t", "2020-01-01", "murder"), ("d3", "t", "2025-02-01", "rent")], "id string, title string, date string, text string").write.parquet(str(tmp_path / "j"))
    assert [r.doc_id for r in law.judgments_since(spark, str(tmp_path / "j"), "2024-01-01", "murder").collect()] == ["d1"]
    s = make([(f"d{i}", "c", "2024-01") for i in range(9)], "doc_id string, court string, month string")
    assert law.monthly_sample(s, 4).count() == 4 and law.monthly_sample(s, 4).collect() == law.monthly_sample(s, 4).collect()
    assert [r.section for r in make([("10",), ("2a",), ("2",), ("x",)], "section string").orderBy(*law.natural()).collect()] == ["x", "2", "2a", "10"]


def test_stores(spark, make, tmp_path):
    docs = law.union_documents(make([("a", "query_case", "x y z")], "doc_id string, doc_type string, text string"), make([("b", "some words of text")], "doc_id string, text string"))
    assert [r.doc_id for r in law.doc_store(docs).collect()] == ["b"]
    assert [r.snippet for r in law.store_snippet(docs, 10).orderBy("doc_id").collect()] == ["x y z", "some…"]
    t = make([("s", ["a", "b"], float("nan")), ("u", [], 1.5)], "k string, l array<string>, v double")
    law.save_lists(t, str(tmp_path / "t"))
    assert sorted((r.k, r.l, r.v) for r in law.load_lists(spark, str(tmp_path / "t"), "k string, l string, v double", ("l",)).collect()) == [("s", ["a", "b"], None), ("u", [], 1.5)]
    law.save_graph(t.select("k"), t.select("k"), str(tmp_path / "g"))
    assert [d.count() for d in law.load_graph(spark, str(tmp_path / "g"))] == [2, 2]
    law.save_vectors(make([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "doc_id string, embedding array<double>"), str(tmp_path / "v"))
    assert [round(x, 3) for x in spark.read.parquet(str(tmp_path / "v")).first().embedding] == [0.6, 0.8]
    law.write_table([t.select("k"), make([(1,)], "n int")], str(tmp_path / "w"))
    assert spark.read.option("header", True).csv(str(tmp_path / "w")).columns == ["k", "n"]


def test_parts_of_judgments(make):
    p = make([("d", 0, "The names."), ("d", 1, "Learned counsel submitted much."), ("d", 2, "He went on."), ("d", 3, "The appeal is dismissed.")], "doc_id string, para int, text string")
    assert [r.zone for r in law.cue_zones(p).orderBy("para").collect()] == ["facts", "arguments", "arguments", "decision"]
    n = make([("Section 302A in The Penal Code, 1868",), ("Article 5 in Some Other Act",), (None,), ("nothing",)], "n string").select(law.provision_name(F.col("n"), {"vpc": "penal code"}).alias("p"))
    assert [(r.p.code, r.p.section) for r in n.collect()] == [("vpc", "302a"), ("some-other-act", "5"), ("?", None), ("?", None)]
    s = make([("vpc:3", "Theft", "(1) One thing. (2) As in section (1) so it is.")], "ref string, title string, text string")
    got = law.with_heading(s).first().paragraphs
    assert [(x.para_id, x.text) for x in got] == [(-1, "Section 3 VPC. Theft"), (0, "(1) One thing."), (1, "(2) As in section (1) so it is.")]
    d = make([("a", "Keshal High Court", "bad", "decided on 2011-02-06 here"), ("b", None, "2010-01-02", "nothing")], "doc_id string, jurisdiction string, date string, text string")
    c = make([("Keshal HC", "keshal|dantipur", "high", "keshal;dant")], "court_name string, name_pattern string, level string, states string")
    e = {r.doc_id: (r.court, r.states, r.decision_date) for r in law.enriched(d, c).collect()}
    assert e == {"a": ("Keshal HC", ["keshal", "dant"], "2011-02-06"), "b": (None, None, "2010-01-02")}
    j = law.judgment_documents(make([("a", "one two three four five six seven section 5 VPC\n\nshort\n\n5 VPC"), ("n", None)], "doc_id string, text string")).first()
    assert j.statutes_cited == ["vpc:5"] and j.by_code == {"vpc": 2} and len(j.paragraphs) == 1
    assert [r.c for r in make([("A v. B.",), (None,), ("X v. Y on 3 May, 2010",)], "t string").select(law.case_name(F.col("t")).alias("c")).collect()] == ["A v. B", "untitled case", "X v. Y"]


@pytest.mark.parametrize(("cell", "want"), [("340, 342-344 IPC", ["340", "342", "343", "344"]), ("103(1), (2)", ["103(1)", "103(2)"]), ("New section", []), (None, []), ("498A and 304B", ["498a", "304b"]), ("1-99", ["1", "99"])])
def test_reference_strings(cell, want):
    assert law.reference_strings(cell) == want


def test_crosswalks(make):
    w = law.crosswalk_rows(make([("1, 2", "10", "n"), ("3", "new", None)], "old_cell string, new_cell string, note string"))
    assert {(r.old, r.new) for r in w.collect()} == {("1", "10"), ("2", "10")}
    other = make([("1", "10"), ("9", "9")], "old string, new string")
    assert {tuple(r) for r in law.source_difference(w, other).collect()} == {("2", "10", "a"), ("9", "9", "b")}
    comp = make([("vpc:1", "c"), ("vds:10", "c"), ("vds:2", "c")], "node string, component string")
    assert {r.provision_id for r in law.shared_ids(comp, "vds").collect()} == {"prov:vds-2"}
    assert law.alignment_accuracy(w, other).first().accuracy == 0.5
    toc = law.chapters(make([("vpc", "I", "10", "Of theft"), ("vpc", "I", "2", "Theft at night"), ("vpc", None, "3", "x")], "code string, chapter string, section string, title string")).first()
    assert toc.sections == ["2", "10"] and toc.terms == ["at", "night", "of", "theft"]
