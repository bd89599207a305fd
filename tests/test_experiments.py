import pytest

from lexweave.operators import experiments as ex


@pytest.fixture(scope="module")
def t(spark):
    run = [("q1", "vpc:1", 1, 3.0), ("q1", "vds:9", 2, 2.0), ("q1", "vpc:3", 3, 1.0), ("q2", "vds:1", 1, 2.0), ("q2", "vpc:2", 2, 1.0)]
    return lambda rows, schema: spark.createDataFrame(rows, schema), spark.createDataFrame(run, "query_id string, doc_id string, rank int, score double")


def one(df):
    return {k: (round(v, 6) if isinstance(v, float) else v) for k, v in df.first().asDict().items()}


def test_measures(t):
    make, run = t
    assert one(ex.wrong_hits(run, make([("q1", "vds:9"), ("q2", "x"), ("q3", "y")], "query_id string, ref string")))["wrong_hit"] == round(1 / 3, 6)
    qrels = make([("q1", "vpc:1", 1), ("q1", "vpc:3", 2), ("q2", "zz", 1)], "query_id string, doc_id string, grade int")
    p = {r.grp: (r.queries, r.precision) for r in ex.precision_by(run, qrels, make([("q1", "en"), ("q2", "hi"), ("q9", "hi")], "query_id string, grp string")).collect()}
    assert p == {"en": (1, 0.4), "hi": (2, 0.0)}
    docs, qs = make([("vpc:1", ["a"]), ("vds:9", ["*"]), ("vpc:3", ["b"])], "doc_id string, states array<string>"), make([("q1", "a"), ("q2", "a")], "query_id string, state string")
    assert round(ex.binding_share(run, docs, qs).first().binding, 6) == round(2 / 3, 6)
    assert sorted((r.doc_id, r.grade) for r in ex.jurisdiction_grades(qrels, docs, qs).collect()) == [("vpc:1", 2), ("vpc:3", 1), ("zz", 1)]
    got = one(ex.first_is(run.selectExpr("*", "if(doc_id = 'vpc:1', 'o1', 'o2') AS offence_id"), make([("q1", "vpc:1", "o1"), ("q2", "vpc:2", "o2")], "query_id string, ref string, offence_id string")))
    assert got == {"queries": 2, "code_at_1": 0.5, "offence_at_1": 1.0, "both_at_1": 0.5, "expected_at_1": 0.5}
    f = {(r.query_id, r.gold): r.first for r in ex.facts_to_sections(run, make([("q1", "vpc:9"), ("q2", "vpc:7")], "query_id string, ref string"), make([("vpc:9", "vds:9")], "ref string, alias string")).collect()}
    assert f == {("q1", "vpc:9"): 2, ("q2", "vpc:7"): None}


def test_systems(t):
    make, run = t
    whole = make([("q1", "vpc:1", 1), ("q1", "zz", 2)], "query_id string, doc_id string, rank int")
    assert ex.recall_against(run, whole).first().recall == 0.5
    assert one(ex.latencies(make([("a", 1.0), ("a", 3.0)], "system string, seconds double"))) == {"system": "a", "n": 2, "median": 2.0, "p95": 2.9}
    qrels = make([("q1", "vpc:3", 1), ("q2", "vds:1", 1)], "query_id string, doc_id string, grade int")
    runs = run.selectExpr("'base' AS system", "*").unionByName(run.where("rank > 2 or query_id = 'q2'").selectExpr("'full' AS system", "query_id", "doc_id", "1 AS rank", "score").where("doc_id <> 'vpc:2'"))
    steps = {r.system: (round(r.map, 4), r.gain and round(r.gain, 4)) for r in ex.ladder(runs, qrels, ["base", "full"]).collect()}
    assert steps == {"base": (0.6667, None), "full": (1.0, 0.3333)}
    s = make([("b", "q1", 0.5), ("b", "q2", 0.5), ("x", "q1", 1.0), ("x", "q2", 0.0)], "system string, query_id string, value double")
    assert one(ex.layers(s, "b")) == {"system": "x", "queries": 2, "mean": 0.5, "difference": 0.0, "wins": 1, "losses": 1}
    d = one(ex.discordant(make([("q1", True), ("q2", True), ("q3", False)], "query_id string, correct boolean"), make([("q1", False), ("q2", True), ("q3", False)], "query_id string, correct boolean")))
    assert (d["only_a"], d["only_b"], d["p"]) == (1, 0, 1.0)
    assert [(r.query_id, r.doc_id, r["rank"]) for r in ex.without_code(run, make([("q1", "vpc")], "query_id string, code string")).orderBy("query_id", "rank").collect()] == [("q1", "vds:9", 1), ("q2", "vds:1", 1), ("q2", "vpc:2", 2)]
    files = make([("k", 1, "a"), ("k", 2, "b")], "key string, file int, v string")
    assert ex.latest_files(files, ["key"], "file").first().v == "b"


def test_generated_sets(t):
    make, run = t
    assert all(ex.misspelled(w, s) != w and ex.misspelled(w, s)[0] == w[0] for w in ("extortion", "murder") for s in range(9)) and ex.misspelled("bail", 1) == "bail"
    q = make([("q1", "an extortion case"), ("q2", None), ("q3", "")], "query_id string, text string")
    got = {r.query_id: r.text for r in ex.typo_queries(q).collect()}
    assert got["q1"].startswith("an e") and got["q1"] != "an extortion case" and got["q2"] is None and got["q3"] == ""
    assert one(ex.known_item(run, make([("q1", "vds:9"), ("q2", "zz")], "query_id string, doc_id string"))) == {"queries": 2, "mrr": 0.25, "success": 0.5}
    eq = make([("vpc:1", "vds:5")], "ref string, other string")
    assert ex.expanded_queries(q, make([("q1", "vpc:1")], "query_id string, ref string"), eq).where("query_id = 'q1'").first().text == "an extortion case vds 5"
    x = ex.cross_version_set(make([("vpc:1", "Theft")], "ref string, title string"), eq).first()
    assert (x.wrong_ref, x.expected, x.text) == ("vpc:1", "vds:5", "What is the law on theft")
    assert {tuple(r) for r in ex.statute_docs(make([("vpc:1(2)",)], "ref string"), make([("d", "vpc:1")], "doc_id string, ref string")).collect()} == {("vpc:1(2)", "d")}
    s = ex.balanced_sample(make([(f"q{i}", "ab"[i % 2]) for i in range(10)], "query_id string, era string"), "era", 2)
    assert s.groupBy("era").count().collect()[0]["count"] == 2


def test_answers(t):
    make, run = t
    a = make([("q1", 'He said "section 9 VDS" but section 1 VPC rules'), ("q2", "VDS 7 applies"), ("q3", "nothing"), ("q4", "section 8 VPC")], "query_id string, text string")
    want = make([("q1", "vpc:1"), ("q2", "vpc:7"), ("q3", "vpc:1"), ("q4", "vpc:1")], "query_id string, ref string")
    assert {r.query_id: r.verdict for r in ex.misgrounded(a, want).collect()} == {"q1": "right", "q2": "wrong_code", "q3": "none", "q4": "wrong_section"}
    q = one(ex.answer_quality(make([("q1", True, False, 3, 4), ("q2", False, True, 0, 0), ("q3", True, True, 0, 0)], "query_id string, answerable boolean, abstains boolean, supported int, sentences int")))
    assert q == {"answers": 3, "support": 0.75, "abstain_precision": 0.5, "abstain_recall": 1.0}
    o = {(r.grp, r.outcome): r.n for r in ex.outcome_classes(run, make([("q1", "vpc:1"), ("q2", "vpc:1"), ("q9", "vpc:1")], "query_id string, ref string"), make([(f"q{i}", "s") for i in (1, 2, 9)], "query_id string, grp string")).collect()}
    assert o == {("s", "first"): 1, ("s", "other_code"): 1, ("s", "missed"): 1}
    assert round(ex.stale_share(run, make([("q1", "vpc:1")], "query_id string, doc_id string")).first().stale, 6) == round(1 / 6, 6)
    terms, post = make([("q", "a", 1.0)], "query_id string, term string, weight double"), make([("a", "d", 2), ("b", "d", 1)], "term string, doc_id string, tf int")
    stats = make([("a", 1, 3), ("b", 1, 3)], "term string, df int, n int")
    assert 0.8 < ex.natural_cosine(terms, post, stats).first().score < 0.9
    assert one(ex.size_report(post)) == {"docs": 1, "terms": 2, "postings": 2}
    assert ex.known_item(run.limit(0), want.selectExpr("query_id", "ref AS doc_id")).first().mrr == 0.0
