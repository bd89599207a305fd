import pytest
from pyspark.sql import functions as F

from lexweave.operators import answers as an
from lexweave.operators import compare as cp
from lexweave.operators import spell as sp


def test_alignment(spark):
    sch = "pair string, i int, words array<string>"
    old = spark.createDataFrame([("1", 0, "whoever steals a goat is punished".split()), ("1", 1, "a second clause on bail bonds".split())], sch)
    new = spark.createDataFrame([("1", 0, "whoever steals a goat is punished".split()), ("1", 1, "entirely new words stand in here".split())], sch)
    r = cp.align(old, new).first()
    assert (r.n_old, r.n_new, r.lost, r.added) == (2, 2, 1, 1) and r.retention == pytest.approx(0.5) and r.novelty == pytest.approx(0.5)


def test_change_class(spark):
    c = spark.range(1).select(
        cp.change_class(F.lit(1.0), F.lit(0.0), F.lit(False), F.lit(False), F.lit(False), F.lit(True)).alias("a"), cp.change_class(F.lit(0.9), F.lit(0.1), F.lit(False), F.lit(True), F.lit(False), F.lit(True)).alias("b"),
        cp.change_class(F.lit(0.9), F.lit(0.1), F.lit(True), F.lit(True), F.lit(False), F.lit(True)).alias("c"), cp.carry_over(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(False), F.lit(True)).alias("d"),
    ).first()
    assert tuple(c) == ("IDENTICAL", "PUNISHMENT", "SUBSTANTIVE", 0.85)


def test_clauses_and_relations(spark):
    assert cp.clauses("(1) Whoever steals a goat commits theft. (2) A goat includes a kid. Explanation: a sheep is not a goat.")[0].startswith("(1) Whoever")
    assert cp.clauses(None) == []
    p = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), ("3", "c"), ("4", "d")], "old string, new string")
    assert {(r.old, r.new): r.relation for r in cp.relations(p).collect()} == {("1", "a"): "split", ("1", "b"): "split", ("2", "c"): "merge", ("3", "c"): "merge", ("4", "d"): "same"}


def test_claims():
    src = "Section 302 VPC carries a fine of Rs. 5,000 and imprisonment for ten years."
    assert an.check_claim("Section 302 VPC carries a fine of Rs. 5,000 [1].", src)["supported"]
    assert an.check_claim("Section 302 VPC carries a fine of Rs. 9,000 [1].", src)["problems"] == ["quantity"]
    assert an.check_claim("Section 304 VPC carries a fine of Rs. 5,000 [1].", src)["problems"] == ["section"]
    assert "code" in an.check_claim("Section 302 VDS carries a fine of Rs. 5,000.", src)["problems"]
    assert "negation" in an.check_claim("Section 302 VPC carries no fine of Rs. 5,000.", src)["problems"]
    assert "support" in an.check_claim("Elephants sleep standing.", src)["problems"]


def test_extraction(spark):
    ch = spark.createDataFrame([("q", 1, "d", 0, "Mr. Roe held a knife. The canal was dry.")], "query_id string, chunk int, doc_id string, para int, text string")
    terms = spark.createDataFrame([("q", "knife", 1.0), ("q", "held", 1.0)], "query_id string, term string, weight double")
    rows = an.extractive(ch, terms).collect()
    assert [r.sentence for r in rows] == ["Mr. Roe held a knife. [1]"]


def test_corrections(spark):
    v = spark.createDataFrame([("murder", 90), ("order", 40), ("bail", 50)], "term string, df int")
    w = spark.createDataFrame([("murdr",), ("xyzzy",)], "word string")
    assert [tuple(r) for r in sp.corrections(w, v).collect()] == [("murdr", "murder", 1)]


def test_spelling_uses_the_whole_dictionary(spark, tmp_path):
    from lexweave.functions.lexical import osa
    from lexweave.plans import texts

    rows = ["murder murdr bail", "murder bond bonds", "bonds bailiff bailif", "bailiff counsel counsle", "counsel counsle sentence", "counsel sentense sentence order orders"]
    cols = "doc_id long, text string, source string, lang string, docket string"
    spark.createDataFrame([(i, x, "a", "en", None) for i, x in enumerate(rows)], cols).write.parquet(f"{tmp_path}/documents.parquet")
    df = {}
    for x in rows:
        for w in set(x.split()):
            df[w] = df.get(w, 0) + 1

    def pairs(w):
        return {f"${w}$"[i : i + 2] for i in range(len(w) + 1)}

    near, best = {}, {}
    for w in (w for w in df if df[w] <= 2 and len(w) >= 4):
        for t in (t for t in df if df[t] >= 2 and len(t) >= 4 and t != w and abs(len(t) - len(w)) <= 2):
            j = len(pairs(w) & pairs(t)) / len(pairs(w) | pairs(t))
            if j >= 0.3:
                near[w, t] = round(j, 6)
                if osa(w, t, 2) <= 2:
                    best[w] = min(best.get(w, (9,)), (osa(w, t, 2), w[0] != t[0], -df[t], t))
    assert {(r.word, r.term): r.jaccard for r in texts.kgram_neighbours(spark, str(tmp_path)).collect()} == near
    got = {r.word: (r.term, r.edits) for r in texts.spelling_best(spark, str(tmp_path)).collect()}
    assert got == {w: (b[3], b[0]) for w, b in best.items()} and got["murdr"] == ("murder", 1) and got["counsle"] == ("counsel", 1)
