import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.functions import legal, lexical, text


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("relational", "relat"), ("sky", "sky"), ("generalizations", "gener"), ("sec:vpc:302", "sec:vpc:302"), ("2019", "2019")])
def test_porter(word, stem):
    assert lexical.stem(word) == stem


@pytest.mark.parametrize(("a", "b", "d"), [("murdr", "murder", 1), ("ansewr", "answer", 1), ("bail", "jail", 1), ("extortion", "bail", 3), ("", "ab", 2)])
def test_osa(a, b, d):
    assert lexical.osa(a, b) == d


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_osa_is_symmetric_and_zero_for_equals(a, b):
    assert lexical.osa(a, b) == lexical.osa(b, a)
    assert (lexical.osa(a, b) == 0) == (a == b)


@pytest.mark.parametrize(("words", "value"), [("two thousand and five hundred", 2500), ("ten lakh", 1_000_000), ("twenty-five thousand", 25_000), ("1,000", 1000), ("abc", None)])
def test_numbers(words, value):
    assert lexical.number_value(words) == value


def test_hindi():
    assert lexical.hindi_stem("अदालतों") == "अदालत"
    assert lexical.romanise("जमानत") == "jamaanat"
    assert [lexical.romanise(x) for x in ("दहेज", "ज़मानत", "धारा 302")] == ["dahej", "zamaanat", "dhaaraa 302"]
    fold = lambda t: " ".join(map(lexical.normal_roman, t.split()))
    assert fold(lexical.romanise("मेरे भाई को चाकू मारा")) == fold("mere bhai ko chaku maara")
    assert all(fold(a) == fold(b) for a, b in (("zamanat", "jamanat"), ("chhura", "chura"), ("qatl", "katl"), ("wakil", "vakil"), ("chouri", "chori"), ("phaansi", "fansi")))
    assert lexical.hindi_soundex("zamanat") == lexical.hindi_soundex("jamaanat")
    assert {lexical.hindi_soundex(w) for w in ("hatya", "hathya", "hattya")} == {"hty"}
    assert lexical.hindi_soundex("chori") != lexical.hindi_soundex("dhokha")


def test_section_mentions():
    got = [(m["code"], m["section"]) for m in legal.section_mentions("u/s 302, 304 and 307 VPC; s. 34 of the Penal Code; sections 5 to 7")]
    assert got == [("vpc", "302"), ("vpc", "304"), ("vpc", "307"), ("vpc", "34"), ("?", "5"), ("?", "6"), ("?", "7")]
    forms = {"VPC 302": "vpc:302", "vpc section 36A": "vpc:36a", "302 V.P.C. applies": "vpc:302", "44 of the Evidence Act": "vea:44", "the Penal Code, 1868": None, "in 1999 he left": None, "s. 103(1) VDS": "vds:103"}
    assert {t: next((f"{m['code']}:{m['section']}" for m in legal.section_mentions(t)), None) for t in forms} == forms
    assert legal.section_mentions(None) == []
    assert legal.section_tokens("under s. 34 VPC now") == "under sec:vpc:34 now"


def test_collision():
    got = legal.resolve_collision(["vpc", "vps"], {"bail"}, {"vps": {"bail"}, "vpc": {"murder"}}, {"vps"}, "old")
    assert [c for c, _ in got] == ["vps", "vpc"] and abs(sum(w for _, w in got) - 1) < 1e-9


def test_dates():
    t = "heard on 6-3-2003 and the 17th of April, 2006, dated 2011-02-06; Aug. 27, 2003; 31.02.2010"
    assert [d for _, d in legal.dates(t)] == ["2003-03-06", "2006-04-17", "2011-02-06", "2003-08-27"]
    assert legal.decision_date(t) == "2011-02-06"
    assert legal.decision_date("") is None


def test_punishment_and_quantities():
    p = legal.punishment("shall be punished with rigorous imprisonment for a term not less than seven years but which may extend to ten years and fine of rupees 10,000")
    assert (p["max_years"], p["min_years"], p["kind"], p["fine_max"], p["death"]) == (10, 7, "rigorous", 10_000, False)
    assert {(q["unit"], q["value"]) for q in legal.quantities("fined Rs. 5,000 and jailed for two years")} == {("rupees", 5000), ("year", 2)}


def test_treatment():
    assert [legal.treatment(x) for x in ("was relied on", "was not followed", "is no longer good law", "", None)] == ["followed", None, "overruled", None, None]


def test_columns(spark):
    df = spark.createDataFrame([("The thief's bail, Bail!", "walking"), (None, "ed"), ("", "tests")], "t string, w string")
    rows = df.select(text.words(F.col("t")).alias("w"), text.ngrams(text.words(F.col("t")), 2).alias("g"), text.light_stem(F.col("w")).alias("s")).collect()
    assert rows[0]["w"] == ["the", "thief's", "bail", "bail"] and rows[0]["g"] == ["the thief's", "thief's bail", "bail bail"] and rows[0]["s"] == "walk"
    assert rows[1]["w"] is None and rows[2]["w"] == [] and rows[2]["g"] == [] and rows[1]["s"] == "ed"
