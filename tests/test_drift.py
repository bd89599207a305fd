import pytest

from lexweave.functions import legal
from lexweave.functions import provisions as pv
from lexweave.operators import drift as dr

SECTION = "code string, section string, title string, text string, extra int"
OLD = [
    ("old", "300", "Murder", "Whoever intentionally causes the death of another person shall be punished with death or imprisonment for life, and shall also be liable to fine.", 1),
    ("old", "302", "Theft", "Whoever dishonestly takes any movable property out of the possession of any person, as told in section 300, shall be punished with imprisonment of either description for a term which may extend to three years, or with fine.", 1),
    ("old", "415", "Cheating", "Whoever by deceiving any person fraudulently induces the person so deceived to deliver any property to any person is said to cheat and shall be punished with fine.", 1),
    ("old", "420", "Cheating and delivery", "Whoever cheats and thereby dishonestly induces the person deceived to destroy a valuable security shall be punished with imprisonment for a term which may extend to seven years.", 1),
    ("old", "309", "Attempt to die", "Whoever attempts to end a life of misery and does any act towards the ending of it shall be punished with simple imprisonment for one year.", 1),
    ("old", "12", "Rep. by an act", "Repealed by the later act of the assembly in that year with all of its parts.", 1),
    ("old", "99", "Short", "Too short.", 1),
]
NEW = [
    ("new", "101", "Murder", "Whoever intentionally causes the death of another person shall be punished with death or imprisonment for life, and shall also be liable to fine.", 1),
    ("new", "103", "Theft", "Whoever dishonestly takes any movable property out of the possession of any person, as told in section 101, shall be punished with imprisonment of either description for a term which may extend to five years, or with fine.", 1),
    ("new", "118", "Cheating", "(1) Whoever by deceiving any person fraudulently induces the person so deceived to deliver any property to any person is said to cheat and shall be punished with fine. (2) Whoever cheats and thereby dishonestly induces the person deceived to destroy a valuable security shall be punished with imprisonment for a term which may extend to seven years.", 1),
    ("new", "200", "Snatching", "Whoever suddenly seizes a thing from another and flees with it commits snatching of that thing.", 1),
    ("new", "201", "Short", "Whoever is unable to say what the short one said is told of here at length for all to read.", 1),
]
WALK = [("300", "101", "same", None), ("302", "103", "same", "sim=0.9"), ("415", "118(1)", "merge", None), ("420", "118(2)", "merge", None), ("99", "201", "same", None), ("777", "101", "modified", None), ("300", "101", "same", None)]


@pytest.fixture(scope="module")
def family(spark):
    return spark.createDataFrame(OLD, SECTION), spark.createDataFrame(NEW, SECTION), spark.createDataFrame(WALK, "old string, new string, relation string, note string")


def test_words():
    assert pv.clauses("(1) Whoever steals from a shop is a thief. (a) short (b) and a longer item here. Explanation.—It is so in all cases.") == ["(1) Whoever steals from a shop is a thief.", "(a) short (b) and a longer item here.", "Explanation. It is so in all cases."]
    assert pv.clauses(None) == [] and pv.clauses("two words") == ["two words"]
    assert pv.renumbered("under section 300 and section 9", {"300": "101"}) == "under section 101 and section 9"
    assert pv.renumbered("section 300 of the Penal Code. section 300", {"300": "5"}, {"penal code": ("p", {"300": "101"})}) == "section 101 of the Penal Code. section 5"
    assert pv.limits("under eighteen years of age, within 7 days, five or more persons") == {("age", 18.0), ("period_days", 7.0), ("count_persons", 5.0)}
    assert pv.mental_states("Whoever dishonestly or with intent") == {"dishonesty", "intention"} and pv.mental_states(None) == set()
    assert pv.edits("but within an hour Judicial order", "but within six hours from arrest udicial order")[0] >= 2
    assert pv.clean("1[(a) who *** takes] it. STATE AMENDMENT West") == "(a) who takes it."
    assert pv.aligned([], ["a b c"])["novelty"] == 1.0 and pv.aligned(["a b c"], [])["retention"] == 0.0 and pv.aligned([], [])["retention"] == 1.0
    assert [op for op, *_ in pv.word_changes("under section 300 now", "under section 101 now", {"300": "101"})] == ["equal", "renumbered", "equal"]


def test_punishments():
    a, b = legal.punishment("shall be punished with imprisonment which may extend to three years"), legal.punishment("shall be punished with imprisonment which may extend to five years, and fine")
    change = pv.punishment_change(a, b)
    assert change["direction"] == "harsher" and "max_years" in change["harsher"]
    assert pv.punishment_change(b, a)["direction"] == "lighter" and pv.punishment_change(a, a)["direction"] == "same"
    assert pv.punishment_text(a) == "imprisonment up to 3 years" and pv.punishment_text(legal.punishment("")) == "no punishment in the text"
    assert pv.span_of_years(0.5) == "6 months" and pv.span_of_years(1) == "1 year"


def test_reports(family):
    got = {r.new_section: r for r in dr.reports(*family).collect()}
    assert {k: r.drift_class for k, r in got.items()} == {"101": "IDENTICAL", "103": "PUNISHMENT", "118": "RESTRUCTURED", "200": "NEW", "201": "UNVERIFIED"}
    assert got["101"].carry_over == 1.0 and got["118"].old_sections == ["415", "420"] and got["200"].carry_over == 0.0
    assert any(r.startswith("punishment harsher") for r in got["103"].reasons) and "punishment_changed" in got["103"].flags
    kinds = {r.drift_class: r.sections for r in dr.summary(dr.reports(*family)).collect()}
    assert kinds["NEW"] == 1 and sum(kinds.values()) == 5


def test_pairs(family):
    got = {(r.old_section, r.new_section): r for r in dr.pair_drift(*family).collect()}
    assert set(got) == {("300", "101"), ("302", "103"), ("415", "118"), ("420", "118"), ("99", "201"), ("777", "101")}
    assert got["415", "118"].retention == got["420", "118"].retention == 1.0  # each is judged on the clauses that came from it
    assert got["777", "101"].drift_class == "UNVERIFIED" and got["777", "101"].carry_over == 0.6
    assert got["302", "103"].carry_over < got["300", "101"].carry_over == 1.0


def test_dropped_and_lookups(family):
    gone = dr.dropped(*family)
    assert [(r.section, r.inferred) for r in gone.collect()] == [("309", None)]  # 12 was repealed before
    c = {r.section: r.carry_over for r in dr.carried(dr.pair_drift(*family), gone, family[0]).collect()}
    assert c["309"] == 0.0 and c["12"] is None and c["300"] == 1.0
    moved = family[0].sparkSession.createDataFrame([("q", "old:309"), ("q", "old:302"), ("q", "new:101"), ("q", "old:302")], "query_id string, ref string")
    flags = {r.flag for r in dr.answer_flags(moved, dr.reports(*family), gone, "old", "new").collect()}
    assert flags == {"law changed: old 309 was not re-enacted", "law changed: old 302 -> new 103 (same offence, different punishment)"}
    notes = {r.ref: r.note for r in dr.what_changed(dr.reports(*family), moved.selectExpr("'302' AS ref")).collect()}
    assert "103" in notes["302"]
    offences = moved.sparkSession.createDataFrame([("old:300", "o1"), ("new:101", "o1")], "ref string, offence_id string")
    asked = moved.sparkSession.createDataFrame([("a", "old:300"), ("b", "new:103")], "query_id string, ref string")
    assert {tuple(r) for r in dr.targets(asked, offences, "new").collect()} == {("a", "new:101"), ("b", "new:103")}


def test_empty(family):
    old, new, walk = family
    assert dr.reports(old, new.limit(0), walk).count() == 0 and dr.pair_drift(old.limit(0), new.limit(0), walk).where("drift_class <> 'UNVERIFIED'").count() == 0
    assert {r.drift_class for r in dr.reports(old, new, walk.limit(0)).collect()} == {"NEW"}
    gold = walk.sparkSession.createDataFrame([("1", "new", None), ("2", "same", "fine increased"), ("3", "same", None)], "new string, relation string, note string")
    assert {r.new: r.gold for r in dr.gold_status(gold).collect()} == {"1": "new", "2": "changed", "3": "retained"}
