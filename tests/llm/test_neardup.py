import random

import pytest

from lexweave.llm import neardup
from lexweave.llm._text import outer_stripped

rng = random.Random(5)
WORDS = [f"w{i}" for i in range(400)]


def base(n):
    return [rng.choice(WORDS) for _ in range(n)]


def edited(words, share):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < share / 3 else [rng.choice(WORDS)] if x < 2 * share / 3 else [w, rng.choice(WORDS)] if x < share else [w]
    return out


def jaccard(a, b, size):
    x, y = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (outer_stripped(a), outer_stripped(b)))
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for g in range(40):
        b = base(120)
        rows += [(f"{g}-{k}", " ".join(edited(b, e))) for k, e in enumerate((0, 0.02, 0.06, 0.12))]
    rows += [("copy-1", rows[0][1]), ("copy-2", rows[0][1].upper() + " !!"), ("none", None), ("empty", ""), ("short", "one two"), ("short2", "one two"), ("long", " ".join(base(60_000)))]
    return rows, spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id string, text string, cls string, keys int")


@pytest.mark.parametrize(("size", "threshold"), [(3, 0.5), (5, 0.8)])
def test_pairs_against_brute_force(corpus, size, threshold):
    rows, df = corpus
    want = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if x and y and "long" not in (a, b) and jaccard(x, y, size) >= threshold:
                want.add((min(a, b), max(a, b)))
    got = {tuple(r) for r in neardup.pairs(df, "id", "text", size, threshold).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 20


def test_hot_keys_in_parts_and_texts_by_a_join(corpus, monkeypatch):
    rows, df = corpus
    df = df.unionByName(df.where("id = '0-0'").selectExpr("explode(sequence(1, 12)) AS i", "text", "cls", "keys").selectExpr("concat('again-', i) AS id", "text", "cls", "keys"))
    whole = {tuple(r) for r in neardup.pairs(df, "id", "text", 3, 0.5).collect()}
    monkeypatch.setattr(neardup, "BUCKET", 3)
    monkeypatch.setattr(neardup, "SENT_PAIRS", 0)
    assert {tuple(r) for r in neardup.pairs(df, "id", "text", 3, 0.5).collect()} == whole
    assert sum(a.startswith("again") and b.startswith("again") for a, b in whole) == 66


def test_groups_keep_copies_as_membership(corpus):
    _, df = corpus
    g = {r.key: (r.cls, r.copies) for r in neardup.groups(df, "id", "text").collect()}
    assert g["copy-1"] == g["copy-2"] == g["0-0"] and g["copy-1"][1] == 3
    assert "none" not in g and "empty" not in g and "short" not in g and "long" in g


def test_last_version_holds(spark):
    a, b = " ".join(base(50)), " ".join(base(50))
    df = spark.sql(f"SELECT * FROM VALUES ('x', TIMESTAMP'2020-01-01', '{a}'), ('x', TIMESTAMP'2021-01-01', '{b}'), ('y', TIMESTAMP'2020-01-01', '{a}'), ('z', TIMESTAMP'2020-01-01', '{b}') AS t(id, at, text)")
    assert [tuple(r) for r in neardup.pairs(df, "id", "text", 3, 0.5, "at").collect()] == [("x", "z")]


def test_empty(corpus):
    _, df = corpus
    assert neardup.pairs(df.limit(0), "id", "text", 3, 0.5).count() == 0


def test_p4_groups_has_a_row_for_every_text(spark, tmp_path):
    from lexweave.llm import queries

    long = " ".join(base(50))
    docs = [(1, long), (2, long), (3, "one two"), (4, "One two!"), (5, None), (6, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prec = spark.sql(f"SELECT * FROM VALUES ('P1', TIMESTAMP'2020-01-01', array('{long}')), ('P1', TIMESTAMP'2021-01-01', array('a b')), ('P2', TIMESTAMP'2020-01-01', null), ('P3', TIMESTAMP'2020-01-01', array('a', 'b')) AS t(id, loaded_at, text)")
    prec.write.parquet(f"{tmp_path}/precedents.parquet")
    got = {(r.tbl[0], r.key): (r.cls, r.copies, r.links) for r in queries.p4_groups(spark, str(tmp_path)).collect()}
    assert got == {("d", "1"): ("1", 2, 0), ("d", "2"): ("1", 2, 0), ("d", "3"): ("3", 2, 0), ("d", "4"): ("3", 2, 0), ("d", "5"): ("5", 1, 0), ("d", "6"): ("6", 1, 0), ("p", "P1"): ("P1", 2, 0), ("p", "P2"): ("P2", 1, 0), ("p", "P3"): ("P1", 2, 0)}
