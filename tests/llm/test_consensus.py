import random
from datetime import datetime

import pytest

from lexweave.llm import consensus

C = {"t": ["0", "1", "2"]}
SCH = "tbl string, unit string, doc_id string, judge string, at timestamp, label string"
T = datetime(2024, 1, 1)


def test_trustworthy_judges_outweigh_the_majority(spark):
    rng, truth, rows = random.Random(1), {}, []
    for i in range(400):
        y = truth[f"u{i}"] = rng.randrange(3)
        for j in range(3):
            rows.append(("t", f"u{i}", "d", f"good{j}", T, str(y if rng.random() < 0.9 else rng.randrange(3))))
        for j in range(4):
            rows.append(("t", f"u{i}", "d", f"spam{j}", T, str((y + 1) % 3 if j < 2 and rng.random() < 0.8 else rng.randrange(3))))
    df = spark.createDataFrame(rows, SCH)
    ratings = consensus.last_valid(df)
    items, fitted = consensus.fit(ratings, C)
    got = {r.unit: (r.label, r.confidence) for r in items.collect()}
    votes = {}
    for _, u, _, _, _, l in rows:
        votes.setdefault(u, []).append(l)
    majority = sum(max(sorted(set(v)), key=v.count) == str(truth[u]) for u, v in votes.items())
    ours = sum(got[u][0] == str(y) for u, y in truth.items())
    assert ours >= 0.95 * len(truth) and ours > majority
    rel = {r.judge: r.reliability for r in consensus.reliability(fitted, C).collect()}
    assert min(rel[f"good{j}"] for j in range(3)) > 0.75 > 0.5 > max(rel[f"spam{j}"] for j in range(4))
    a = consensus.agreement(items, ratings).first()
    assert 0 < a.observed < 1 and a.alpha < a.observed


def test_cleaning_and_edges(spark):
    later = datetime(2024, 2, 1)
    rows = [("t", "u", "d", "a", T, "0"), ("t", "u", "d", "a", later, "2"), ("t", "u", "d", "a", datetime(2025, 1, 1), None), ("t", "u", "d", "b", T, "2"), ("t", "u", "d", "b", T, "2"), ("t", "v", "", "b", None, "1"), ("t", None, "d", "b", T, "1"), ("t", "w", "d", None, T, "1"), ("t", "x", "d", "a", T, "9")]
    ratings = consensus.last_valid(spark.createDataFrame(rows, SCH))
    items, _ = consensus.fit(ratings, C, rounds=2)
    got = {r.unit: (r.label, r.n_judges, r.n_labels) for r in items.collect()}
    assert got == {"u": ("2", 2, 1), "v": ("1", 1, 1)}
    items, fitted = consensus.fit(ratings.limit(0), C, rounds=2)
    assert items.count() == 0 and consensus.reliability(fitted, C).count() == 0


def many_ratings(spark, judges, units):
    rng, rows = random.Random(3), []
    for i in range(units):
        y = rng.randrange(3)
        for j in range(judges if i == 0 else 5):  # one item that every judge has seen
            rows.append(("t", f"u{i}", None, f"j{j}", T, str(y if rng.random() < (0.9 if j % 3 else 0.3) else rng.randrange(3))))
    return consensus.last_valid(spark.createDataFrame(rows, SCH))


def test_joined_tilts_give_what_sent_ones_give(spark, monkeypatch):
    ratings = many_ratings(spark, 30, 60)
    labels = lambda: {r.unit: (r.label, round(r.confidence, 6)) for r in consensus.fit(ratings, C, rounds=3)[0].collect()}
    sent = labels()
    monkeypatch.setattr(consensus, "SENT_BYTES", 0)
    assert labels() == sent


@pytest.mark.parametrize("sent", [64_000_000, 0])
def test_an_item_in_parts_is_labelled_as_a_whole_one(spark, monkeypatch, sent):
    ratings = many_ratings(spark, 60, 40)
    whole = {r.unit: r for r in consensus.fit(ratings, C, rounds=8)[0].collect()}
    monkeypatch.setattr(consensus, "CHUNK", 10)
    monkeypatch.setattr(consensus, "SENT_BYTES", sent)
    cut = {r.unit: r for r in consensus.fit(ratings, C, rounds=8)[0].collect()}
    assert cut["u0"].n_judges == 60 and (cut["u0"].label, cut["u0"].agreement) == (whole["u0"].label, whole["u0"].agreement)
    assert sum(cut[u].label == w.label for u, w in whole.items()) >= 39
