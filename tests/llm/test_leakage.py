import random

import pytest

from lexweave.llm import leakage

rng = random.Random(2)
WORDS = [f"{a}{b}{c}" for a in "kmtrs" for b in "aeiou" for c in "lnprst"]


def make(n):
    return [rng.choice(WORDS) for _ in range(n)]


ITEM = make(40)


def test_windows():
    auto, words = leakage._automaton([(1, " ".join(ITEM))], 5)
    find = lambda t: leakage.passages(t, auto, words, 5, 15, 2)
    noise = lambda n: ["zz" + w for w in make(n)]
    whole = " ".join(noise(9) + ITEM[3:20] + noise(9))
    (item, n, s, e), = find(whole)
    assert item == 1 and n >= 17 and " ".join(ITEM[3:20]) in whole[s:e]
    assert not find(" ".join(noise(9) + ITEM[3:14] + noise(9)))
    changed = ITEM[0:5] + ["zzx"] + ITEM[6:11] + ["zzy"] + ITEM[12:18]
    dropped = ITEM[0:6] + ITEM[7:12] + ITEM[13:19]
    added = ITEM[0:7] + ["zzq"] + ITEM[7:15]
    for p in (changed, dropped, added):
        assert find(" ".join(noise(9) + p + noise(9))), p
    assert find(" ".join(noise(3) + ITEM[3:20]).upper().replace(" ", " -- "))
    assert find("".join(ITEM[3:20]))  # lost spaces
    assert not find(" ".join(x for w in ITEM for x in (w, "zz")))


def test_against_brute_force():
    """Passages edited at random positions are found exactly when fifteen words are left with at most two edits."""
    auto, words = leakage._automaton([(7, " ".join(ITEM))], 5)
    for _ in range(200):
        at, n = rng.randrange(0, 20), rng.randrange(8, 20)
        part, edits = ITEM[at : at + n], rng.randrange(0, 3)
        spots = set(rng.sample(range(1, n - 1), edits))
        text = " ".join(["zzzz"] * 6 + [("zzzz" if i in spots else w) for i, w in enumerate(part)] + ["zzzz"] * 6)
        found = bool(leakage.passages(text, auto, words, 5, 15, 2))
        left = max((sum(1 for _ in run) for run in [[1] * n]), default=0)
        if left >= 15:
            assert found
        if n + 2 - edits < 15:
            assert not found


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_tables(spark, block):
    items = spark.createDataFrame([(1, "en", " ".join(ITEM)), (2, "en", " ".join(ITEM)), (3, None, None), (4, "en", ""), (5, "en", "too short")], "item_id long, lang string, text string")
    docs = spark.createDataFrame([(1, "x " * 50_000 + " ".join(ITEM), 0), (2, None, 0), (3, "", 0), (4, "nothing", 0), (4, "nothing", 0)], "doc_id long, text string, item_id int")
    got = sorted((r.doc_id, r.item_id) for r in leakage.leaked(docs, items, block_chars=block).collect())
    assert got == [(1, 1), (1, 2)]
    assert leakage.leaked(docs.limit(0), items).count() == 0 and leakage.leaked(docs, items.limit(0)).count() == 0
