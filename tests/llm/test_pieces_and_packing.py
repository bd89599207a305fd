import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweave.llm import packing, pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n-1कि़", max_size=900), st.integers(30, 120))
def test_pieces_round_trip(text, limit):
    if not text:
        return
    ps = pieces.pieces(text, limit, 10)
    assert "".join(text[o:e] for _, o, e in ps) == text
    assert all(0 < e - s <= limit and s <= o for s, o, e in ps)
    assert all(a[2] == b[1] for a, b in zip(ps, ps[1:]))


def test_cuts_at_the_coarsest_boundary():
    block = "Facts of it\n\n" + "A sentence here. " * 20
    text = block + "\n\n" + block
    (_, _, first), (s, o, _) = pieces.pieces(text, 400, 20)
    assert text[:first].rstrip() == block.rstrip() and o == first and 0 < o - s <= 20
    long = pieces.pieces("x" * 50 + "क" + "ि" * 3 + "y" * 50, 52, 0)
    assert all(unicodedata.category(("x" * 50 + "क" + "ि" * 3 + "y" * 50)[o])[0] != "M" for _, o, _ in long)


def own(text, limit):
    return [text[o:e] for _, o, e in pieces.pieces(text, limit, 0)]


def test_sections_by_depth_are_merged_among_siblings_only():
    body = "A sentence of it. " * 6
    text = f"# A\n\n{body}\n\n## A1\n\n{body}\n\n## A2\n\n{body}\n\n# B\n\n{body}"
    assert [p.split("\n")[0] for p in own(text, 400)] == ["# A", "# B"]  # A and its two sections fit
    assert [p.split("\n")[0] for p in own(text, 300)] == ["# A", "## A2", "# B"]  # A2 is no sibling of B
    assert [p.split("\n")[0] for p in own(text, 130)] == ["# A", "## A1", "## A2", "# B"]


def test_headings_stay_with_what_follows():
    body = "Words of a long paragraph that goes on. " * 12
    for heads in ("# A\n\n## A1\n\n", "<h1>A</h1>\n<h2>A1</h2>\n", "ORDER\n\n", "1.1 Facts\n\n"):
        text = body + "\n\n" + heads + body + "\n\n" + heads + body
        for limit in (120, 200, 500):
            for p in own(text, limit):
                assert not p.rstrip().endswith(heads.strip().split("\n")[-1]), (heads, limit, p)


def test_lists_and_markup():
    items = "".join(f"- item {i} says so\n" + "".join(f"    - part {j} of it\n" for j in range(3)) for i in range(6))
    got = own("The list:\n" + items, 100)
    assert all(p.startswith(("The list", "- item")) for p in got) and len(got) > 3
    html = "".join(f"<p>Paragraph {i} of the page, with words.</p>" for i in range(20))
    assert all(p.startswith("<p>") and p.endswith("</p>") for p in own(html, 120))
    assert all(p.endswith("。") for p in own("这是一个句子。" * 40, 30))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["# A\n", "## B\n\n", "1.2 C\n", "- x y z\n", "  - w\n", "word " * 9, "One. Two! ", "\n\n", "<h2>T</h2>", "<li>q</li>\n", "x" * 45]), min_size=1, max_size=40), st.integers(20, 90))
def test_structured_round_trip(parts, limit):
    text = "".join(parts)
    got = own(text, limit)
    assert "".join(got) == text and all(0 < len(p) <= limit for p in got)


def test_split_table(spark):
    df = spark.createDataFrame([("t", "1", 0, "a b " * 100, 9), ("t", "2", 0, "short", 9), ("t", "3", 0, None, 9), ("t", "4", 0, "", 9), ("t", "1", 0, "a b " * 100, 9)], "tbl string, rec_id string, para int, text string, piece int")
    got = pieces.split(df, 150, 20).collect()
    assert {r.rec_id for r in got} == {"1"} and all(len(r.text) <= 150 for r in got)
    assert pieces.split(df.limit(0), 150, 20).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_covers_the_histogram(seed):
    r = random.Random(seed)
    hist = {}
    for _ in range(3000):
        n = min(2048, max(1, int(r.lognormvariate(5.5, 0.9))))
        hist[n] = hist.get(n, 0) + 1
    hist[700] = 1500  # a size that a third of all items share
    p = packing.plan(hist)
    used = {}
    for sizes, n in p:
        assert sum(sizes) <= 2048 and n > 0
        for l in sizes:
            used[l] = used.get(l, 0) + n
    assert used == hist
    assert sum(l * n for l, n in hist.items()) / 2048 / sum(n for _, n in p) > 0.98 or seed == 99


@pytest.mark.parametrize("bucket", [1_000_000, 7])
def test_packed_round_trip(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    rows = [(i, "law " * (i % 9 + 1), "x") for i in range(120)] + [(500, "word " * 5000, "x"), (501, None, "x"), (502, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    got = packing.packed(df, capacity=64).collect()
    size = {r.doc_id: r.tokens for r in packing.sizes(df).collect()}
    total, per = {}, {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        per[r.container] = per.get(r.container, 0) + r.tokens
        assert r.tokens == 64 or r.first + r.tokens == size[r.doc_id]
    assert total == size and max(per.values()) <= 64 and set(per) == set(range(len(per)))
    assert all(n == 1 for n in {d: sum(1 for r in got if r.doc_id == d) for d in size if size[d] <= 64}.values())
    assert len(per) <= sum(size.values()) / 64 * 1.03 + 1


def test_packed_empty(spark):
    assert packing.packed(spark.createDataFrame([(1, None)], "doc_id long, text string")).count() == 0
    assert packing.fill(spark.createDataFrame([(0, 64), (1, 32)], "container long, tokens int"), 64).select(F.round("filled", 3)).first()[0] == 0.75
