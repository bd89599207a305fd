import random

import pytest

from lexweave.llm import sentences as se

TRAIN = [
    'Dr. Roe saw Mr. A. B. Poe near the shop at 9.30 p.m. and left. The police at Omgarh recovered Rs. 4,500.50 on 3.4.2010! "Stop there." The State answers that P.W. 6 spoke twice. Counsel asked, "Who came? Ask Mr. Roe." and left it there.\n\nIssues\nIn State v. Poe & Ors., 2010 Vin. Cr. J. 55, the court said so. Is it enough? It is.',
    "पुलिस ने चाकू बरामद किया। श्री रमेश ने कहा, “पैसे किसने लिए? मुझे फँसाया गया है।” पर उत्तर नहीं मिला। डॉ. मोहन को 4,500 रु. दिए गए।\n\nआदेश\n\nअपील खारिज की जाती है।",
    "1. The appeal fails. No costs.\n\n2. The record goes back:\n(a) to Omgarh by June;\n(b) to Roegarh by July.",
] * 30


@pytest.fixture(scope="module")
def model():
    return se.train(TRAIN)


def cut(text, model):
    out, at = [], 0
    for e in se.ends(text, model):
        out.append(text[at:e].strip())
        at = e
    return out


@pytest.mark.parametrize("units", [
    ["Dr. Zoe met Mr. B. C. Dole at 8.15 p.m. and left.", "The fine of Rs. 3,000.20 stands!", "Is it due?"],
    ['Counsel asked, "Where is it? Give it back." and left it there.', "The appeal fails."],
    ["पुलिस ने रस्सी बरामद की।", "डॉ. सोहन को 500 रु. दिए गए।"],
])
def test_units(units, model):
    assert cut(" ".join(units), model) == units


def test_layout(model):
    t = "Issues\nIn State v. Roe, the court\nsaid so. It was\nright.\n\nOrder\n\n1. The appeal fails.\n\nThe record goes back:\n(a) to Omgarh;\n(b) to Roegarh."
    assert cut(t, model) == ["Issues", "In State v. Roe, the court\nsaid so.", "It was\nright.", "Order", "1. The appeal fails.", "The record goes back:", "(a) to Omgarh;", "(b) to Roegarh."]


def test_edges(spark, model):
    long = "word " * 40_000
    df = spark.createDataFrame([("t", "1", None, 0), ("t", "2", "", 0), ("t", "3", "  \n ", 0), ("t", "4", "no mark at all ", 0), ("t", "5", long, 0), ("t", "4", "no mark at all ", 0)], "tbl string, rec_id string, text string, end_pos int")
    got = sorted((r.rec_id, r.end_pos) for r in se.units(df, model).collect())
    assert got == [("4", 14), ("4", 14), ("5", len(long) - 1)]
    assert se.units(df.limit(0), model).count() == 0


def test_units_cover_the_text(model):
    for t in TRAIN[:3]:
        ends = se.ends(t, model)
        assert ends == sorted(set(ends)) and ends[-1] == len(t.rstrip())


def test_training_is_bounded(spark):
    df = spark.createDataFrame([(f"Text no. {i}. It ends.",) for i in range(300)] + [(None,)], "text string")
    assert 0 < len(se.training_texts(df, "text", 50)) <= 50 and se.training_texts(df.limit(0), "text") == []
    assert se.ends("One. Two.", se.train([])) == [9]


def test_case_is_that_of_the_surroundings():
    capitals = "THE WITNESS SAW A KNIFE. " * 200
    for head in ("पुलिस ने चाकू बरामद किया। " * 150, "The witness saw a knife near the shop. " * 100):
        got = se.candidates(head + capitals)
        assert any(f.startswith("n:upper:upper") for f in got[-5].feats)
        assert se._cases(head + capitals)(0) == ("none" if head[0] == "प" else "mixed")


def test_gaps_end_units_where_marks_are_missing():
    said = ["पुलिस ने चाकू बरामद किया", "गवाह ने सच कहा", "न्यायालय ने अपील खारिज की", "रमेश दुकान के पास खड़ा था"]
    texts = [" ".join(f"{said[(i * k + k) % 4]}।" for k in range(1, 7)) for i in range(60)]
    told = [said[3], said[0], said[2], said[1]]
    assert cut(" ".join(told), se.train(texts)) == told
    assert len(se.ends(" ".join(f"{x}।" for x in told), se.train(texts))) == 4


def test_marks_are_deleted_with_their_ends_kept():
    text = "Roe left the shop. Is it due? Dr. Poe said so."
    bare, ends = next(x for x in map(se.without_marks, (text + " " * k for k in range(20))) if "shop." not in x[0])
    assert {bare[:e].split()[-1] for e in ends} == {"shop", "due", "so"} and "Dr." in bare


@pytest.mark.parametrize("mark", ["؟", "॥"])
def test_more_marks(mark, model):
    first = f"کیا وہ آیا{mark}"
    assert any(c.end == len(first) and c.sure for c in se.candidates(first + " وہ چلا گیا۔"))


def _chinese(rng):
    who = rng.choice(["法院", "原告", "被告", "证人", "警方"])
    did = rng.choice(["驳回了上诉", "提交了证据", "离开了现场", "支持这一请求", "没有回答问题", "认为理由不足"])
    when = rng.choice(["昨天", "当天晚上", "在审理中", "随后", ""])
    return who + when + did


def _thai(rng):
    who = rng.choice(["ศาล", "โจทก์", "จำเลย", "พยาน", "ตำรวจ"])
    did = rng.choice(["ยกฟ้องคดีนี้", "ยื่นหลักฐานใหม่", "ออกจากที่เกิดเหตุ", "เห็นด้วยกับคำขอ", "ไม่ตอบคำถาม"])
    return who + rng.choice(["เมื่อวาน", "ในวันนั้น", ""]) + did


@pytest.mark.parametrize(("make", "mark"), [(_chinese, "。"), (_thai, "。"), (lambda r: " ".join([r.choice(["the court", "the state", "he", "counsel"]), r.choice(["dismissed", "heard", "left"]), r.choice(["the appeal", "the case", "it", "the matter"])]), ". ")])
def test_scripts_with_marks_deleted(make, mark):
    rng = random.Random(4)
    text = lambda: "".join(make(rng) + mark for _ in range(rng.randrange(3, 9))).strip()
    model = se.train([text() for _ in range(300)])
    held = [text() for _ in range(80)]
    for t in held[:10]:
        assert len(se.ends(t, model)) == t.count(mark.strip())  # with its marks every unit is found
    given, true, both = map(sum, zip(*se.stripped_scores(held, model).values()))
    assert 2 * both / (given + true) > 0.85, (given, true, both)


def test_case_and_blanks_far_down(model):
    text = "Facts\n\n" + "He left. " * 500 + "\n" + " " * 200 + "\n" + "the order stands"
    assert cut(text, model)[-1] == "the order stands" and cut(text, model)[0] == "Facts"
