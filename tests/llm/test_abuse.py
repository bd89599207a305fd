import random

import numpy as np
import pytest

from lexweave.llm import abuse

NEUTRAL = "the police recovered a knife from the shop near the canal and the witness spoke of a dog that slept on the road while counsel read the order aloud to the judge".split()
ABUSE = ["you are a worthless idiot and everyone here knows it", "all of them are vermin and should be driven out", "chup kar kutta teri zubaan kaat dunga", "you filthy bastard shut your mouth or i will break your arm"]


def clean(n, seed):
    r = random.Random(seed)
    return [r.choice(NEUTRAL) for _ in range(n)]


@pytest.fixture(scope="module")
def machine():
    windows, labels = [], []
    for i in range(600):
        windows.append(clean(abuse.WINDOW, i))
        labels.append(0)
    for i in range(160):
        w = abuse.terms(ABUSE[i % 4], {}) + clean(8, 1000 + i)
        windows.append(w[: abuse.WINDOW])
        labels.append(int(abuse.seeded(w)))
    return abuse.fit(windows, labels)


def score(text, machine):
    return machine.score(np.asarray([abuse.slot(w) for w in abuse.terms(text, {})], np.int64))


def test_disguises():
    assert [abuse.plain(x) for x in ("$w1n3", "nud3", "veeeermiiiin", "n***d", "1d10t")] == ["swine", "nude", "vermin", "naked", "idiot"]
    assert abuse.terms("you i d i o t are a b a s t a r d", {}) == ["you", "idiot", "are", "bastard"]
    assert abuse.plain("p-17".replace("-", "")) == "p17"


def test_held_out_scores(machine):
    for i in range(20):
        text = " ".join(clean(60, 7000 + i))
        assert score(text, machine) < 0.5
        assert score(text + " " + ABUSE[i % 4] + " " + text, machine) > 0.9


def test_tables(spark, machine):
    rows = [(1, "a", " ".join(clean(3000, 1)) + " " + ABUSE[0], 1.0), (2, "a", " ".join(clean(50, 2)), 1.0), (3, None, None, 1.0), (4, "b", "", 1.0), (5, "b", "idiot", 1.0), (2, "a", " ".join(clean(50, 2)), 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, score double")
    got = abuse.scored(df, machine)
    s = {r.doc_id: r.score for r in got.collect()}
    assert s[1] > 0.9 and s[2] < 0.5 and s[3] == s[4] == 0 and len(got.collect()) == 6
    rate = {r.source: (r.texts, r.abusive) for r in abuse.rates(got, 0.9).collect()}
    assert rate["a"] == (3, 1) and rate[None] == (1, 0)
    assert abuse.scored(df.limit(0), machine).count() == 0


def test_training_windows(spark):
    df = spark.createDataFrame([(" ".join(clean(200, i)) + " " + ABUSE[i % 4],) for i in range(40)] + [(None,), ("",)], "text string")
    windows, labels = abuse.training_windows(df, "text", 50)
    assert len(windows) <= 50 and 0 < sum(labels) <= len(labels)
    assert abuse.training_windows(df.limit(0), "text") == ([], [])


def test_every_seed_is_learnt_whatever_the_sample(spark):
    rare = [(" ".join(clean(40, 900)) + " kutiya",), (" ".join([*clean(9, 901), "nangi", "wali", "photo", "mujhe", "bhej", *clean(30, 903)]),)]
    common = [(" ".join(clean(30, i)) + " idiot",) for i in range(300)]
    df = spark.createDataFrame(common + rare, "text string")
    windows, labels = abuse.training_windows(df, "text", 1000, 10)
    found = [set(w) for w, y in zip(windows, labels) if y]
    assert any("kutiya" in w for w in found) and any({"nangi", "photo", "bhej"} <= w for w in found)
    assert 0 < sum("idiot" in w for w in found) <= 6 and len(windows) <= 1000
    assert not any(abuse.seeded(w) for w, y in zip(windows, labels) if not y)


#: Per language: words of sober texts, seeded wording, and held-out wording that no seed and no pattern covers.
WORDING = {
    "en": (NEUTRAL, ["these people are vermin who deserve nothing", "drive the vermin out", "your whole family is trash", "trash is what that family was", "send me nude pictures now", "share nude pictures or else"], ["vermin is what they are", "such trash he is your whole kind", "nude pictures of you please"]),
    "hi": ("पुलिस ने दुकान से चाकू बरामद किया और गवाह ने अदालत में बयान दिया कि वह वहाँ था".split(), ["ये लोग कीड़े हैं जीने लायक नहीं", "तेरी जीभ काट दूँगा", "नंगी तस्वीर भेज"], ["सब कीड़े हैं यहाँ", "जीभ खींच कर काट", "नंगी तस्वीर चाहिए"]),
    "hinglish": ("police ne dukaan se chaaku baramad kiya aur gawah ne adalat mein bayan diya ki woh wahan tha".split(), ["ye log keede hain jeene layak nahi", "teri zubaan kaat dunga", "nangi photo bhej"], ["saare keede hain yahan", "zubaan kheench kar kaat", "nangi photo chahiye"]),
    "mr": ("पोलिसांनी दुकानातून चाकू जप्त केला आणि साक्षीदाराने न्यायालयात जबाब दिला".split(), ["हे लोक किडे आहेत वाचण्याचा", "नागडे फोटो पाठव", "मारून देशातून हाकलून"], ["सगळे किडे आहेत", "नागडे फोटो हवे", "देशातून हाकलून द्या"]),
    "bn": ("পুলিশ দোকান থেকে ছুরি উদ্ধার করে এবং সাক্ষী আদালতে জবানবন্দি দেয়".split(), ["এরা পোকা বাঁচার অধিকার নেই", "নগ্ন ছবি পাঠা", "তোর হাড় ভেঙে দেব"], ["সব পোকা এখানে", "নগ্ন ছবি চাই", "হাড় ভেঙে যাক"]),
    "ta": ("காவல்துறை கடையிலிருந்து கத்தியை மீட்டது சாட்சி நீதிமன்றத்தில் வாக்குமூலம் அளித்தார்".split(), ["இவர்கள் பூச்சிகள் வாழத் தகுதியற்ற", "நிர்வாணப் படத்தை அனுப்பு", "உன் எலும்பை உடை"], ["எல்லாம் பூச்சிகள்", "நிர்வாணப் படத்தை வேண்டும்", "எலும்பை உடை போ"]),
    "ur": ("پولیس نے دکان سے چاقو برآمد کیا اور گواہ نے عدالت میں بیان دیا".split(), ["یہ لوگ کیڑے ہیں جینے لائق نہیں", "ننگی تصویر بھیج", "تیری زبان کاٹ دوں"], ["سب کیڑے ہیں", "ننگی تصویر چاہیے", "زبان کھینچ کاٹ"]),
}


def test_wording_that_is_in_no_list(spark):
    rng = random.Random(1)
    texts = []
    for sober, seeded, _ in WORDING.values():
        for i in range(240):
            said = [rng.choice(seeded)] if i % 4 == 0 else []
            texts.append((" ".join([*rng.choices(sober, k=30), *said, *rng.choices(sober, k=30)]),))
    machine = abuse.fit(*abuse.training_windows(spark.createDataFrame(texts, "text string"), "text"))
    for lang, (sober, _, held) in WORDING.items():
        assert not any(abuse.seeded(abuse.terms(h, {})) for h in held), lang
        found = [score(" ".join([*rng.choices(sober, k=25), h, *rng.choices(sober, k=25)]), machine) for h in held for _ in range(10)]
        clear = [score(" ".join(rng.choices(sober, k=60)), machine) for _ in range(20)]
        assert sum(f > max(clear) for f in found) >= 0.9 * len(found) and max(clear) < 0.5, (lang, found, max(clear))
