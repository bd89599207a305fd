import random

import pytest

from lexweave.llm import langid

TEXT = {
    "en": "the police recovered a knife from the shop and the witness said so on oath before the judge who heard the appeal in the afternoon".split(),
    "hinglish": "police ne dukaan se chaku baramad kiya aur gawah ne bataya ki usne use nahar ke paas dekha tha lekin kuchh nahi hua".split(),
    "hi": "पुलिस ने दुकान से चाकू बरामद किया और गवाह ने बताया कि उसने उसे नहर के पास देखा था लेकिन कुछ नहीं हुआ".split(),
    "mr": "पोलिसांनी दुकानातून चाकू जप्त केला आणि साक्षीदारांनी सांगितले की त्यांनी त्याला कालव्याजवळ पाहिले होते परंतु काहीच झाले नाही".split(),
    "bn": "পুলিশ দোকান থেকে ছুরি উদ্ধার করে এবং সাক্ষী বলেন যে তিনি তাকে খালের ধারে দেখেছিলেন".split(),
    "ta": "காவல்துறை கடையில் கத்தி கைப்பற்றியது சாட்சி அவரை கால்வாய் அருகே பார்த்ததாகச் சொன்னார்".split(),
    "ur": "پولیس نے دکان سے چاقو برآمد کیا اور گواہ نے بتایا کہ اس نے اسے نہر کے پاس دیکھا تھا".split(),
}


def sentence(lang, n=14, seed=0):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(TEXT[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def trained():
    return langid.train([(sentence(l, 40, s), l) for l in langid.LANGS for s in range(20)])


def test_held_out(trained):
    m = langid.Scorer(*trained)
    for lang in langid.LANGS:
        right = [{s[0] for s in langid.segments(sentence(lang, 14, 900 + k), m)} == {lang} for k in range(20)]
        assert sum(right) >= 19, lang


def test_mixed_and_confidence(trained):
    m = langid.Scorer(*trained)
    t = sentence("en", 12, 1) + ". " + sentence("hi", 9, 2) + "। " + sentence("mr", 9, 3)
    got = langid.segments(t, m)
    assert [g[0] for g in got] == ["en", "hi", "mr"] and all(0.5 < g[1] <= 1 for g in got)
    assert [g[0] for g in langid.segments(sentence("hi", 9, 2) + " VPC FIR " + sentence("hi", 9, 4), m)][0] == "hi"
    assert langid.segments("", m) == [] and langid.segments("123 ... 45", m) == []


def test_labels(spark, trained):
    rows = [("t", "1", "en-IN", sentence("en")), ("t", "2", "hi", sentence("en")), ("t", "3", None, sentence("ur")), ("t", "4", "??", ""), ("t", "5", "en", None), ("t", "6", "en", sentence("en") + ". " + sentence("bn")), ("t", "6", "en", sentence("en") + ". " + sentence("bn"))]
    df = spark.createDataFrame(rows, "tbl string, rec_id string, label string, text string")
    got = sorted((r.rec_id, r.lang) for r in langid.wrong_labels(langid.labelled(df, trained)).collect())
    assert got == [("2", "en"), ("3", "ur"), ("6", "bn"), ("6", "en")]
    assert langid.labelled(df.limit(0), trained).count() == 0


def test_training_rows_are_bounded(spark):
    df = spark.createDataFrame([(sentence(l, 9, k), l) for l in langid.LANGS for k in range(60)] + [(None, "en"), ("x", None)], "text string, lang string")
    assert 0 < len(langid.training_rows(df, "text", "lang", 70)) <= 70
    assert langid.training_rows(df.limit(0), "text", "lang") == []
