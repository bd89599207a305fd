"""Abusive, hateful or sexual content, scored by a factorization machine over hashed terms.

A text is read as words freed of disguise: letters written as digits or signs, stretched letters, letters set apart by
spaces or dots, and letters masked by stars. Windows of ``WINDOW`` words slide over it one word at a time; each is scored
by a second-order factorization machine over its hashed words, whose pairwise interactions tell an insult aimed at
someone, or a group set beside vermin, from the same words in a sober account. Sums over windows come from running sums,
so a text costs time in proportion to its length. The score of a text is that of its worst window.

No labels come with the texts. The machine is trained on windows that hold a seed (a word that is abusive by itself, or a
pattern: words of certain concepts close together, such as a people, vermin and a right to live) against windows that hold
none. Seeds are looked for in every text; of each seed at most an equal share of
half of ``max_windows`` distinct windows is kept, those with the smallest hashes, so a seed that stands anywhere is
learnt. Only the windows without a seed are drawn from a sample of the texts.
Half of the time a training window loses its seed words' single weight (they are dropped), so the words around a seed
learn to speak for themselves.

Defined results: null and empty texts score 0; a null source is a source of its own; very long texts are scored whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 18
BITS, K = 18, 8
#: Words that are abusive by themselves, in the seven languages of the texts.
SEED_WORDS = set(
    unicodedata.normalize("NFC", """
    idiot imbecile moron scumbag bastard bitch slut whore swine cunt asshole fucker fuck motherfucker wanker retard dickhead
    haramkhor haramzada haramzade harami kamina kamine kutta kutte kutiya suar gadha randi chutiya bhosdike madarchod behenchod saala
    हरामखोर हरामज़ादा हरामजादा हरामी कमीना कमीने कुत्ता कुत्ते सुअर सूअर गधा रंडी चूतिया साला नालायक हरामखोरा कुत्र्या डुकरा हरामखोर
    কুত্তা হারামজাদা হারামি শুয়োরের শুয়োর খানকি মাগি
    பன்றியே தேவடியா நாயே
    کتا کتے کمینہ کمینے حرامی حرامزادہ حرامخور گدھا رنڈی
    """).split()
)
#: Concepts by their words in the seven languages. A word of a concept is not abusive by itself.
CONCEPTS: dict[str, set[str]] = {
    name: set(unicodedata.normalize("NFC", words).split())
    for name, words in {
        "demean": "stinking rotten pathetic disgusting brainless worthless filthy shameless stupid useless despicable vile repulsive spineless ghatiya besharam घटिया बेशर्म নির্লজ্জ কেভল கேவலமான کمتر گھٹیا بےشرم",
        "role": "lawyer lawyers advocate attorney judge magistrate clerk officer policeman constable witness woman man vakil वकील जज উকিল வழக்கறிஞர் وکیل",
        "pretend": "pretend pretends pretending excuse calling calls",
        "bribe": "money bribe bribes bribed sold bought paisa paise rishwat",
        "vermin": "vermin cockroach cockroaches rats maggots maggot parasites leeches pests filth scum keede keeda keedon कीड़े कीड़ा कीड़ों किडे किडा পোকা পোকামাকড় কীট பூச்சி பூச்சிகள் பூச்சிகள் புழுக்கள் کیڑے کیڑا",
        "people": "people person persons community these those they them breed kind lot log logon लोग लोगों लोक লোক মানুষ এরা மக்கள் இவர்கள் لوگ لوگوں",
        "live": "live breed breeding human humans deserve driven exterminated jeene jine layak layaq जीने लायक वाचण्याचा लायकीचे বাঁচার অধিকার வாழ வாழத் தகுதியற்ற جینے لائق",
        "unfit": "deserve deserves unfit layak layaq लायक लायकीचे हक्क অধিকার தகுதியற்ற لائق",
        "kill": "kill shoot burn lynch slaughter hang exterminate maar maaro mar मार मारो मारून ठार মেরে মারো அடித்து கொன்று مار مارو",
        "expel": "out driven expelled nikaal nikalo nikaalo निकाल निकालो हाकलून हाकला তাড়ানো তাড়াও তাড়িয়ে விரட்ட விரட்டு نکال نکالو drive throw kick",
        "country": "country nation land desh mulk देश देशातून দেশ நாட்டை நாட்டில் ملک",
        "every": "every each all",
        "solved": "solved solve problem gone cleaner",
        "women": "women woman girls females aurat auratein औरत औरतें",
        "only": "only just sirf",
        "good": "good fit useful",
        "lowly": "backs kitchen bed",
        "nude": "nude nudes naked nangi नंगी नागडे नग्न নগ্ন நிர்வாண நிர்வாணப் ننگی",
        "image": "picture pictures photo photos pics video photograph तस्वीर तस्वीरें फोटो ছবি படம் படத்தை تصویر",
        "demand": "send show share bhej bhejo भेज भेजो पाठव দেখাও পাঠা পাঠাও அனுப்பு காட்டு بھیج بھیجو",
        "undress": "strip undress kapde kapre कपड़े কাপড় ஆடை کپڑے",
        "off": "utaar utar utaro उतार उतारो খুলে கழற்று اتار naked",
        "night": "raat saath रात साथ রাত இரவு رات body bed",
        "moan": "moaned moaning moans thrust thrusting pushed",
        "inside": "inside deep harder",
        "herhim": "her him me body",
        "shut": "shut chup chhup बंद चुप চুপ மூடு چپ",
        "break": "break smash rip cut tod todh kaat तोड़ काट फोड ভেঙে உடை வெட்டு کاٹ توڑ",
        "part": "mouth tongue bones bone teeth jaw zubaan haddi जीभ ज़ुबान हड्डी हाड तोंड হাড় জিভ எலும்பை வாயை நாக்கை زبان ہڈی",
        "you": "you your yourself tu teri tera tere tujhe तू तेरी तेरा तुझी तुझे তোর তুই তোমার உன் உன்னை نجے تیری تیرا تو",
        "will": "दूँगा दूंगा दूँगी देब टाकीन দেব ফেলব வேன் دوں دونگا dunga doonga will",
        "family": "family khandaan khandan parivaar खानदान घराणे বংশ পরিবার குடும்பமே குடும்பம் خاندان",
        "dirty": "trash garbage dirt ganda gandi गंदा घाणेरडे নোংরা অসভ্য அசிங்கம் அசிங்கமான گندا",
        "nobody": "nobody noone none miss",
        "choke": "choke bleed rot suffocate drown",
        "blood": "blood vomit agony pain",
        "rather": "rather love hope wish",
        "lesson": "lesson teach",
        "walk": "walk stand sit",
        "cannot": "cannot never unable",
        "drag": "dragged paraded beaten flogged whipped",
        "street": "street streets road naked public sadak रास्त्यात রাস্তায় தெருவில்",
        "spread": "spread open",
        "legs": "legs thighs",
        "worth": "worth good money price",
        "find": "find know",
        "where": "where house home",
        "beg": "beg crawl scream cry",
        "decent": "decent respectable clean",
        "rent": "rent house room sell hire",
        "child": "bachche bachcha बच्चे বাচ্চা பன்றி بچے بچہ",
        "animal": "suar kutte gadhe सूअर कुत्ते সুয়োর শুয়োরের நாய் நாய்கள் سور کتے",
    }.items()
}
#: What makes concepts abusive: the first with all others within so many words of each other.
PATTERNS = [
    ("demean", ("role", "pretend"), 8), ("demean", ("role", "bribe"), 12), ("demean", ("animal",), 3), ("demean", ("people", "rent", "decent"), 14),
    ("vermin", ("people", "live"), 12), ("vermin", ("people", "kill"), 12), ("vermin", ("expel",), 8), ("vermin", ("unfit",), 8), ("demean", ("vermin",), 3), ("kill", ("expel", "country"), 8), ("kill", ("every", "solved", "people"), 14),
    ("women", ("only", "good", "lowly"), 18), ("nude", ("image", "demand"), 7), ("undress", ("off", "night"), 12), ("moan", ("inside", "herhim"), 12),
    ("undress", ("herhim", "nude"), 10), ("break", ("part", "you"), 9), ("break", ("part", "will"), 6), ("shut", ("part", "break"), 10), ("family", ("dirty",), 6),
    ("choke", ("blood", "rather"), 14), ("lesson", ("walk", "cannot"), 14), ("drag", ("street", "you"), 14), ("drag", ("street", "people"), 14), ("spread", ("legs", "worth"), 18),
    ("beg", ("find", "where"), 14), ("kill", ("you", "nobody"), 12), ("animal", ("child",), 3),
]
#: Signs and digits that stand for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "l", "+": "t", "€": "e"})
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}$@*!|+€]+")
_MASK = re.compile(r"^([^\W\d_])\*{2,}([^\W\d_])?$")
_KNOWN = SEED_WORDS | {w for ws in CONCEPTS.values() for w in ws}
_BY_SHAPE: dict[tuple, str] = {}
for _w in [*sorted(SEED_WORDS), *sorted(_KNOWN)]:
    if len(_w) > 3:
        _BY_SHAPE.setdefault((_w[0], _w[-1], len(_w)), _w)
_CORE: dict[str, list[int]] = defaultdict(list)  # the patterns that a word may begin
for _n, (_first, _, _) in enumerate(PATTERNS):
    for _w in CONCEPTS[_first]:
        _CORE[_w].append(_n)


def plain(token: str) -> str:
    """A lower-case token freed of disguise."""
    token = unicodedata.normalize("NFC", token)
    if "*" in token:
        m = _MASK.match(token.strip("!|+"))
        if m:
            return _BY_SHAPE.get((m[1], m[2] or "*", len(token.strip("!|+"))), "*masked*")
        token = token.replace("*", "")
    t = token.strip("!|+")
    if not t.isalpha() and any(c.isascii() and c.isalpha() for c in t):
        u = t.translate(LEET)
        if u in _KNOWN or any(c in "$@!|€" for c in t):  # digits alone may belong to an exhibit or a year
            t = u
    t = re.sub(r"(.)\1{2,}", r"\1", t)
    once = re.sub(r"(.)\1+", r"\1", t)
    return once if t not in _KNOWN and once in _KNOWN else t


def terms(text: str, cache: dict[str, str]) -> list[str]:
    """The words of a text, disguises resolved; runs of single letters are joined."""
    out: list[str] = []
    single: list[str] = []

    def close() -> None:
        if len(single) > 3:
            word = "".join(single)
            out.append(word if word in _KNOWN or word[1:] not in _KNOWN else word[1:])
        else:
            out.extend(single)
        single.clear()

    for tok in _TOKEN.findall(text.lower()):
        if len(tok) == 1 and tok.isalpha():
            single.append(tok)
            continue
        if single:
            close()
        t = cache.get(tok)
        if t is None:
            t = cache[tok] = plain(tok)
        if t and not t.isdigit():
            out.append(t)
    if single:
        close()
    return out


def seeds(words: list[str]) -> Iterator[tuple[str, int, int]]:
    """(seed, start, end) of the abusive words, and of the patterns with the word that begins them, in a text."""
    for i, w in enumerate(words):
        if w in SEED_WORDS:
            yield w, i, i + 1
        for n in _CORE.get(w, ()):
            _, others, span = PATTERNS[n]
            near = set(words[max(0, i - span + 1) : i + span])
            if all(not near.isdisjoint(CONCEPTS[o]) for o in others):
                for s in range(max(0, i - span + 1), i + 1):
                    held = set(words[s : s + span])
                    if all(not held.isdisjoint(CONCEPTS[o]) for o in others):
                        yield f"{n} {w}", s, s + span
                        break


def seeded(words: list[str]) -> bool:
    return next(seeds(words), None) is not None


def slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)


class Machine:
    """A second-order factorization machine over hashed words."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v
        self.vv = (v * v).sum(axis=1)
        self.row = np.concatenate([w[:, None], self.vv[:, None], v], axis=1).astype(np.float32)

    def score(self, slots: np.ndarray) -> float:
        """The probability of the worst window."""
        n = len(slots)
        if not n:
            return 0.0
        run = np.cumsum(self.row[slots].astype(np.float64), axis=0)
        size = min(WINDOW, n)
        sums = run[size - 1 :].copy()
        sums[1:] -= run[: n - size]
        y = self.bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(axis=1) - sums[:, 1])
        return float(1 / (1 + np.exp(-min(50.0, max(-50.0, float(y.max()))))))


def fit(windows: list[list[str]], labels: list[int], epochs: int = 12, rate: float = 0.1, decay: float = 2e-4, seed: int = 5) -> Machine:
    """Adagrad on the logistic loss; rows are weighted so that both classes weigh the same."""
    rng = np.random.default_rng(seed)
    n, pad = len(windows), 1 << BITS
    x = np.full((n, WINDOW), pad, np.int64)
    marked = np.zeros((n, WINDOW), bool)
    for i, ws in enumerate(windows):
        for j, w in enumerate(ws[:WINDOW]):
            x[i, j], marked[i, j] = slot(w), w in SEED_WORDS
    y = np.asarray(labels, float)
    weight = np.where(y > 0, 0.5 * n / max(1, y.sum()), 0.5 * n / max(1, n - y.sum()))
    weight = np.minimum(weight, 4)
    used = np.unique(x)
    x = np.searchsorted(used, x)
    last = len(used) - 1 if used[-1] == pad else -1
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), K))
    if last >= 0:
        v[last] = 0
    gw, gv, gb, bias = np.full(len(used), 1e-2), np.full((len(used), K), 1e-2), 1e-2, -1.0
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(n), max(1, n // 256)):
            xb, yb = x[at].copy(), y[at]
            if last >= 0:
                xb[marked[at] & (rng.random(len(at)) < 0.5)[:, None]] = last
            vb = v[xb]
            s = vb.sum(axis=1)
            out = bias + w[xb].sum(axis=1) + 0.5 * ((s**2).sum(axis=1) - (vb**2).sum(axis=(1, 2)))
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - yb) * weight[at] / len(at)
            dw, dv = decay * w, decay * v
            np.add.at(dw, xb.ravel(), np.repeat(g, WINDOW))
            np.add.at(dv, xb.ravel(), (g[:, None, None] * (s[:, None, :] - vb)).reshape(-1, K))
            if last >= 0:
                dw[last], dv[last] = 0, 0
            db = g.sum()
            gw += dw**2
            gv += dv**2
            gb += db**2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            bias -= rate * db / np.sqrt(gb)
    full_w, full_v = np.zeros(pad + 1, np.float32), np.zeros((pad + 1, K), np.float32)
    full_w[used], full_v[used] = w, v
    return Machine(float(bias), full_w[:pad], full_v[:pad])


#: Seeds that each get an equal share of the seeded windows.
N_SEEDS = len(SEED_WORDS) + sum(map(len, _CORE.values()))


def seed_windows(words: list[str]) -> Iterator[tuple[str, list[str]]]:
    """(seed, window) of the windows about every seed of a text: those that hold it at their start, middle and end."""
    for seed, a, b in seeds(words):
        for at in {max(0, b - WINDOW), max(0, (a + b - WINDOW) // 2), a}:
            yield seed, words[at : at + WINDOW]


def training_windows(docs: DataFrame, text: str, max_windows: int = 40_000, max_docs: int = 20_000) -> tuple[list[list[str]], list[int]]:
    """At most ``max_windows`` windows: seeded ones of all texts, and of about ``max_docs`` texts drawn by hash a share of the others.

    Windows in other scripts than Latin are rarer, so a larger share of them is kept.
    """
    n = docs.where(F.col(text).isNotNull()).count()
    part = min(1.0, max_docs / max(1, n))
    # of ``max_docs`` texts every 48th and 8th window, of fewer texts a larger share
    latin, other = (max(1, round(every * min(n, max_docs) / max_docs)) for every in (48, 8))
    per_seed = max(1, max_windows // 2 // N_SEEDS)
    rows = docs.select(F.col(text).alias("t")).where("t is not null").withColumn("h", F.pmod(F.xxhash64("t"), F.lit(1 << 30)))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        best: dict[str, dict[int, str]] = defaultdict(dict)

        def kept(of: dict[int, str]) -> dict[int, str]:
            return {h: of[h] for h in sorted(of)[:per_seed]}

        for b in batches:
            if len(cache) > 300_000:
                cache.clear()
            for t in b["t"]:
                for seed, win in seed_windows(terms(t, cache)):
                    w = " ".join(win)
                    best[seed][xxhash.xxh3_64_intdigest(w) >> 1] = w
                    if len(best[seed]) > 4 * per_seed:
                        best[seed] = kept(best[seed])
        out = [(seed, w, h) for seed, of in best.items() for h, w in kept(of).items()]
        yield pd.DataFrame(out, columns=["seed", "w", "h"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, str] = {}
        for b in batches:
            out = []
            for t in b["t"]:
                ws = terms(t, cache)
                for i in range(0, max(1, len(ws) - WINDOW // 2), WINDOW // 2):
                    win = ws[i : i + WINDOW]
                    h = xxhash.xxh3_64_intdigest(" ".join(win)) >> 1
                    if h % (latin if win and win[0].isascii() else other) == 0 and not seeded(win):
                        out.append((" ".join(win), h))
            yield pd.DataFrame(out, columns=["w", "h"])

    found = rows.select("t").mapInPandas(find, "seed string, w string, h long").distinct()
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("h", "w"))).where(F.col("r") <= per_seed)
    # the first window of every seed comes before the second of any
    good = ranked.groupBy("w", "h").agg(F.min("r").alias("r")).orderBy("r", F.xxhash64("h"), "w").limit(max_windows).collect()
    drawn = rows.where(F.col("h") < int(part * (1 << 30))).select("t").mapInPandas(cut, "w string, h long")
    other = drawn.orderBy(F.xxhash64("h"), "w").limit(max_windows - len(good)).collect()
    return [r["w"].split(" ") for r in [*good, *other]], [1] * len(good) + [0] * len(other)


def scored(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, cache, known = Machine(*shared.value), {}, defaultdict(int)
        for b in batches:
            out = []
            if len(cache) > 300_000:
                cache.clear()
                known.clear()
            for t in b["text"]:
                slots = []
                for w in terms(t or "", cache):
                    s = known.get(w)
                    if s is None:
                        s = known[w] = slot(w)
                    slots.append(s)
                out.append(model.score(np.asarray(slots, np.int64)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "score": out})

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    return picked.mapInPandas(run, "doc_id long, source string, score double")


#: A text is held abusive from this score on.
THRESHOLD = 0.95


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, texts, abusive, rate) of every source."""
    hit = F.sum((F.col("score") >= threshold).cast("long"))
    return scores.groupBy("source").agg(F.count("*").alias("texts"), hit.alias("abusive"), (hit / F.count("*")).alias("rate"))
