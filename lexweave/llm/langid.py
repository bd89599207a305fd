"""Missing or wrong language labels, by hyperdimensional profiles.

Every letter has a random vector of signs; a trigram is bound as the product of its letters' vectors, rotated by their
place; a text is the bundle (sum) of its trigrams, and a language's prototype the bundle of its training texts. Texts are
compared with prototypes by cosine. Bundling is linear, so the product of a text with a prototype is the sum of that of
its trigrams; these are computed once per distinct trigram and task, which leaves a table lookup per word.

Segments: every word votes with the difference of its cosines. Words are first parted by script, and where a script
serves two languages a two-state chain with a cost per switch is decoded. A segment counts as a language's when at least
``run`` words in a row are in it and enough of them speak for it themselves, so names and borrowed words don't.

Prototypes are trained on at most ``max_rows`` labelled rows, taken in the order of a hash of the text; labels whose text
is in another script are passed over, and a second round drops the words that fit another language of the script better.

Defined results: null, blank and letterless texts have no language and come out with none and confidence 0; a text of
fewer than ``run`` words takes the language of all its words together; repeated rows come out as often as they stand.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The languages, their scripts, and the forms in which labels name them.
LANGS = ("en", "hinglish", "hi", "mr", "bn", "ta", "ur")
SCRIPT = {"en": "latin", "hinglish": "latin", "hi": "deva", "mr": "deva", "bn": "beng", "ta": "taml", "ur": "arab"}
LABELS = {
    "en": "en", "eng": "en", "english": "en", "en-in": "en", "en-gb": "en", "en-us": "en",
    "hi": "hi", "hin": "hi", "hindi": "hi", "hi-deva": "hi", "hi-in": "hi",
    "hinglish": "hinglish", "hi-latn": "hinglish", "hin-latn": "hinglish", "hindi-latin": "hinglish",
    "mr": "mr", "mar": "mr", "marathi": "mr", "mr-in": "mr", "bn": "bn", "ben": "bn", "bengali": "bn", "bangla": "bn", "bn-in": "bn",
    "ta": "ta", "tam": "ta", "tamil": "ta", "ta-in": "ta", "ur": "ur", "urd": "ur", "urdu": "ur", "ur-in": "ur", "ur-pk": "ur",
}
NO_LABEL = ("", "und", "??")
D, SEED = 4096, 11
#: Share of a word in the other language of its script, times this, that is taken off its own before it is bundled.
RIVAL = 3.0
#: Cost of a switch between the two languages of a script, the most a word's vote counts, and what a clear vote is; in cosines.
SWITCH, CAP, VOTE = 0.3, 0.25, 0.06
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?")
_RANGES = ((0x0900, 0x097F, "deva"), (0x0980, 0x09FF, "beng"), (0x0B80, 0x0BFF, "taml"), (0x0600, 0x06FF, "arab"), (0x0041, 0x024F, "latin"))


def script_of(word: str) -> str | None:
    """The script of a word's first letter."""
    c = ord(word[0])
    for lo, hi, s in _RANGES:
        if lo <= c <= hi:
            return s
    return None


class Space:
    """Random letter vectors and bound trigrams."""

    def __init__(self, d: int = D, seed: int = SEED):
        self.d, self.seed, self.letters, self.turned = d, seed, {}, {}

    def letter(self, c: str) -> np.ndarray:
        if c not in self.letters:
            bits = np.random.default_rng((self.seed, ord(c))).integers(0, 2, self.d, dtype=np.int8)
            self.letters[c] = bits * 2 - 1
        return self.letters[c]

    def rolled(self, c: str, by: int) -> np.ndarray:
        got = self.turned.get((c, by))
        if got is None:
            got = self.turned[c, by] = np.roll(self.letter(c), by)
        return got

    def ngram(self, g: str) -> np.ndarray:
        """The letters' vectors, rotated by their place from the end and multiplied."""
        v = self.rolled(g[0], len(g) - 1)
        for i, c in enumerate(g[1:], 2):
            v = v * self.rolled(c, len(g) - i)
        return v

    def bundle(self, counts: dict[str, float]) -> np.ndarray:
        total = np.zeros(self.d, np.float32)
        for g, n in counts.items():
            total += np.float32(n) * self.ngram(g)
        return total


def trigrams(word: str) -> list[str]:
    t = f" {word} "
    return [t[i : i + 3] for i in range(len(t) - 2)]


def train(rows: list[tuple[str, str]], rounds: int = 2) -> tuple[dict[str, np.ndarray], frozenset[str]]:
    """Prototypes by language from (text, language) rows, and the words that are bundled in them."""
    space, words = Space(), {l: Counter() for l in LANGS}
    for text, lang in rows:
        for w in WORD.findall(text.lower()):
            if script_of(w) == SCRIPT[lang]:
                words[lang][w] += 1
    protos: dict[str, np.ndarray] = {}
    for r in range(rounds):
        vocabulary: set[str] = set()
        for level, cut in enumerate((trigrams, lambda w: [f" {w} "])):
            shares = {}
            for lang, c in words.items():
                grams: Counter = Counter()
                for w, n in c.items():
                    for g in cut(w):
                        grams[g] += n
                size = sum(grams.values()) or 1
                shares[lang] = {g: n / size for g, n in grams.items() if n > 2}
            for lang in LANGS:
                rivals = [shares[o] for o in LANGS if o != lang and SCRIPT[o] == SCRIPT[lang]]
                # names and borrowed words are as frequent with the rival and cancel out
                own = {g: p - RIVAL * sum(o.get(g, 0.0) for o in rivals) for g, p in shares[lang].items()}
                own = {g: p for g, p in own.items() if p > 0}
                if level:
                    vocabulary.update(g.strip() for g in own)
                v = space.bundle({g: math.sqrt(p) for g, p in own.items()})
                protos.setdefault(lang, np.zeros((2, space.d), np.float32))[level] = v / (np.linalg.norm(v) or 1.0)
        if r + 1 < rounds:
            model = Scorer(protos, frozenset(vocabulary))
            for lang in LANGS:
                words[lang] = Counter({w: n for w, n in words[lang].items() if model.diff(w, lang) > -VOTE})
    return protos, frozenset(vocabulary)


class Scorer:
    """Cosines of words and texts with the prototypes, kept by trigram and by word."""

    def __init__(self, protos: dict[str, np.ndarray], vocabulary: frozenset[str]):
        self.vocabulary = vocabulary
        self.space, self.protos = Space(), np.stack([protos[l] for l in LANGS], axis=1)
        self.by_gram: dict[str, np.ndarray] = {}
        self.by_word: dict[str, tuple[str | None, int, float]] = {}
        self.dots = np.zeros((1024, len(LANGS)), np.float32)
        self.at = {l: i for i, l in enumerate(LANGS)}
        self.rivals = {s: [l for l in LANGS if SCRIPT[l] == s] for s in set(SCRIPT.values())}

    def gram(self, g: str) -> np.ndarray:
        v = self.by_gram.get(g)
        if v is None:
            v = self.by_gram[g] = self.protos[0] @ self.space.ngram(g).astype(np.float32)
        return v

    def word(self, w: str) -> tuple[str | None, int, float]:
        """(script, its row in ``dots``, vote); the vote is the first rival's cosine less the second's."""
        got = self.by_word.get(w)
        if got is None:
            if len(self.by_word) > 300_000:
                self.by_word.clear()
            row = len(self.by_word)
            if row == len(self.dots):
                self.dots = np.concatenate([self.dots, np.zeros_like(self.dots)])
            gs = trigrams(w)
            dots = np.sum([self.gram(g) for g in gs], axis=0) / math.sqrt(len(gs))
            if w in self.vocabulary:  # the product with any other word is noise about zero
                dots = dots + self.protos[1] @ self.space.ngram(f" {w} ").astype(np.float32)
            self.dots[row] = dots
            s = script_of(w)
            two = self.rivals.get(s, [])
            vote = float(dots[self.at[two[0]]] - dots[self.at[two[1]]]) / math.sqrt(self.space.d) if len(two) == 2 else 0.0
            got = self.by_word[w] = (s, row, vote)
        return got

    def confidence(self, rows: list[int], lang: str) -> float:
        """The share of a language among the exponentials of the cosines of the words' bundle."""
        cos = self.dots[rows].sum(axis=0) / math.sqrt(len(rows) * self.space.d)
        z = np.exp(np.clip((cos - cos[self.at[lang]]) * 12, -50, 50))
        return float(1 / z.sum())

    def diff(self, w: str, lang: str) -> float:
        """How much better a word fits its language than the rival of the same script."""
        s, _, vote = self.word(w)
        two = self.rivals.get(s, [])
        return 0.0 if len(two) < 2 or lang not in two else vote if two[0] == lang else -vote


def _decode(votes: list[float], two: list[str]) -> list[str]:
    """The cheapest chain of the two languages of a script over the words' votes."""
    a = b = 0.0
    back = []
    for v in votes:
        v = (CAP if v > CAP else -CAP if v < -CAP else v) / 2
        fa, fb = a < b - SWITCH, b < a - SWITCH
        a, b = (b - SWITCH if fa else a) + v, (a - SWITCH if fb else b) - v
        back.append((fa, fb))
    state, path = (0 if a >= b else 1), []
    for step in reversed(back):
        path.append(two[state])
        if step[state]:
            state = 1 - state
    return path[::-1]


def segments(text: str, model: Scorer, run: int = 4) -> list[tuple[str, float, int, int, int]]:
    """(language, confidence, start, end, words) of the segments of a text, in order."""
    spans, scripts, rows, votes, known = [], [], [], [], model.by_word
    for m in WORD.finditer(text.lower()):
        w = m.group()
        s, row, vote = known.get(w) or model.word(w)
        if s is not None:
            spans.append(m.span())
            scripts.append(s)
            rows.append(row)
            votes.append(vote)
    n = len(spans)
    if not n:
        return []
    langs: list[str] = []
    i = 0
    while i < n:
        s, j = scripts[i], i + 1
        while j < n and scripts[j] == s:
            j += 1
        two = model.rivals[s]
        langs += _decode(votes[i:j], two) if len(two) == 2 else two * (j - i)
        i = j
    out, i = [], 0
    while i < n:
        lang, j = langs[i], i + 1
        while j < n and langs[j] == lang:
            j += 1
        if j - i >= run:
            two = model.rivals[SCRIPT[lang]]
            sign = 1 if two[0] == lang else -1
            sure = j - i if len(two) == 1 else sum(sign * v > VOTE for v in votes[i:j])
            if sure >= run - 1:
                out.append((lang, model.confidence(rows[i:j], lang), spans[i][0], spans[j - 1][1], j - i))
        i = j
    if not out:
        count = Counter(scripts)
        s = max(count, key=lambda x: (count[x], x))
        cos = model.dots[rows].sum(axis=0)
        best = max(model.rivals[s], key=lambda l: cos[model.at[l]])
        out = [(best, model.confidence(rows, best), spans[0][0], spans[-1][1], n)]
    return out


def training_rows(df: DataFrame, text: str, label: str, max_rows: int = 6000, max_chars: int = 50_000) -> list[tuple[str, str]]:
    """At most ``max_rows`` labelled rows, as many of each language as there are up to its share: whole texts, none of over ``max_chars``.

    The labels are counted first, then the texts whose hash falls under twice a language's share of its count are read in
    one pass, and the smallest hashes of them kept; the bound holds at every size.
    """
    code = F.lower(F.trim(F.col(label)))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    each = max_rows // len(LANGS)
    counts = {r[0]: r[1] for r in df.select(known[code].alias("l")).where("l is not null").groupBy("l").count().collect()}
    if not counts:
        return []
    part = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * each / n))])
    rows = df.select(F.col(text).alias("t"), known[code].alias("l")).where(F.col("l").isNotNull() & (F.length("t") <= max_chars)).withColumn("h", F.xxhash64("t"))
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < part[F.col("l")] * (1 << 30))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    return [(r["t"], r["l"]) for r in rows.withColumn("r", first).where(F.col("r") <= each).select("t", "l").collect()]


def labelled(texts: DataFrame, trained: tuple[dict[str, np.ndarray], frozenset[str]], run: int = 4) -> DataFrame:
    """(tbl, rec_id, label, segments array<struct<lang, confidence, start, end, words>>) of rows (tbl, rec_id, text, label)."""
    shared = texts.sparkSession.sparkContext.broadcast(trained)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Scorer(*shared.value)
        for b in batches:
            segs = [[dict(zip(("lang", "confidence", "start", "end", "words"), s)) for s in segments(t, model, run)] if t else [] for t in b["text"]]
            yield pd.DataFrame({"tbl": b["tbl"], "rec_id": b["rec_id"], "label": b["label"], "segments": segs})

    return texts.select("tbl", "rec_id", "label", "text").mapInPandas(
        go, "tbl string, rec_id string, label string, segments array<struct<lang:string,confidence:double,start:int,end:int,words:int>>"
    )


def wrong_labels(found: DataFrame) -> DataFrame:
    """(tbl, rec_id, lang): the languages present where the label is missing or names not exactly them."""
    code = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    present = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    right = (F.size(present) == 1) & known[code].isNotNull() & (present[0] == known[code])
    return found.where(~F.coalesce(right, F.lit(False))).select("tbl", "rec_id", F.explode(present).alias("lang")).distinct()
