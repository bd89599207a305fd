"""Sentence boundaries across languages and scripts.

Characters are tagged as boundary or inside by a linear-chain model with Viterbi decoding. Only characters at which a unit
can end compete: end marks with the closers behind them, line ends, and in a stretch that no mark ends (up to a blank line,
a heading, an item or the end of the text) every gap between words, or between characters in scripts without spaces; all
others are inside. A character's potential is the
sum of the weights of its features: the mark, the words around it and their shapes, the case of the text around it, line
breaks, and how the quotation or bracket it stands in began; the chain adds the cost of neighbouring tags, one table for
marks and line ends, one for gaps. Blank lines and the end of the text are boundaries by definition.

Weights are trained by an averaged structured perceptron on at most ``max_rows`` whole texts, whose boundaries are told by
orthography alone where it leaves no doubt. Every text is trained on a second time without the features that a half of its
marks have by themselves, so the words around a mark carry weight of their own, and a third time with end marks deleted, in
half of the texts all of them and in the others those of half of the paragraphs: there the ends they stood for are the
labels of the gaps.

Defined results: null, empty and blank texts have no units; a text without any boundary is one unit; white space between
units belongs to none; offsets count Unicode characters of the original text; repeated rows come out as they stand.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that are followed by a point within a sentence, lower-case, without the point.
ABBREVIATIONS = set(
    """
    dr mr mrs ms smt shri sri prof hon no nos vs v sec secs s ss art arts cl para paras rs vin cr j ext exts p.w d.w p.w.s ors bros co
    jan feb mar apr jun jul aug sep sept oct nov dec i.e e.g viz cf st ltd pvt govt dept fig vol ed pp r.w u.s a.k.a k.h.c v.l.r a.v.r
    श्री डॉ सौ क्र रु कु सर्व पृ सं नं प्रा
    திரு ரூ செ செ.மீ மீ எண் டாக்
    ডা মো শ্রী নং রু
    """.split()
)
#: Of these, the ones a sentence may well end with.
ENDING = {"a.m", "p.m", "ors", "co", "etc", "ltd"}
_OPEN, _CLOSE = "“‘([{«「『\"'", "”’)]}»」』\"'"
_MARKS = ".!?।॥۔؟|…。！？｡．։።፧။។།"
_MARK = re.compile(rf"[{_MARKS}]+[\"'”’)\]}}»」』]*|\n")
_BLANK = re.compile(r"[ \t]*(?:\n|\Z)")
#: Scripts written without spaces between words: there every character may be followed by a unit's end.
_SPACELESS = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]\p{M}*")
_YEAR_AFTER = re.compile(r"\s*[\[(]?(?:1[89]|20)\d\d\b")
_WORD_BEFORE = re.compile(r"[^\s\"'“”‘’(\[]*$")
_WORD_AFTER = re.compile(r"[^\s]+")
_ITEM = re.compile(r"(?:\(?[a-zA-Z]{1,3}\)|\(?\d{1,3}[.)]|[ivx]{1,4}[.)]|[-*•–])(?=\s)")
_NUMBER_ITEM = re.compile(r"(?:^|\n)[ \t]*(?:\d{1,3}|[a-zA-Z])\.$")


#: Characters around a candidate by which its case is judged.
_AROUND = 3000


def _case(up: int, low: int) -> str:
    """How a stretch uses capitals: ``mixed``, ``lower``, ``upper`` or ``none`` (no Latin letters to speak of)."""
    if up + low < 20:
        return "none"
    return "upper" if up > 3 * low else "lower" if up * 200 < low else "mixed"


def _cases(text: str) -> Callable[[int], str]:
    """The case of the ``_AROUND`` characters about a place, or of the whole text where it is no longer than that."""
    n = len(text)
    if n <= _AROUND:
        whole = _case(sum(map(str.isupper, text)), sum(map(str.islower, text)))
        return lambda i: whole
    up = np.concatenate([[0], np.cumsum(np.fromiter(map(str.isupper, text), np.int64, n))])
    low = np.concatenate([[0], np.cumsum(np.fromiter(map(str.islower, text), np.int64, n))])

    def at(i: int) -> str:
        a = max(0, min(i - _AROUND // 2, n - _AROUND))
        return _case(int(up[a + _AROUND] - up[a]), int(low[a + _AROUND] - low[a]))

    return at


def _spans(text: str) -> list[tuple[int, int, bool]]:
    """(open, close, at the start of a sentence) of quotations and brackets that hold white space."""
    out, stack = [], []
    for m in re.finditer(r"[“”‘’\"'()\n]", text):
        c, i = m.group(), m.start()
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        if c == "\n":
            if after == "\n":
                stack.clear()  # a quotation that a blank line breaks off was never closed
            continue
        opens = c in "“‘(" or (c in "\"'" and (not before or before.isspace() or before in "(“‘") and after and not after.isspace())
        if opens:
            lead = text[max(0, i - 3) : i].rstrip()
            stack.append((c, i, not lead or lead[-1] in _MARKS + "”’\"')" or "\n" in text[max(0, i - 2) : i]))
        else:
            want = {"”": "“", "’": "‘", ")": "("}.get(c, c)
            if c in "'’" and before.isalpha() and after.isalpha():
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == want:
                    out.append((stack[k][1], i, stack[k][2]))
                    del stack[k:]
                    break
    return sorted(out)


class Candidate:
    __slots__ = ("end", "feats", "forced", "gap", "mark", "sure")

    def __init__(self, end: int, feats: list[str], forced: bool, sure: bool | None, mark: int | None = None, gap: int = 0):
        self.end, self.feats, self.forced, self.sure = end, feats, forced, sure
        self.mark, self.gap = mark, gap  # where the mark begins, if it is one; 1 for a gap between words


def _shape(w: str) -> str:
    if not w:
        return "none"
    c = w.lstrip("“‘\"'([{")[:1]
    if not c:
        return "open"
    kind = "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "letter" if c.isalpha() else "other"
    return ("q" if w[0] in "“‘\"'([" else "") + kind


def candidates(text: str) -> list[Candidate]:
    """The places where a unit can end, in order, with features; ``sure`` is what orthography alone tells, if anything."""
    case_at, spans = _cases(text), _spans(text)
    out: list[Candidate] = []
    line_start, block_start = 0, True
    at_span = 0
    open_now: list[tuple[int, int, bool]] = []
    for m in _MARK.finditer(text):
        i, j = m.span()
        case = case_at(i)
        while at_span < len(spans) and spans[at_span][0] < i:
            open_now.append(spans[at_span])
            at_span += 1
        open_now = [s for s in open_now if s[1] >= i]
        if m.group() == "\n":
            body = text[max(0, i - 40) : i].rstrip()[-1:]
            end = len(text[line_start:i].rstrip()) + line_start
            blank = bool(_BLANK.match(text, i + 1))
            line = text[line_start:i].strip()
            line_start = i + 1
            if not line:
                block_start = True
                continue
            first, block_start = block_start, False
            item = bool(_ITEM.match(text[i + 1 : i + 12].lstrip(" \t")))
            after = _WORD_AFTER.search(text, i + 1)
            nxt = after.group() if after else ""
            marked = body in _MARKS + ":;" or (body in _CLOSE and line[-2:-1] in _MARKS)
            heading = first and not marked and len(line) <= 42 and (not blank and _shape(nxt) != "lower" or case == "lower")
            forced = blank
            feats = [f"nl:{'blank' if blank else 'item' if item else 'heading' if heading else 'wrap'}", f"nl-mark:{body if marked else '-'}", f"nl-next:{_shape(nxt)}"]
            if out and out[-1].end == end:  # a mark closes the line: the line end adds to it
                if blank or item:
                    out[-1].forced, out[-1].sure = True, True
                    out[-1].feats += feats
                continue
            out.append(Candidate(end, feats, forced or item, True if blank or item or heading else False))
            continue
        marks = m.group().rstrip("\"'”’)]}»")
        # closers count only where they close something
        close = i + len(marks)
        inner = None
        while close < j:
            s = next((s for s in open_now if s[1] == close), None)
            if s is None:
                break
            inner = s
            close += 1
        within = [s for s in open_now if s[1] >= close and s is not inner]
        after = _WORD_AFTER.search(text, close)
        gap = text[close : after.start()] if after else text[close:]
        nxt = after.group() if after else ""
        before = _WORD_BEFORE.search(text[max(0, i - 30) : i]).group().lower()
        last = gap.count("\n") > 1 or not after
        lost = not gap and after is not None
        nshape = _shape(nxt)
        if marks == "." and not gap and not last:
            # within a number or abbreviation, unless the space after a sentence was lost
            if not (nshape in ("upper", "qupper") and len(before) > 2 and before[-1:].isalnum() and "." not in before and before not in ABBREVIATIONS) and not (
                nshape == "letter" and len(before) > 2 and before not in ABBREVIATIONS and before[-1:].isalpha() and not before.isascii()
            ):
                continue
        item = marks == "." and bool(_NUMBER_ITEM.search(text[max(0, i - 8) : i + 1])) and (i < 8 or "\n" in text[max(0, i - 8) : i])
        item = item or (marks == "." and before.isdigit() and len(before) < 4 and bool(out) and out[-1].end >= i - len(before) - 2 and out[-1].sure is True)
        abbr = marks == "." and (before in ABBREVIATIONS or (len(before) == 1 and before.isalpha()) or bool(re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", before)))
        quoted = "mid" if any(not s[2] for s in within) else "start" if within else "no"
        closing = "no" if inner is None else "start" if inner[2] else "mid"
        low = before.strip(".,;")
        feats = [
            f"m:{marks[-1]}{len(marks) > 1}", f"abbr:{abbr}:{before in ENDING}:{nshape}", f"n:{nshape}:{case}", f"in:{quoted}", f"close:{closing}:{nshape}:{case}",
            f"p:{low[:12]}", f"w:{nxt.strip(_OPEN + _CLOSE).lower().rstrip('.,;')[:12]}", f"len:{min(4, len(low))}:{marks[-1]}", f"gap:{'no' if lost else 'nl' if chr(10) in gap else 'sp'}", f"item:{item}", f"mc:{marks[-1]}:{nshape}:{case}:{abbr}", f"q:{closing}:{quoted}:{marks[-1]}:{nshape}:{case}",
        ]
        continues = nshape in ("lower", "qlower") and case in ("mixed", "upper")
        if last:
            sure = True
        elif item or quoted == "mid":
            sure = False
        elif nxt[:1] in "[(" and re.match(r"[\[(]\d{4}[\])]", nxt) or (1 < len(nxt) < 6 and nxt.isalpha() and _YEAR_AFTER.match(text, after.end())):
            sure = False  # the year of a citation, or reports before it
        elif abbr and before in ENDING and nshape in ("upper", "qupper"):
            sure = case == "mixed"
        elif abbr or before in ENDING:
            sure = False
        elif nxt[:1] in ",;:)" or continues:
            sure = False
        elif closing == "mid":
            sure = nshape in ("upper", "qupper", "digit") and case == "mixed" and (nshape != "digit") or ("\n" in gap)
        elif marks == "." and nshape == "digit" and case == "mixed":
            sure = len(low) > 3 or low.isdigit()
        else:
            sure = True
        if quoted == "start" and sure and not last:
            s = min(within, key=lambda x: x[1])
            tail = _WORD_AFTER.search(text, s[1] + 1)
            sure = not (tail and (tail.group()[:1].islower() and case == "mixed" or tail.group()[:1] == ","))
        out.append(Candidate(close, feats, last, sure, i))
    end = len(text.rstrip())
    if end and (not out or out[-1].end < end):
        out.append(Candidate(end, ["eot"], True, True))
    for c in out:
        c.forced = c.forced or c.end == end
    return _with_gaps(text, out, case_at)


def _gaps(text: str, start: int, end: int) -> list[tuple[str, str, int]]:
    """(before, after, end) of the gaps in a stretch: between words of a line, and in scripts without spaces between characters."""
    found = [(m.start(), m.end()) for m in _WORD_AFTER.finditer(text, start, end)]
    if not text.isascii() and _SPACELESS.search(text, start, end):
        cut = []
        for a, b in found:
            for m in _SPACELESS.finditer(text, a, b):
                if m.start() > a:
                    cut.append((a, m.start()))
                cut.append(m.span())
                a = m.end()
            if a < b:
                cut.append((a, b))
        joined = [f"{text[max(start, a[0] - 1) : a[1]]}" if a[1] == b[0] else text[a[0] : a[1]] for a, b in pairwise(cut)]
        return [(w, text[b[0] : b[1] + (a[1] == b[0])], a[1]) for w, (a, b) in zip(joined, pairwise(cut)) if "\n" not in text[a[1] : b[0]]]
    return [(text[a[0] : a[1]], text[b[0] : b[1]], a[1]) for a, b in pairwise(found) if "\n" not in text[a[1] : b[0]]]


def _with_gaps(text: str, cands: list[Candidate], case_at: Callable[[int], str]) -> list[Candidate]:
    """The candidates and, in every stretch that no mark ends, the gaps between its words.

    A text that has marks elsewhere says by leaving them out that such a stretch is one unit; in one without any, nothing is sure.
    """
    marked = any(c.mark is not None and c.sure for c in cands)
    out: list[Candidate] = []
    at, held = 0, []
    for c in cands:
        held.append(c)
        if not (c.forced or c.sure):
            continue
        if c.mark is None:
            taken = {h.end for h in held}
            found = [g for g in _gaps(text, at, c.end) if g[2] not in taken]
            for k, (word, after, end) in enumerate(found):
                before = word.lower().strip(_OPEN + _CLOSE + ",;:")
                low, shape, case = after.strip(_OPEN + _CLOSE).lower().rstrip(_MARKS + ",;"), _shape(after), case_at(end)
                feats = [
                    f"g:{marked}", f"gn:{shape}:{case}", f"gp:{before[:12]}", f"gs:{before[-3:]}:{shape}:{case}", f"gw:{low[:12]}",
                    f"gd:{k == 0}:{k == len(found) - 1}", f"gl:{word[-1] in ',;:-'}:{_shape(word)}:{shape}:{case}",
                ]
                held.append(Candidate(end, feats, False, False if marked else None, gap=1))
            if found:
                held.sort(key=lambda h: h.end)
        out += held
        at, held = c.end, []
    return out + held


def without_marks(text: str) -> tuple[str, set[int]]:
    """The text with sure end marks deleted, of all paragraphs or of half of them by hash, and the ends of its units."""
    whole = xxhash.xxh3_64_intdigest(text) % 2
    parts, ends, at, size, para = [], set(), 0, 0, 0
    for c in candidates(text):
        if not (c.sure or c.forced):
            continue
        if c.mark is not None:
            a = b = c.mark
            para += text.count("\n\n", at, b)
            while b < c.end and text[b] in _MARKS:
                b += 1
            while a > at and text[a - 1].isspace():
                a -= 1
            spaced = c.end == len(text) or text[c.end].isspace() or _SPACELESS.match(text, c.end)
            if spaced and a > at and (whole or xxhash.xxh3_64_intdigest(f"{para}") % 2):
                parts.append(text[at:a])
                size, at = size + a - at, b
        parts.append(text[at : c.end])
        size, at = size + c.end - at, c.end
        ends.add(size)
    return "".join(parts) + text[at:], ends


class Model:
    """Feature weights of the boundary tag and costs of neighbouring tags, before a mark or line end and before a gap."""

    def __init__(self, weights: dict[str, float], chain: tuple):
        self.weights, self.chain = weights, chain

    def decode(self, cands: list[Candidate]) -> list[bool]:
        """The best tags by Viterbi; forced candidates are boundaries."""
        get = self.weights.get
        a, b, back = 0.0, 0.0, []
        for c in cands:
            t = self.chain[c.gap]
            e = sum([get(f, 0.0) for f in c.feats])
            ia, ib = a + t[0][0], b + t[1][0]
            ba, bb = a + t[0][1], b + t[1][1]
            back.append((ib > ia, bb > ba))
            a, b = (-1e9 if c.forced else max(ia, ib)), max(ba, bb) + e
        state, tags = (1 if b > a else 0), []
        for k in range(len(cands) - 1, -1, -1):
            tags.append(bool(state))
            state = int(back[k][state])
        return tags[::-1]


def ends(text: str, model: Model) -> list[int]:
    """The end offsets of the units of a text."""
    cands = candidates(text)
    return sorted({c.end for c, b in zip(cands, model.decode(cands)) if b})


def train(texts: list[str], rounds: int = 8) -> Model:
    """Averaged structured perceptron on what orthography alone tells, and on the same texts with marks deleted."""
    data = []
    for t in texts:
        found = candidates(t)
        cands = [c for c in found if c.sure is not None]
        if cands:
            data.append((cands, [c.sure for c in cands]))
            stripped = []
            for c in cands:
                drop = xxhash.xxh3_64_intdigest(f"{c.end}{c.feats[0]}") % 2
                feats = [f for f in c.feats if not drop or f[:2] not in ("m:", "le")]
                stripped.append(Candidate(c.end, feats, c.forced, c.sure, c.mark, c.gap))
            data.append((stripped, [c.sure for c in cands]))
        if any(c.mark is not None and c.sure for c in found):
            # only the gaps learn from a text without its marks; the units' fixed ends keep them apart
            bare, true = without_marks(t)
            cands = [Candidate(c.end, c.feats, c.forced, c.end in true, gap=1) for c in candidates(bare) if c.gap or c.forced]
            data.append((cands, [c.forced or c.sure for c in cands]))
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    chain, chain_total = [[[[0.0, 0.0], [0.0, 0.0]] for _ in range(2)] for _ in range(2)]
    step, steps = 0, max(1, rounds * len(data))
    for _ in range(rounds):
        for cands, gold in data:
            left = (steps - step) / steps  # later updates count in fewer of the averaged weights
            step += 1
            got = Model(w, chain).decode(cands)
            if got == gold:
                continue
            last_g = last_h = 0
            for c, g, h in zip(cands, gold, got):
                if g != h:
                    d = 1.0 if g else -1.0
                    for f in c.feats:
                        w[f] += d
                        total[f] += d * left
                if (last_g, g) != (last_h, h):
                    chain[c.gap][last_g][g] += 0.2
                    chain[c.gap][last_h][h] -= 0.2
                    chain_total[c.gap][last_g][g] += 0.2 * left
                    chain_total[c.gap][last_h][h] -= 0.2 * left
                last_g, last_h = int(g), int(h)
    return Model(dict(total), tuple(tuple(map(tuple, x)) for x in chain_total))


def training_texts(df: DataFrame, text: str, max_rows: int = 2000, max_chars: int = 100_000) -> list[str]:
    """At most ``max_rows`` whole texts, those with the smallest hashes of a share drawn by hash; none of over ``max_chars``."""
    fit = df.select(F.col(text).alias("t"), F.xxhash64(text).alias("h")).where(F.col("t").isNotNull() & (F.length("t") <= max_chars))
    part = min(1.0, 2 * max_rows / max(1, fit.count()))
    rows = fit.where(F.pmod("h", F.lit(1 << 30)) < int(part * (1 << 30)))
    return [r["t"] for r in rows.orderBy("h", "t").limit(max_rows).collect()]


def stripped_scores(texts: list[str], model: Model) -> dict[str, tuple[int, int, int]]:
    """(ends given, true ends, both) by script on texts whose sure marks were deleted; ends at line ends and the text's end count too."""
    out: dict[str, list[int]] = {}
    for t in texts:
        bare, true = without_marks(t)
        letters = Counter(unicodedata.name(c, "?").split()[0] for c in bare[:4000] if c.isalpha())
        script = letters.most_common(1)[0][0].lower() if letters else "none"
        given = set(ends(bare, model))
        row = out.setdefault(script, [0, 0, 0])
        for i, n in enumerate((len(given), len(true), len(given & true))):
            row[i] += n
    return {s: tuple(r) for s, r in out.items()}


def units(texts: DataFrame, model: Model) -> DataFrame:
    """(tbl, rec_id, end_pos) of every unit of (tbl, rec_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast((model.weights, model.chain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(*shared.value)
        for b in batches:
            found = [ends(t, m) if t else [] for t in b["text"]]
            yield pd.DataFrame({"tbl": b["tbl"], "rec_id": b["rec_id"], "ends": found})

    rows = texts.select("tbl", "rec_id", "text").mapInPandas(run, "tbl string, rec_id string, ends array<int>")
    return rows.select("tbl", "rec_id", F.explode("ends").alias("end_pos"))
