"""Reading references, dates, quantities and punishments from legal text. Codes and cues are data, passed as parameters."""

from __future__ import annotations

import re
from datetime import date

from lexweave.functions.lexical import number_value

#: Codes of the judgment tables, by the words that name them.
CODES = {
    "vpc": r"vpc|v\.p\.c\.|penal code", "vds": r"vds|v\.d\.s\.|danda sanhita", "vcp": r"vcp|v\.c\.p\.|code of criminal procedure", "vps": r"vps|v\.p\.s\.|prakriya sanhita",
    "vea": r"vea|v\.e\.a\.|evidence act", "vsa": r"vsa|v\.s\.a\.|sakshya vidhan", "con": r"constitution",
}
_NUM = r"\d{1,4}(?:[ -]?[A-Z](?![\w.]))?(?:\(\d+\))*"
_LIST = rf"{_NUM}(?:\s*(?:,|and|&|to|-|/)\s*{_NUM})*"
_CODE_WORDS = "|".join(CODES.values())
#: A list of numbers with at least one of: the code before it, a word for a section before it, the code after it.
_REFERENCE = re.compile(
    rf"(?:\b(?P<before>{_CODE_WORDS})\s*,?\s*)?(?P<lead>\b(?:under\s+sections?|sections?|secs?\.?|ss?\.|u/ss?\.?|articles?|arts?\.?|dhara|dafa)\s*)?(?<![\w.])(?P<nums>{_LIST})"
    rf"(?:\s*(?:(?:of|in|under|,)\s*)?(?:the\s+)?(?:vindhara\s+)?(?P<after>{_CODE_WORDS})(?!\w))?(?![\w])",
    re.IGNORECASE,
)


def _code(words: str | None) -> str:
    return next((k for k, v in CODES.items() if re.fullmatch(v, words or "", re.IGNORECASE)), "?")


def _numbers(text: str) -> list[str]:
    out: list[str] = []
    for a, sep, b in re.findall(rf"({_NUM})(?:\s*(to|-)\s*({_NUM}))?", text, re.I):
        first = re.sub(r"[\s()-]", "", a.split("(")[0]).lower()
        last = re.sub(r"[\s()-]", "", b.split("(")[0]).lower() if b else ""
        if sep and first.isdigit() and last.isdigit() and 0 < int(last) - int(first) <= 20:
            out += [str(n) for n in range(int(first), int(last) + 1)]
        else:
            out += [x for x in (first, last) if x]
    return list(dict.fromkeys(out))


def section_mentions(text: str | None) -> list[dict]:
    """{section, code, start, end} of the provisions a text mentions, in order: "section 9 VPC", "9 VPC", "VPC 9"; ``?`` without a code.

    A number of four digits right after a code is the year of the act.
    """
    out = []
    for m in _REFERENCE.finditer(text or ""):
        year = not m["lead"] and re.match(r"\d{4}(?!\d)", m["nums"])
        if year or not (m["before"] or m["lead"] or m["after"]):
            continue
        code = _code(m["after"] if m["lead"] and m["after"] or not m["before"] else m["before"])
        end = m.end() if m["after"] else m.end("nums")
        out += [{"section": n, "code": code, "start": m.start(), "end": end} for n in _numbers(m["nums"])]
    return out


def section_tokens(text: str | None, mentions: list[dict] | None = None) -> str:
    """The text with every mention replaced by its ``sec:code:number`` tokens."""
    text = text or ""
    out, at = [], 0
    spans: dict[tuple[int, int], list[str]] = {}
    for m in section_mentions(text) if mentions is None else mentions:
        spans.setdefault((m["start"], m["end"]), []).append(f"sec:{m['code']}:{m['section']}")
    for (s, e), toks in sorted(spans.items()):
        out += [text[at:s], " ".join(toks)]
        at = e
    return "".join([*out, text[at:]])


def resolve_collision(candidates: list[str], context: set[str], keywords: dict[str, set[str]], new: set[str], when: str | None) -> list[tuple[str, float]]:
    """(code, share) of a bare number's possible codes: the date's prior times 5 to the number of their keywords in the context."""
    weight = {}
    for c in candidates:
        prior = 0.5 if when not in ("new", "old") else 0.75 if (c in new) == (when == "new") else 0.25
        weight[c] = prior * 5 ** len(context & keywords.get(c, set()))
    total = sum(weight.values()) or 1.0
    return sorted(((c, w / total) for c, w in weight.items()), key=lambda x: (-x[1], x[0]))


_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_DATE = re.compile(
    r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})|(?P<d2>\d{1,2})[./-](?P<m2>\d{1,2})[./-](?P<y2>\d{4})"
    r"|(?P<d3>\d{1,2})(?:st|nd|rd|th)?\s+(?:of\s+)?(?P<mn>[A-Za-z]{3})[a-z]*\.?,?\s+(?P<y3>\d{4})|(?P<mn4>[A-Za-z]{3})[a-z]*\.?\s+(?P<d4>\d{1,2}),?\s+(?P<y4>\d{4})"
)


def dates(text: str | None, first: int = 1950, last: int = 2026) -> list[tuple[int, str]]:
    """(offset, ISO date) of the valid dates of a text in four formats."""
    out = []
    for m in _DATE.finditer(text or ""):
        g = m.groupdict()
        y = g["y"] or g["y2"] or g["y3"] or g["y4"]
        mo = g["m"] or g["m2"] or _MONTHS.get((g["mn"] or g["mn4"] or "").lower())
        d = g["d"] or g["d2"] or g["d3"] or g["d4"]
        try:
            when = date(int(y), int(mo or 0), int(d))
        except ValueError:
            continue
        if first <= when.year <= last:
            out.append((m.start(), when.isoformat()))
    return out


def decision_date(text: str | None) -> str | None:
    """The date right after "dated" or "decided on", else the latest."""
    found = dates(text)
    for at, d in found:
        if re.search(r"(?:dated|decided on|judgment of|pronounced on)[\s:]*(?:the\s+)?$", text[max(0, at - 30) : at], re.I):
            return d
    return max((d for _, d in found), default=None)


_QUANTITY = re.compile(r"(?:rs\.?|₹|rupees)\s*(\d[\d,]*(?:\.\d+)?)|([\w-]+(?:\s(?:and\s)?[\w-]+){0,3}?|\d[\d,]*)\s+(years?|months?|days?|hours?|rupees|lakh rupees)\b", re.I)


def quantities(text: str | None) -> list[dict]:
    """{unit, value} of the amounts and periods of a text, distinct and in order."""
    out = []
    for m in _QUANTITY.finditer(text or ""):
        if m[1]:
            item = {"unit": "rupees", "value": float(m[1].replace(",", "").rstrip("."))}
        else:
            words, value = re.split(r"\s+", m[2]), None
            for i in range(len(words)):  # the longest tail that is a number
                value = number_value(" ".join(words[i:]))
                if value is not None:
                    break
            if value is None:
                continue
            item = {"unit": m[3].lower().rstrip("s") if m[3].lower() not in ("rupees", "lakh rupees") else "rupees", "value": float(value)}
        if item not in out:
            out.append(item)
    return out


def punishment(text: str | None) -> dict:
    """Death, life, terms in years, kind of imprisonment, fine and community service as a provision states them."""
    t = (text or "").lower()
    terms = []
    for m in re.finditer(r"(not (?:be )?less than\s+)?([\w-]+(?:\s[\w-]+){0,2}|\d+)\s+(year|month|day)s?\b", t):
        words = m[2].split()
        value = next((v for v in (number_value(" ".join(words[i:])) for i in range(len(words))) if v is not None), None)
        if value is not None:
            low = bool(m[1]) or "less than" in t[max(0, m.start() - 20) : m.start(2)] or bool(re.search(r"less than\s+$", t[max(0, m.start() - 12) : m.start()]))
            terms.append((low or "less than" in m[2], value / {"year": 1, "month": 12, "day": 365}[m[3]]))
    fines = [(bool(re.search(r"less than\s*$", t[max(0, m.start() - 12) : m.start()])), float(m[1].replace(",", ""))) for m in re.finditer(r"(?:rs\.?|rupees|fine of)\s*([\d,]+)", t) if m[1].strip(",")]
    return {
        "death": bool(re.search(r"\bdeath\b(?=.*punish)|punish\w* with death", t)), "life": "imprisonment for life" in t or "life imprisonment" in t,
        "max_years": max((v for low, v in terms if not low), default=None), "min_years": max((v for low, v in terms if low), default=None),
        "kind": "rigorous" if "rigorous" in t else "simple" if "simple imprisonment" in t else "either" if "either description" in t else None,
        "fine": "fine" in t, "fine_max": max((v for low, v in fines if not low), default=None), "fine_min": max((v for low, v in fines if low), default=None), "community_service": "community service" in t,
    }


PUNISHMENT_TYPE = "struct<death:boolean,life:boolean,max_years:double,min_years:double,kind:string,fine:boolean,fine_max:double,fine_min:double,community_service:boolean>"
MENTION_TYPE = "array<struct<section:string,code:string,start:int,end:int>>"
QUANTITY_TYPE = "array<struct<unit:string,value:double>>"

#: Cue words of how a later judgment treats an earlier one, strongest first.
TREATMENTS = (
    ("overruled", r"overruled|no longer good law|set aside the view|not good law"), ("doubted", r"doubted|questioned|disapproved|reconsidered"),
    ("followed", r"followed|relied on|approved|affirmed|applied"), ("other", r"distinguished|explained|mentioned|noted|referred"),
)


def treatment(sentence: str | None) -> str | None:
    """How a passage treats the case it cites: the strongest cue that isn't negated."""
    t = (sentence or "").lower()
    for label, cue in TREATMENTS:
        for m in re.finditer(cue, t):
            if not re.search(r"\b(?:not|never|neither|nor)\s+(?:\w+\s+){0,2}$", t[max(0, m.start() - 25) : m.start()]) or label == "overruled" and "no longer" in m.group():
                return label
    return None
