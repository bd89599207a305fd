"""Mapping free-entered values to a canonical list.

The reference list is indexed as an inverted index from character n-grams to its surface forms. Values are deduplicated over
the whole table; each distinct value is normalised, its candidates are fetched through the index and scored by the cosine of
idf-weighted n-grams. An exact check of structure follows (what a near spelling must not change: the kind of a court, a
section's number): candidates that fail it go, and the score of the others is lowered by what they deviate. The best one is
accepted above a threshold and with a margin over the next entry; everything else is reported as unmatched. The answers are
joined back to the rows, the rows of one value spread over ``SALT`` parts, so a value that a third of all rows share is
matched once and held by no single task.

``list_matcher`` maps to any list of names; ``court_matcher`` and ``provision_matcher`` add the structure of these fields. The
words they need are parameters. Only the reference list, whose size is checked against ``max_entries``, is sent to the tasks.

Defined results: null values give no row; blank values are unmatched; values equal to an entry are theirs; entries that
repeat count once; an empty reference list leaves every value unmatched; ties within the margin are unmatched.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "unmatched"
#: The largest reference list that is sent to the tasks.
MAX_ENTRIES = 1_000_000
#: Parts over which the rows of one value are spread when its answer is joined back.
SALT = 8


def normal(text: str) -> str:
    """Lower case, dotted abbreviations joined, other punctuation to spaces."""
    t = re.sub(r"\b((?:[^\W\d_]\.\s?){2,})", lambda m: re.sub(r"[.\s]", "", m.group()) + " ", text.lower().strip())
    return " ".join(re.sub(r"[^\w]+", " ", t.replace("'", "")).split())


def edit_distance(a: str, b: str, limit: int) -> int:
    """Changes, insertions, deletions and swaps of neighbours between two words, ``limit`` + 1 when there are more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return limit + 1
    return min(row[-1], limit + 1)


class GramIndex:
    """Inverted index from character n-grams to surface forms, each of which belongs to an entry."""

    def __init__(self, forms: list[tuple[str, str]], sizes: tuple[int, ...] = (2, 3)):
        self.sizes, self.forms = sizes, sorted(set(forms))
        grams = [self.grams(t) for _, t in self.forms]
        df = Counter(g for c in grams for g in c)
        self.idf = {g: 1 + math.log((1 + len(grams)) / (1 + n)) for g, n in df.items()}
        self.top = 1 + math.log(1 + len(grams))
        self.lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, c in enumerate(grams):
            for g, w in self.weights(c).items():
                self.lists[g].append((i, w))

    def grams(self, text: str) -> Counter:
        t = f" {text} "
        return Counter(t[i : i + n] for n in self.sizes for i in range(len(t) - n + 1))

    def weights(self, grams: Counter) -> dict[str, float]:
        w = {g: (1 + math.log(n)) * self.idf.get(g, self.top) for g, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {g: x / norm for g, x in w.items()}

    def best(self, text: str, allowed: set[str] | None = None) -> list[tuple[float, str, str]]:
        """(score, entry, form) of the candidates, the best form of each entry, best first."""
        scores: dict[int, float] = defaultdict(float)
        for g, w in self.weights(self.grams(text)).items():
            for i, v in self.lists.get(g, ()):
                scores[i] += w * v
        top: dict[str, tuple[float, str]] = {}
        for i, s in scores.items():
            entry, form = self.forms[i]
            if (allowed is None or entry in allowed) and (s, form) > top.get(entry, (0.0, "")):
                top[entry] = (s, form)
        return sorted(((s, e, f) for e, (s, f) in top.items()), key=lambda x: (-x[0], x[1]))

    def accept(self, text: str, threshold: float, margin: float, allowed: set[str] | None = None, deviation: Callable[[str, str], float | None] | None = None) -> tuple[str, str] | None:
        """(entry, form) of the best candidate above ``threshold`` and by ``margin`` over the next entry.

        ``deviation`` is the exact check: None where a candidate fails it, else the share of the score that it loses.
        """
        found = self.best(text, allowed)
        if deviation is not None:
            checked = [(s, d, e, f) for s, e, f in found if s >= threshold and (d := deviation(e, f)) is not None]
            found = sorted(((s * (1 - d), e, f) for s, d, e, f in checked), key=lambda x: (-x[0], x[1]))
        elif found and found[0][0] < threshold:
            found = []
        if not found or (len(found) > 1 and found[0][0] - found[1][0] < margin):
            return None
        return found[0][1], found[0][2]


def list_matcher(names: list[tuple[str, str]], threshold: float = 0.5, margin: float = 0.05) -> Callable[[str], str]:
    """Matches typed values to (entry, form): any list of names, of which an entry may have several forms."""
    index = GramIndex([(e, normal(f)) for e, f in names if normal(f)])

    def match(value: str) -> str:
        found = index.accept(normal(value), threshold, margin)
        return found[0] if found else UNMATCHED

    return match


def court_matcher(courts: list[tuple[str, str, str]], short: dict[str, str], filler: set[str], threshold: float = 0.2, margin: float = 0.02) -> Callable[[str], str]:
    """Matches typed courts to (court_name, name_pattern, level): the kind must be the entry's, the place near one of its places.

    ``short`` has the short forms of the words that name a kind of court, ``filler`` the words that don't tell courts apart.
    """
    places, kinds = [], defaultdict(set)
    for name, pattern, level in courts:
        kind = level.replace("_", " ")
        kinds[kind].add(name)
        for p in (pattern or "").split("|"):
            if p.strip():
                places.append((name, " ".join(w for w in normal(p).split() if w not in kind.split()) or kind))
    index = GramIndex(places)
    single = {k: next(iter(v)) for k, v in kinds.items() if len(v) == 1}
    words = {w for k in kinds for w in k.split()}

    def near(word: str) -> str | None:
        """The word of a kind of court that a typed word spells, if any."""
        for w in sorted(words):
            most = 1 + (len(w) > 4)
            if word == w or (len(word) > 2 and word[0] in w and edit_distance(word, w, most) <= most):
                return w
        return None

    def kind_of(text: str) -> tuple[str, list[str]]:
        """The kind of court that is typed, and the other words."""
        kind, rest = [], []
        for w in " ".join(short.get(w, w) for w in text.split()).split():
            k = None if w in filler else near(w)
            if k is not None and k not in kind:
                kind.append(k)
            elif w not in filler and (k is None or k != "court"):
                rest.append(w)
        # one spelling of a kind is enough where it leaves no choice
        for name in sorted(kinds, key=len):
            if set(name.split()) == set(kind):
                return name, rest
        several = [name for name in kinds if kind and set(kind) - {"court"} and set(kind) <= set(name.split())]
        return (several[0] if len(several) == 1 else ""), rest

    def match(value: str) -> str:
        wanted, rest = kind_of(re.sub(r"\bhigh\s+c\b", "high court", re.sub(r"\b([hs]) c\b", r"\1c", normal(value))))
        if wanted not in kinds:
            return UNMATCHED
        if wanted in single:
            # the only one of its kind: what else was typed must not name another place
            other = [f for w in rest if (f := index.accept(w, 0.6, 0.0)) and f[0] != single[wanted]]
            return UNMATCHED if other else single[wanted]
        if not rest:
            return UNMATCHED
        typed = " ".join(rest)

        def far(_: str, form: str) -> float | None:
            most = max(1, len(form) // 4) + 1
            d = edit_distance(typed, form, most)
            return d / len(form) if d <= most else None

        found = index.accept(typed, threshold, margin, kinds[wanted], far)
        if found is None and len(rest) > 1:  # place and seat together, or words beside the place
            got = {f for n in (1, 2) for p in zip(*(rest[i:] for i in range(n))) if (f := index.accept(" ".join(p), 0.6, 0.05, kinds[wanted]))}
            longest = {e for e, f in got if all(f == g or f not in g.split() for _, g in got)}
            entries = longest if len(longest) == 1 else {e for e, _ in got}
            return next(iter(entries)) if len(entries) == 1 else UNMATCHED
        return found[0] if found else UNMATCHED

    return match


_NUMBER = re.compile(r"(?<![\w.])(\d+)\s*[-(]?\s*([a-z](?![\w]))?")


def provision_matcher(statutes: list[tuple[str, str]], provision: set[str], filler: set[str], threshold: float = 0.15, margin: float = 0.05) -> Callable[[str], str]:
    """Matches typed provisions to (id, provision_name): the number must be the entry's, the act near one that has it.

    ``provision`` has the words for a provision, ``filler`` those of an act's name that don't tell it from others; words that
    half of the acts share don't either.
    """
    forms, by_number, acts = [], defaultdict(dict), {}
    for sid, name in statutes:
        code, _, number = sid.lower().partition(":")
        acts[code] = re.sub(r"^.*?\bin\s+", "", normal(name), count=1)
        by_number[number][code] = sid
    shared = Counter(w for act in acts.values() for w in set(act.split()))
    tell = {}
    for code, act in acts.items():
        words = [w for w in act.split() if w not in filler and not w.isdigit()]
        tell[code] = [w for w in words if 2 * shared[w] <= len(acts)] or words
        forms += [(code, code), (code, " ".join(tell[code])), (code, " ".join(w for w in act.split() if w not in {"the", "in"} and not w.isdigit()))]
    index = GramIndex(forms)

    def spelled(word: str, typed: list[str]) -> int | None:
        most = 0 if len(word) < 3 else 1 if len(word) < 7 else 2
        d = min((edit_distance(word, t, most) for t in typed), default=9)
        return d if d <= most else None

    def match(value: str) -> str:
        text = normal(re.sub(r"(?i)u/s", " section ", value))
        found = [(int(m[1]), m[2] or "") for m in _NUMBER.finditer(text)]
        # a year belongs to the act, not to the provision
        numbers = [f for f in found if not (1800 <= f[0] < 2100 and not f[1])] or found
        have = by_number.get(f"{numbers[0][0]}{numbers[0][1]}", {}) if numbers else {}
        if not have:
            return UNMATCHED
        rest = [w for w in _NUMBER.sub(" ", text).split() if w not in provision and not any(len(w) > 4 and edit_distance(w, p, 2) <= 2 for p in provision if len(p) > 6)]
        rest = [w for w in rest if w not in {"in", "the", "of"}]
        if not rest:
            return next(iter(have.values())) if len(have) == 1 else UNMATCHED

        def act(code: str, form: str) -> float | None:
            """An abbreviation must stand there as it is; of a name every telling word, each near its spelling."""
            if form == code:
                return 0.0 if code in rest and not any(w in acts and w != code for w in rest) else None
            far = [spelled(w, rest) for w in tell[code]]
            return None if None in far else sum(far) / max(1, len(form))

        found = index.accept(" ".join(rest), threshold, margin, deviation=act)
        return have.get(found[0], UNMATCHED) if found else UNMATCHED

    return match


def mapped(values: DataFrame, listed: list[tuple], build: Callable, entry: int, value: str = "value", max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``values`` with ``ref_id``, the entry each value means, and ``exact``, whether it is an entry (field ``entry`` of ``listed``) as it stands."""
    if len(listed) > max_entries:
        raise ValueError(f"the reference list has more than {max_entries} entries, the stated bound")
    shared = values.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, entries = build(shared.value), {r[entry] for r in shared.value}
        for b in batches:
            yield pd.DataFrame({"_v": b["_v"], "ref_id": [match(v) for v in b["_v"]], "exact": b["_v"].isin(entries)})

    rows = values.where(F.col(value).isNotNull())
    known = rows.select(F.col(value).alias("_v")).distinct().mapInPandas(run, "_v string, ref_id string, exact boolean")
    known = known.select("_v", "ref_id", "exact", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("_part"))
    part = F.pmod(F.xxhash64(*[c for c in values.columns if c != value]), F.lit(SALT)).cast("int")
    both = rows.withColumn("_part", part).join(known.withColumnRenamed("_part", "_p"), (F.col(value) == F.col("_v")) & (F.col("_part") == F.col("_p")))
    return both.select(*values.columns, "ref_id", "exact")
