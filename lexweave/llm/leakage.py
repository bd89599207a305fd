"""Evaluation texts leaking into training text.

One Aho-Corasick automaton holds every run of ``anchor`` consecutive words of the test items, lower-cased and freed of
everything but letters, marks and digits, spaces included. A document is squeezed in the same way with its word starts
kept, and scanned once. Among ``span`` words of which at most ``edits`` are changed, dropped or added, one exact run of
ceil((span - edits) / (edits + 1)) words must remain, so anchors of that length lose no passage. Each merged run of
anchor hits is then extended to both sides word by word, spending at most ``edits``, and counts when it spans ``span``
words of the item.

The items are the stated, bounded query set. An automaton takes memory in proportion to its items, so one holds at most
about ``block_chars`` characters of them, and only so many are collected at a time. More items are dealt out by hash over
several automata; each costs one scan of the documents. Documents are only mapped, never shuffled.

Defined results: null or empty documents and items give no rows; items under ``span`` words can't leak by definition;
repeated documents each come out under their own id; equal items all come out; offsets refer to the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm._text import WORD

SPAN, EDITS = 15, 2
#: Characters of the items in one automaton (each takes a few hundred bytes there, in every executor).
BLOCK_CHARS = 2_000_000
_OTHER = regex.compile(r"[^\p{L}\p{M}\p{N}]+")
_CACHE: dict[str, tuple] = {}


def squeezed_words(text: str) -> list[str]:
    """The white-space separated words of an item, squeezed to letters, marks and digits."""
    return [w for w in (_OTHER.sub("", x) for x in text.lower().split()) if w]


def _automaton(items: list[tuple[int, str]], anchor: int) -> tuple:
    key = hashlib.md5(repr((items, anchor)).encode()).hexdigest()
    if key not in _CACHE:
        words = [(i, squeezed_words(t)) for i, t in items]  # an id may have several texts
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, ws) in enumerate(words):
            for k in range(len(ws) - anchor + 1):
                where.setdefault("".join(ws[k : k + anchor]), []).append((n, k))
        auto = ahocorasick.Automaton()
        for pattern, places in where.items():
            auto.add_word(pattern, (len(pattern), places))
        if where:
            auto.make_automaton()
        _CACHE.clear()
        _CACHE[key] = (auto if where else None, words)
    return _CACHE[key]


def _reach(words: list[str], i: int, text: str, at: int, bounds: np.ndarray, step: int, edits: int) -> list[int]:
    """Item words covered beyond word ``i`` (exclusive) going in direction ``step`` from ``at``, by edits spent."""
    best = [0] * (edits + 1)
    stack, seen = [(i, at, 0)], set()
    while stack:
        k, p, e = stack.pop()
        while 0 <= k < len(words):
            w = words[k]
            if step > 0 and text.startswith(w, p):
                p += len(w)
            elif step < 0 and p >= len(w) and text.startswith(w, p - len(w)):
                p -= len(w)
            else:
                break
            k += step
        if (k, p, e) in seen:
            continue
        seen.add((k, p, e))
        best[e] = max(best[e], abs(k - i))
        if e == edits or not 0 <= k < len(words):
            continue
        if step > 0:
            j = int(np.searchsorted(bounds, p, side="right"))
            nxt = int(bounds[j]) if j < len(bounds) else len(text)
        else:
            j = int(np.searchsorted(bounds, p, side="left"))
            nxt = int(bounds[j - 1]) if j else 0
        stack.append((k + step, p, e + 1))
        if nxt != p:
            stack += [(k + step, nxt, e + 1), (k, nxt, e + 1)]
    for e in range(1, edits + 1):
        best[e] = max(best[e], best[e - 1])
    return best


def passages(text: str, auto, words: list[tuple[int, list[str]]], anchor: int, span: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(item, words covered, start, end) of every item found in ``text``; offsets in the original, the longest passage of an item."""
    lower = text.lower()
    if len(lower) != len(text):  # a few letters change their length; keep offsets by lowering one by one
        lower = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    flat = "".join(WORD.findall(lower))
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for end, (size, places) in auto.iter(flat):
        for n, k in places:
            hits.setdefault(n, []).append((k, end - size + 1, end + 1))
    if not hits:
        return []
    starts, spots, n = [], [], 0
    for m in WORD.finditer(lower):
        starts.append(n)
        spots.append(m.start())
        n += m.end() - m.start()
    out, bounds = [], np.asarray(starts)

    def original(p: int) -> int:
        j = int(np.searchsorted(bounds, p, side="right")) - 1
        return spots[j] + (p - starts[j])

    for at, found in hits.items():
        (item, ws), runs = words[at], []
        offset = np.concatenate([[0], np.cumsum([len(w) for w in ws])])
        for k, s, e in sorted(found, key=lambda h: (h[1] - int(offset[h[0]]), h[0])):
            if runs and runs[-1][3] == s - int(offset[k]) and k <= runs[-1][1]:
                runs[-1][1], runs[-1][5] = k + anchor, e
            else:
                runs.append([k, k + anchor, None, s - int(offset[k]), s, e])
        top = (0, 0, 0)
        for first, last, _, _, s, e in runs:
            right = _reach(ws, last, flat, e, bounds, 1, edits)
            left = _reach(ws, first - 1, flat, s, bounds, -1, edits)
            cover = last - first + max(left[a] + right[edits - a] for a in range(edits + 1))
            top = max(top, (cover, -s, e))
        if top[0] >= span:
            out.append((item, top[0], original(-top[1]), original(top[2] - 1) + 1))
    return out


def leaked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_words, start, end): every item of which a passage of ``span`` words stands in a document."""
    anchor = -(-(span - edits) // (edits + 1))
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and length(t) > 0").distinct()
    blocks = max(1, -(-(known.agg(F.sum(F.length("t"))).first()[0] or 0) // block_chars))
    spark, parts = docs.sparkSession, []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    for n in range(blocks):
        block = sorted(map(tuple, known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).collect()))
        shared = spark.sparkContext.broadcast(block)

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            auto, words = _automaton(shared.value, anchor)
            for b in batches:
                out = []
                if auto is not None:
                    for d, t in zip(b["doc_id"], b["text"]):
                        out += [(d, *p) for p in passages(t, auto, words, anchor, span, edits)]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_words", "start", "end"])

        parts.append(rows.mapInPandas(scan, "doc_id long, item_id long, n_words int, start int, end int"))
    return reduce(DataFrame.unionByName, parts)
