"""Splitting oversized items at natural boundaries, by packing a structure tree.

A text is parsed into a tree: sections under headings by their depth (``#`` marks, ``<h1>`` to ``<h6>``, decimal numbers
such as 2.1, and short lines without an end mark below all of these), blocks between blank lines or under markup, list items
by their indentation, sentences and lines, words. From below, neighbouring siblings that fit are merged up to the limit;
only a node that is too large by itself is opened, and what it is cut into is not merged with its neighbours, so a cut falls
on the coarsest boundary there is, and inside a word only where a word alone exceeds the limit. A heading is never parted
from what follows it: headings that stand alone before an oversized node are packed as that node's beginning. Every piece but
the first begins with the last ``overlap`` characters, from a word's start on, of the text before it; pieces with their
overlap stay within the limit.

Defined results: null texts and texts within the limit are not oversized and give no pieces; an empty text likewise; a very
long text without any boundary is cut at the limit, never before a combining mark; offsets are in Unicode characters.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks of boundaries, the coarsest first: headings of depth 1 to 6, headings of unknown depth, blocks, list items by
#: indentation, sentences and lines, words.
HEADING, TITLE, BLOCK, ITEM, SENTENCE, WORD = 1, 7, 8, 9, 13, 14
_LINE = re.compile(r"[^\n]*\n?")
_HASH = re.compile(r"(#{1,6})\s+\S")
_TAG = re.compile(r"<(?:(h)([1-6])|(li|tr|dt)|(p|div|section|article|ul|ol|table|blockquote|pre))\b[^<>]*>", re.IGNORECASE)
_NUMBERED = re.compile(r"(\d{1,3}(?:\.\d{1,3}){1,4})\.?\s+\S")
_BULLET = re.compile(r"([ \t]*)(?:[-*•–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])\s")
_STOP = re.compile(r"(?<=[.!?।۔])[\"'”’)\]]*\s+|(?<=[。！？])[”’」』）]*")
_SPACE = re.compile(r"\s+")
_TITLE_LENGTH = 60


class Tree:
    """The boundaries of a text by rank; the children of a span are what its coarsest boundaries part it into."""

    def __init__(self, text: str):
        self.text, self.at = text, {r: [] for r in range(HEADING, WORD + 1)}
        self.glued: set[int] = set()  # starts of lines that stay with the heading above them
        rank_of: dict[int, int] = {}

        def mark(pos: int, rank: int) -> None:
            if 0 < pos < len(text) and pos not in self.glued:
                rank_of[pos] = min(rank, rank_of.get(pos, WORD))

        blank, after_heading = True, False
        for m in _LINE.finditer(text):
            line = m.group()
            if not line:
                break
            body = line.strip()
            if not body:
                blank = True
                continue
            heading = self._heading(line, body, blank, text, m.end())
            if after_heading and heading is None:
                self.glued.add(m.start())
            elif heading is not None:
                mark(m.start(), heading)
            elif blank:
                mark(m.start(), BLOCK)
            item = _BULLET.match(line)
            if item and heading is None:
                mark(m.start(), ITEM + min(3, len(item[1].expandtabs(4)) // 2))
            elif not blank:
                mark(m.start(), SENTENCE)
            for t in _TAG.finditer(line):
                mark(m.start() + t.start(), int(t[2]) if t[1] else ITEM if t[3] else BLOCK)
            blank, after_heading = False, heading is not None
        for m in _STOP.finditer(text):
            mark(m.end(), SENTENCE)
        for m in _SPACE.finditer(text):
            mark(m.end(), WORD)
        for p in sorted(rank_of):
            self.at[rank_of[p]].append(p)

    @staticmethod
    def _heading(line: str, body: str, blank: bool, text: str, end: int) -> int | None:
        """The rank of a line that is a heading."""
        m = _HASH.match(body)
        if m:
            return len(m[1])
        m = _TAG.match(body)
        if m and m[1]:
            return int(m[2]) if body.lower().endswith(f"</h{m[2]}>") else None
        if len(body) > _TITLE_LENGTH or body[-1] in ".!?।۔。！？,;:|":
            return None
        m = _NUMBERED.match(body)
        if m and blank:
            return min(6, 1 + m[1].count("."))
        # a short line between blank lines, or after one and before text
        return TITLE if blank and end < len(text) and not _BULLET.match(line) and not body.startswith("<") else None

    def children(self, start: int, end: int, rank: int) -> tuple[list[tuple[int, int]], int]:
        """The spans that the coarsest boundaries from ``rank`` on part a span into, and their rank (beyond ``WORD`` if none)."""
        while rank <= WORD:
            have = self.at[rank]
            cuts = have[bisect_right(have, start) : bisect_left(have, end)]
            if cuts:
                return list(zip([start, *cuts], [*cuts, end])), rank
            rank += 1
        return [(start, end)], rank

    def only_headings(self, start: int, end: int) -> bool:
        """Whether a span holds nothing but headings."""
        at, any_line = start, False
        for m in _LINE.finditer(self.text, start, end):
            body = m.group().strip()
            if body:
                if self._heading(m.group(), body, True, self.text + " ", at) is None:
                    return False
                any_line = True
        return any_line


def _hard(text: str, start: int, end: int, limit: int) -> list[tuple[int, int]]:
    out = []
    while end - start > limit:
        cut = start + limit
        while cut > start + 1 and unicodedata.category(text[cut])[0] == "M":
            cut -= 1
        out.append((start, cut))
        start = cut
    return [*out, (start, end)]


def pack(tree: Tree, start: int, end: int, limit: int, rank: int = HEADING) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that cover start to end."""
    if end - start <= limit:
        return [(start, end)]
    parts, rank = tree.children(start, end, rank)
    if rank > WORD:
        return _hard(tree.text, start, end, limit)
    out: list[tuple[int, int]] = []
    at = None  # where the run of siblings that are being merged begins
    for s, e in parts:
        if at is not None and e - at > limit:
            if rank <= BLOCK and tree.only_headings(at, s):
                s = at
            else:
                out.append((at, s))
            at = None
        if e - s > limit:
            out += pack(tree, s, e, limit, rank + 1)
        elif at is None:
            at = s
    if at is not None:
        out.append((at, end))
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own, end) of the pieces of a text: from start to own it repeats what came before."""
    spans = pack(Tree(text), 0, len(text), limit - overlap)
    out = [(spans[0][0], spans[0][0], spans[0][1])]
    word = re.compile(r"\s\S")
    for s, e in spans[1:]:
        at = s - overlap
        if at <= out[-1][0]:
            at = out[-1][0]
        else:  # the next word's start, if there is one before the piece's own part
            m = word.search(text, at - 1, s)
            at = m.end() - 1 if m else at
            while at < s and unicodedata.category(text[at])[0] == "M":
                at += 1
        out.append((at, s, e))
    return out


def split(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """(tbl, rec_id, para, piece, start, own, end, text) of the oversized rows of (tbl, rec_id, para, text).

    Rows within the limit are filtered out before any Python; nothing is shuffled.
    """
    big = items.where(F.length("text") > limit).select("tbl", "rec_id", "para", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for tbl, rec, para, text in b.itertuples(index=False):
                out += [(tbl, rec, para, i, s, o, e, text[s:e]) for i, (s, o, e) in enumerate(pieces(text, limit, overlap))]
            yield pd.DataFrame(out, columns=["tbl", "rec_id", "para", "piece", "start", "own", "end", "text"])

    return big.mapInPandas(run, "tbl string, rec_id string, para int, piece int, start int, own int, end int, text string")
