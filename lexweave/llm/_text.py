"""Text helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import unicodedata

import regex

#: Runs of letters, combining marks and digits, in any script.
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_OUTER = "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "PS")


def outer_stripped(text: str) -> list[str]:
    """Words split at white space, lower-cased and freed of outer punctuation; those that were only punctuation go."""
    return [w for w in map(bare, text.split()) if w]


def bare(token: str) -> str:
    """A white-space separated token, lower-cased and freed of outer punctuation."""
    token = token.lower()
    return token if token.isalnum() else token.strip(_OUTER)
