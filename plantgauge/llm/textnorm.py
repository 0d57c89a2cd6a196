"""Folding of texts for matching: markup, case, width, accents, invisible and lookalike characters."""

from __future__ import annotations

import html
import re
import unicodedata

#: Letters of other scripts that look like Latin ones.
LATIN_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ԛ": "q", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "ı": "i", "ø": "o", "ł": "l", "đ": "d", "æ": "ae", "œ": "oe", "ɡ": "g", "ɑ": "a", "ʏ": "y",
}
LOOKALIKE = re.compile(f"[{''.join(LATIN_LOOKALIKES)}]")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
COMBINING = re.compile("[\u0300-\u036f\u0483-\u0489\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]")
NOT_WORD = re.compile(r"[\W_]+")
INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤︀-️﻿]")


def fold(text: str) -> str:
    """Lower-case text without markup, accents and invisible characters; lookalikes are Latin letters."""
    if "<" in text or "&" in text:
        text = TAG.sub(" ", html.unescape(text))
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", INVISIBLE.sub("", text)).lower()
    if text.isascii():
        return text
    return COMBINING.sub("", LOOKALIKE.sub(lambda m: LATIN_LOOKALIKES[m.group()], text))


def letters(text: str) -> str:
    """Letters and digits of the folded text, nothing between them."""
    return NOT_WORD.sub("", fold(text))
