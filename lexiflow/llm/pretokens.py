"""The split of text that stands before the merges of the byte-level vocabularies."""

from __future__ import annotations

import re

import regex

# White space as Unicode's White_Space property, which the tokenizer libraries use for \s.
SPACE = r"\t-\r \x85\xa0  -     　"
# Letters and numbers below U+0250.
LATIN = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
LATIN_NUMBER = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def _pattern(letter: str, number: str) -> str:
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{SPACE}{letter}{number}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


_latin = re.compile(_pattern(LATIN, LATIN_NUMBER)).findall
_any = regex.compile(_pattern(r"\p{L}", r"\p{N}")).findall
_beyond = re.compile(r"[^\x00-ɏ]").search


def split(text: str) -> list[str]:
    """The pre-tokens of ``text`` in order; joined they give the text again.

    Texts without characters from U+0250 on take an equal pattern with plain classes, which is faster.
    """
    return _any(text) if _beyond(text) else _latin(text)
