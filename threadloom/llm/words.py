"""Texts to plain words, alike for every operator that compares words."""

from __future__ import annotations

import html
import re

# Characters without width and direction marks.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
INLINE_TAG = re.compile(r"</?(?:a|abbr|b|cite|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|u|wbr)\b[^<>]*>", re.I)
TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>")
WORD = re.compile(r"[^\W_]+")


def unmarked(text: str) -> str:
    """Without markup, entities and invisible characters."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    return text


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORD.findall(unmarked(text).lower())
