"""Identifiers, authors and numbers in one notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Author names that stand for no person.
NO_AUTHOR = ("", "[deleted]", "deleted", "automoderator")

#: What is trimmed from both ends of keys: blanks, controls, no-break and zero-width spaces.
BLANKS = " \t\r\n\f\u000b  ​﻿"

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def plain_key(c: Column) -> Column:
    """Trimmed and lower-cased; null stays null."""
    return F.lower(strip(c))


def plain_id(c: Column) -> Column:
    """Trimmed, lower-cased, without one leading ``t1_`` or ``t3_``; empty is null."""
    bare = F.regexp_replace(plain_key(c), "^t[13]_", "")
    return F.when(bare != "", bare)


def token(c: Column) -> Column:
    """Trimmed and lower-cased, null as the empty string."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def author(c: Column) -> Column:
    """Token form; null for empty, deleted and moderator-bot names."""
    name = token(c)
    return F.when(~name.isin(*NO_AUTHOR), name)


def none_if_blank(c: Column) -> Column:
    """Trimmed; null if empty or the word nan in any case."""
    text = F.trim(c)
    return F.when(~F.lower(text).isin("", "nan"), text)


def to_double(c: Column) -> Column:
    """Null where the text is no plain decimal number."""
    return F.when(c.cast("string").rlike(NUMBER), F.expr("0D") + c.cast("string").try_cast("double"))


def to_long(c: Column) -> Column:
    """Truncated toward zero; null where the text is no number."""
    return to_double(c).try_cast("bigint")


def double_or_zero(c: Column) -> Column:
    return F.coalesce(F.nanvl(to_double(c), F.lit(0.0)), F.lit(0.0))


def long_or_zero(c: Column) -> Column:
    return F.coalesce(to_long(c), F.lit(0).cast("bigint"))


def hash_id(c: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the UTF-8 text."""
    return F.substring(F.sha2(c, 256), 1, 16)
