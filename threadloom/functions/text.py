"""Expressions on texts, scores and vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(text: Column, limit: int | None = None) -> Column:
    """Unicode white space to single blanks, trimmed, cut to ``limit`` characters; null as empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.substring(flat, 1, limit) if limit else flat


def word_count(text: Column) -> Column:
    flat = compact(text)
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " "))).cast("bigint")


def has_quote(text: Column) -> Column:
    return F.coalesce(text.startswith(">") | F.contains(text, F.lit("\n>")), F.lit(False)).cast("int")


def has_quote_edit(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit("~~")) | F.contains(F.lower(text), F.lit("ftfy")), F.lit(False)).cast("int")


def has_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\d+(\.\d+)?\s?%|\b\d{2,}\b"), F.lit(False)).cast("int")


def safe_div(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def score_bin(score: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Half-open bins; the last one takes its upper edge in; anything else is ``unknown``."""
    case = None
    for k, name in enumerate(names):
        upper = score <= edges[k + 1] + 1e-7 if k == len(names) - 1 else score < edges[k + 1]
        hit = (score >= edges[k]) & upper
        case = F.when(hit, name) if case is None else case.when(hit, name)
    return case.otherwise("unknown")


def clip(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null and not-a-number as the lower bound."""
    return F.least(F.greatest(F.coalesce(F.nanvl(score, F.lit(low)), F.lit(low)), F.lit(low)), F.lit(high))


def entropy_of(values: Column) -> Column:
    """Natural entropy of an array of weights, after dividing by their sum; 0 for none."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    shares = F.filter(F.transform(values, lambda x: F.try_divide(x, total)), lambda p: p > 0)
    return F.coalesce(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.ln(p)), F.lit(0.0))


def entropy_as_is(values: Column) -> Column:
    """As ``entropy_of`` but of the values as they are."""
    return F.aggregate(F.filter(values, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.ln(p))


def argmax(values: Column) -> Column:
    """Position (from 0) of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sequence_id(prefix: str, number: Column, width: int = 5) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def pair_id(claim: Column, response: Column, source: Column) -> Column:
    return F.concat(source, F.lit(":"), claim, F.lit("->"), response)


def absolute(link: Column, site: str) -> Column:
    """The site in front of relative links."""
    return F.when(link.startswith("/"), F.concat(F.lit(site), link)).otherwise(link)
