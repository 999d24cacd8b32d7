"""Lexicon, regular-expression and quoted-phrase predicates as native expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that flags are defined by.
HOSTILITY = [
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "clown", "liar", "liars", "troll", "trolls", "shill", "shills", "paid shill",
    "brainwashed", "cult", "bullshit", "fuck", "fucking", "shut up", "sheep", "sheeple",
]
ANTI_INSTITUTIONAL = [
    "big pharma", "pharma", "fauci", "cdc", "mainstream media", "msm", "government lies", "plandemic", "scamdemic", "experimental vaccine",
    "gene therapy", "fake pandemic", "wake up", "sheep", "sheeple", "natural immunity", "vaers", "ivermectin", "hydroxychloroquine",
    "my body my choice", "mandate", "mandates", "tyranny", "censorship", "nuremberg", "depopulation", "microchip", "5g",
]
# The candidate expression; between the word boundaries "source?" needs a word character behind it.
CANDIDATE = r"\b(false|misinformation|misleading|debunk|fact[- ]?check|not true|isn't true|incorrect|wrong|no evidence|source\?|cdc|who\.int|snopes|reuters)\b"


def pattern(terms: Iterable[str], substring_marks: str = " ") -> str:
    """One alternation: terms with a mark match anywhere, others as whole words."""
    parts = [re.escape(t.lower()).replace(r"\ ", " ") if any(m in t for m in substring_marks) else rf"\b{re.escape(t.lower())}\b" for t in terms]
    return "|".join(parts)


def has_term(text: Column, terms: Sequence[str], substring_marks: str = " ") -> Column:
    """1 if any term matches the lower-cased text, else 0; null text gives 0."""
    if not terms:
        return F.lit(0)
    return F.coalesce(F.lower(text).rlike(pattern(terms, substring_marks)).cast("int"), F.lit(0))


def candidate(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){CANDIDATE}"), F.lit(False))


def query_terms(query: Column) -> Column:
    """Quoted phrases if there are any, else the words; lower-cased."""
    low = F.lower(query)
    quoted = F.regexp_extract_all(low, F.lit('"([^"]+)"'), F.lit(1))
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    return F.when(F.size(quoted) > 0, quoted).otherwise(words)


def first_matching_query(text: Column, queries: Column) -> Column:
    """The first query all of whose terms occur in the text; null if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.filter(queries, lambda q: (F.size(query_terms(q)) > 0) & F.forall(query_terms(q), lambda t: F.contains(low, t)))
    return F.get(hits, F.lit(0))
