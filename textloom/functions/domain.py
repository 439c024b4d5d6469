"""Domain category, relevance and boost; redaction of personal data."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def category(content: Column) -> Column:
    """The first category one of whose words is a substring of the lower-cased text."""
    low, out = F.lower(content), F
    for name, listed in P.CATEGORY_WORDS:
        out = out.when(low.rlike("|".join(listed)), name)
    return out.otherwise("general")


def relevance(n_words: Column, term_count: Column) -> Column:
    """(technical + domain) / words x 20 within 0.1 and 1; 0.2 without words. term_count: as with_scores gives it."""
    ratio = term_count.cast("double") / F.greatest(n_words, F.lit(1)) * 20.0
    return F.when(n_words > 0, F.least(F.greatest(ratio, F.lit(0.1)), F.lit(1.0))).otherwise(F.lit(0.2))


def boosted(score: Column, relevance_score: Column, least: float = 0.1, factor: float = 1.2) -> Column:
    return F.when(relevance_score >= least, F.least(score * factor, F.lit(1.0))).otherwise(score)


def _java(pattern: str) -> str:
    """Before a digit a boundary is no word character before it; that is looked at only where there is a digit."""
    pattern = re.sub(r"^\\b(?=\[0-9\]|\(\?:\[0-9\])", lambda _: rf"(?=[0-9])(?<!{P.WORD_CHAR})", pattern)
    return pattern.replace(r"\b", P.BOUNDARY).replace("[0-9]", r"\p{Nd}")


def _redacted(name: str, pattern: str):
    """One kind's replacement, tried only on texts that have a character it needs."""
    needed = lambda t: F.contains(t, F.lit("@")) if name == "EMAIL" else t.rlike(r"\p{Nd}")
    return lambda t: F.when(needed(t), F.regexp_replace(t, _java(pattern), f"[{name}]")).otherwise(t)


def redact(content: Column) -> Column:
    """Each kind of personal data in turn becomes its name in brackets."""
    for name, pattern in P.PII:
        content = F.transform(F.array(content), _redacted(name, pattern))[0]  # an array of one, so that the text before is made once
    return content


def pii_counts(content: Column) -> dict[str, Column]:
    """Matches of each kind in the text as it stands."""
    return {name.lower(): F.regexp_count(content, F.lit(_java(pattern))) for name, pattern in P.PII}
