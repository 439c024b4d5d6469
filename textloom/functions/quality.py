"""Quality scores: of curation (with its grade and gates) and of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from . import text as X


def with_tokens(df: DataFrame, content: str = "content") -> DataFrame:
    """Arrays that several scores need, computed once."""
    c = F.col(content)
    return df.withColumn("words", X.words(c)).withColumn("tokens", X.word_tokens(c)).withColumn("lower_words", F.transform("words", F.lower))


def _cap(c: Column) -> Column:
    return F.least(c, F.lit(1.0))


def _ratio(a: Column, b: Column) -> Column:
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def rounded(c: Column, places: int) -> Column:
    """Halves away from zero, after the last bits of the arithmetic have been rounded off."""
    return F.round(F.round(c, 9), places)


def gibberish_matches(content: Column, tokens: Column) -> Column:
    """Patterns are tried only where a plain comparison leaves a match possible."""
    ones = F.when(F.contains(content, F.lit("\\" + "1" * 8)), F.regexp_count(content, F.lit(P.BACKSLASH_ONES))).otherwise(F.lit(0))
    return (
        F.regexp_count(content, F.lit(P.SYMBOL_RUN))
        + ones
        + F.size(F.filter(tokens, lambda x: (F.length(x) >= 8) & x.rlike(f"^{P.CONSONANT_WORD}$")))
    )


def sentence_pieces(content: Column) -> Column:
    return F.size(F.filter(F.transform(F.split(content, "[.]"), X.strip), lambda x: F.length(x) >= 5))


def with_scores(df: DataFrame, content: str = "content", tables: Column | None = None, images: Column | None = None) -> DataFrame:
    """The seven curation metrics, rounded to four places, the grade, and term_count: technical and domain terms. df has with_tokens' arrays."""
    n, distinct = F.size("words"), F.col("_distinct")
    lexical = _cap(_ratio(distinct, n) * 1.5)
    density = F.when(distinct > 1, _cap(X.word_entropy(F.col("lower_words")) / F.log2(distinct.cast("double")) * 1.2)).otherwise(F.lit(0.3))
    technical = _cap(_ratio(F.col("_technical"), n) * 100.0)
    structural = _cap(F.regexp_count(F.col(content), F.lit("(?i)" + P.MARKER_START + P.STRUCTURED_MARKERS)).cast("double") / 5.0)
    domain = _cap(_ratio(F.col("_domain"), n) * 50.0)
    rich = _cap(F.lit(0.3) + (tables if tables is not None else F.lit(0)) * 0.15 + (images if images is not None else F.lit(0)) * 0.10)
    # Columns of their own and no struct: each is made once, and only if it is asked for.
    parts = {"_l": lexical, "_i": density, "_t": technical, "_s": structural, "_d": domain, "_r": rich}
    counts = {"_technical": X.tokens_in(F.col("tokens"), P.TECHNICAL_TERMS), "_domain": X.tokens_in(F.col("tokens"), P.DOMAIN_INDICATORS)}
    df = df.withColumns({"_distinct": F.size(F.array_distinct("lower_words")), **counts}).withColumns(parts).withColumn("term_count", F.col("_technical") + F.col("_domain"))
    l, i, t, s, d, r = map(F.col, parts)
    overall = F.greatest(l * 0.15 + i * 0.20 + t * 0.15 + s * 0.15 + d * 0.15 + r * 0.20, F.lit(0.2))
    named = {"lexical_diversity": l, "information_density": i, "technical_density": t, "structural_quality": s, "domain_relevance": d, "content_richness": r, "overall_score": overall}
    df = df.withColumns({k: F.when(n > 0, rounded(v, 4)).otherwise(F.lit(0.0)) for k, v in named.items()}).drop("_distinct", *counts, *parts)
    return df.withColumn("quality_grade", grade(F.col("overall_score")))


def grade(score: Column) -> Column:
    steps = [(0.9, "A+"), (0.8, "A"), (0.7, "B+"), (0.6, "B"), (0.5, "C+"), (0.4, "C")]
    out = F.when(score >= steps[0][0], steps[0][1])
    for least, name in steps[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("D")


def extraction_grade(score: Column) -> Column:
    return F.when(score >= 0.4, grade(score)).when(score >= 0.3, "D").otherwise("F")


def gate_reason(words: Column, pieces: Column, gibberish: Column, min_words: int = 50, min_sentences: int = 2) -> Column:
    """Why the first stage rejects a document, or null."""
    return (
        F.when(words < min_words, "No extractable content")
        .when(pieces < min_sentences, F.format_string(f"Too few sentences: %d < {min_sentences}", pieces))
        .when(gibberish > words * F.lit(0.2), F.format_string("Too much gibberish: %d matches", gibberish))
    )


def with_extraction_scores(df: DataFrame, text: str = "text", tables: Column | None = None) -> DataFrame:
    """Type-token ratio, reading ease, entropy ratio, structure, richness, overall (but for its last bits not rounded), grade; zeros for blank texts."""
    t = F.col(text)
    df = df.withColumn("_w", X.words(t)).withColumn("_l", F.transform("_w", F.lower))
    # Columns of their own and no structs: each is made once, and only if it is asked for.
    df = df.withColumns({
        "_syllables": X.syllables(t, F.size("_w")), "_sentences": F.regexp_count(t, F.lit(rf"{X.no_space('.!?')}[^.!?]*+")),
        "_words": F.regexp_count(t, F.lit(f"{X.no_space('.!?')}++")), "_marks": F.regexp_count(t, F.lit("[,;:]")), "_distinct": F.size(F.array_distinct("_l")),
    })
    n, s, distinct, syllables = F.size("_w"), F.col("_sentences"), F.col("_distinct"), F.col("_syllables")
    ratio = _ratio(distinct, n)
    ease = F.lit(206.835) - 1.015 * n / F.greatest(s, F.lit(1)) - 84.6 * syllables / F.greatest(n, F.lit(1))
    reading = F.when((s == 0) | (n == 0), 0.0).when(syllables > 0, F.greatest(F.lit(0.0), _cap(ease / 100.0))).otherwise(F.lit(0.5))
    density = F.when(distinct > 1, X.word_entropy(F.col("_l")) / F.log2(distinct.cast("double"))).otherwise(F.lit(0.0))
    structure = F.when(s == 0, 0.0).otherwise((_cap(_ratio(F.col("_words"), s) / 20.0) + _cap(_ratio(F.col("_marks"), s) / 3.0)) / 2.0)
    # A boundary before a word character is no word character before it; that is looked at only where the first one matches.
    b, w = P.BOUNDARY, P.WORD_CHAR
    numbers = F.regexp_count(t, F.lit(rf"\p{{Nd}}(?<!{w}\p{{Nd}})\p{{Nd}}*\.?\p{{Nd}}*{b}"))
    acronyms = F.regexp_count(t, F.lit(rf"[A-Z](?<!{w}[A-Z])[A-Z]+{b}"))
    k = tables if tables is not None else F.lit(0)
    rich = _cap(F.least(k * 0.2, F.lit(0.6)) + F.when(n > 0, F.least(_ratio(numbers + acronyms, n) * 2.0, F.lit(0.4))).otherwise(F.lit(0.0)))
    parts = {"_ratio": ratio, "_reading": reading, "_density": density, "_structure": structure, "_rich": rich}
    df = df.withColumns(parts)
    l, e, i, k, r = map(F.col, parts)
    blank = n == 0
    overall = _cap(F.greatest(l * 0.25 + e * 0.25 + i * 0.20 + k * 0.15 + r * 0.15, F.lit(0.0)))
    named = {"lexical_diversity": l, "readability": e, "information_density": i, "structural_complexity": k, "content_richness": r}
    df = df.withColumns({k: F.when(blank, 0.0).otherwise(rounded(v, 3)) for k, v in named.items()})
    # Without the last bits of the arithmetic, which decide grades and tenths where the quality is at a bound of theirs.
    df = df.withColumn("overall_quality", F.when(blank, 0.0).otherwise(F.round(overall, 12))).withColumn("word_count", n).withColumn("sentence_count", s)
    return df.withColumn("extraction_grade", extraction_grade(F.col("overall_quality"))).drop("_w", "_l", "_syllables", "_sentences", "_words", "_marks", "_distinct", *parts)
