"""Text functions as columns: whitespace, tokens, normalisation, keys, shingles."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import WS, WS_CHARS


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))  # looks at the ends only, where a pattern would try every character


def words(c: Column) -> Column:
    """What str.split() gives."""
    return F.array_remove(F.split(c, f"{WS}+"), "")


def word_tokens(c: Column) -> Column:
    """Runs of letters, numbers and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def tokens_in(tokens: Column, listed: list[str]) -> Column:
    """How many tokens are in the list."""
    return F.size(F.filter(tokens, lambda x: x.isin(listed)))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition. A Python function sees every row, so plain ASCII goes there as null."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def normalise_content(c: Column) -> Column:
    """NFKC, control characters, blank lines, runs of spaces; then lines that are too short or page numbers go."""
    c = F.regexp_replace(nfkc(c), r"[\p{C}&&[^\n\r\t]]", "")
    c = F.regexp_replace(c, rf"\n{WS}*\n{WS}*\n+", "\n\n")
    lines = F.transform(F.split(F.regexp_replace(c, r" [ \t]+|\t[ \t]*", " "), "\n"), strip)
    keep = lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\p{Nd}+$") & ((F.length(x) > 5) | x.rlike(r"\p{L}"))
    return strip(F.array_join(F.filter(lines, keep), "\n"))


def comparison_key(c: Column) -> Column:
    """White space as one space, punctuation deleted, lower case."""
    one = F.regexp_replace(c, f"{WS}+", " ")
    return strip(F.lower(F.regexp_replace(one, rf"[^\p{{L}}\p{{N}}_\s]", "")))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Hashes of the distinct n-word shingles; none if there are fewer words."""
    of = lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, n), " "))
    every = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1))), of))
    return F.when(F.size(tokens) >= n, every).otherwise(F.array().cast("array<bigint>"))


def vocabulary_words(c: Column) -> Column:
    """Lower-cased words of three characters or more with a letter, after marks have become spaces."""
    w = F.transform(words(F.translate(c, ",.();:", "      ")), F.lower)
    return F.filter(w, lambda x: (F.length(x) >= 3) & x.rlike(r"\p{L}"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+"), strip), lambda x: x != "")


def syllables(c: Column, n_words: Column | None = None) -> Column:
    """Syllables of all words of a text: vowel groups, without a last e of words that have others, one at least for each word.

    Counted by patterns over the whole text: vowel groups, words with such an e, words with a vowel, words of marks only (they
    have no syllable). Marks around a word do not count. n_words: the number of words, if it is known.
    """
    low, vowel, mark = F.lower(c), "[aeiouy]", "[.,!?;:]"
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    silent = count(rf"{vowel}++(?:{no_space('aeiouy')}++{vowel}++)+(?<=e){mark}*+(?!{no_space()})")
    only_marks = count(rf"{mark}(?<!{no_space()}{mark}){mark}*+(?!{no_space()})")
    n_words = count(f"{no_space()}++") if n_words is None else n_words
    without = n_words - count(rf"{vowel}{no_space()}*+") - only_marks
    return count(f"{vowel}++") - silent + without


def no_space(*others: str) -> str:
    """The class of characters that are no white space, and none of these."""
    return WS.replace("[", "[^", 1)[:-1] + "".join(others) + "]"


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def word_entropy(tokens: Column) -> Column:
    """Shannon entropy in bits of an array's values, as log2(n) - sum(c log2 c) / n, over sorted runs: no shuffle.

    sort_array compares natively; array_sort would evaluate an expression for each comparison. Runs of two values or more are found
    by one pattern over the sorted values (which have no line breaks), so that no lambda is called for each value; single ones add
    nothing. The pattern is possessive, which Java matches in a loop and not by recursion.
    """
    lines = F.concat(F.lit("\n"), F.array_join(F.sort_array(tokens), "\n"), F.lit("\n"))
    runs = F.regexp_extract_all(lines, F.lit(r"\n([^\n]++)(?:\n\1(?=\n))++"), F.lit(0))

    def add(total: Column, run: Column) -> Column:
        c = F.length(run) / (F.locate("\n", run, 2) - 1)
        return total + c * F.log2(c)

    n = F.size(tokens).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(runs, F.lit(0.0), add) / n)
