"""Operator 10, quality rules: cross-document line frequency.

Normalised lines are hashed, the distinct documents of each host that hold a line are counted, lines above the limit are
removed, and documents that this depletes are rejected, beside rules on the document alone.

A line is above the limit when more than ``max_docs_per_host`` documents of the host hold it; documents of equal text count as
one. With ``copies="near"`` near-duplicates (operator 8) do, too, so that a group of near copies is left to a later stage: of
documents that hold lines above the limit, those with at least ``SUSPECT`` of their words in them are put in near-duplicate
classes, and a line must then occur in more than ``max_docs_per_host`` classes. (A document with less of that is not depleted.)

Defined cases: a null text is a text without words (rejected, as under 50 words); a null host is the host ''; an empty table
gives an empty result; a row with the same id and text as another gets the same verdict, rows of a null id as well; lines without
a word are ignored; whole texts count, however long; columns other than id, text and host are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, KEY_DDL, WHITESPACE, Scratch, load_documents, row_key
from .line_templates import suspect_classes

SYMBOLS = "#*$%&|<>"
_SPACES = re.compile("[\x20\x09-\x0d]+")
_DIGITS = re.compile("[0-9]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MAX_DOCS_PER_HOST = 20
MAX_REMOVED_PERCENT = 70
SUSPECT = 0.3

PROFILE_DDL = (
    f"{KEY_DDL}, doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " lines array<struct<h: binary, words: int>>"
)


def normalise_line(line: str) -> str:
    """A-Z lower-cased, digit runs as 0, white space as single spaces."""
    return _SPACES.sub(" ", _DIGITS.sub("0", line.translate(_FOLD))).strip(WHITESPACE)


def line_hash(key: str) -> bytes:
    return hashlib.md5(key.encode("utf-8", "surrogatepass")).digest()


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more, their first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    inside = bytearray(len(words))
    for i, w in enumerate(windows):
        if w in twice:
            inside[i : i + 3] = b"\1\1\1"
    return sum(inside)


def text_rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITESPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, WHITESPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def distinct_lines(text: str) -> dict[bytes, int]:
    """Words in all occurrences of each distinct normalised line, by the line's hash."""
    words: dict[str, int] = {}
    for line in text.split("\n"):
        if key := normalise_line(line):
            words[key] = words.get(key, 0) + key.count(" ") + 1
    return {line_hash(key): n for key, n in words.items()}


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rules = [text_rules(t) for t in b["text"]]
        out = pd.DataFrame(rules, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], dtype="int64")
        out["lines"] = [[{"h": h, "words": n} for h, n in distinct_lines(t).items()] for t in b["text"]]
        for c in (*KEY, "doc_id", "host"):
            out[c] = b[c].to_numpy()
        yield out


def profile(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts and line hashes of each document; the text itself goes no further."""
    rows = docs.select(
        *row_key(id_col, text_col),
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
    )
    return rows.mapInPandas(_profile, PROFILE_DDL)


def frequent_lines(lines: DataFrame, name: str, limit: int) -> DataFrame:
    """(host, h) of lines that more than limit different documents hold, by their name. Partial counts go first: no line is a hot key."""
    return lines.groupBy("host", "h").agg(F.count_distinct(name).alias("n")).where(F.col("n") > limit).select("host", "h")


def _judged(
    docs: DataFrame, id_col: str, text_col: str, host_col: str, max_docs_per_host: int, max_removed_percent: int, copies: str, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """The verdicts that judge() gives, and (key, host, h, words) of each document's lines above the limit."""
    profiles = scratch.save(profile(docs, id_col, text_col, host_col), "profiles")
    lines = profiles.select(*KEY, "host", F.explode("lines").alias("l")).select(*KEY, "host", "l.h", "l.words")
    above = scratch.save(frequent_lines(lines, "k_text", max_docs_per_host), "above")
    # Rows equal in all of this are one document. AQE may split the many rows of a very common line: both sides are dealt by the join.
    found = scratch.save(lines.join(above, ["host", "h"]).select(*KEY, "host", "h", "words").distinct(), "found")
    if copies == "near":
        hits = found.groupBy(*KEY, "host").agg(F.sum("words").alias("some"))
        suspects = profiles.select(*KEY, "host", "n_words").join(hits, [*KEY, "host"]).where(F.col("some") >= SUSPECT * F.col("n_words"))
        classes = suspect_classes(docs, suspects, scratch, id_col, text_col)
        held = found.join(classes, KEY, "left").withColumn("class", F.coalesce("class", "k_text"))
        found = found.join(scratch.save(frequent_lines(held, "class", max_docs_per_host), "independent"), ["host", "h"])
    removed = found.groupBy(*KEY, "host").agg(F.sum("words").alias("n_removed_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    verdicts = (
        profiles.drop("lines")
        .join(removed, [*KEY, "host"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * F.col("n_removed_words") <= max_removed_percent * F.col("n_words")))
    )
    return verdicts, found


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs_per_host: int = MAX_DOCS_PER_HOST,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
    copies: str = "text",
) -> DataFrame:
    """One row per document: key, doc_id, the rules' counts, n_removed_words, base_failed, kept."""
    return _judged(docs, id_col, text_col, host_col, max_docs_per_host, max_removed_percent, copies, Scratch(docs.sparkSession, "quality"))[0]


def _normalised_hash(line):
    """line_hash(normalise_line(line)) as a column."""
    folded = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(F.regexp_replace(folded, "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+", " ")
    return F.unhex(F.md5(F.trim(spaced)))


def apply_quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    max_docs_per_host: int = MAX_DOCS_PER_HOST,
    max_removed_percent: int = MAX_REMOVED_PERCENT,
    copies: str = "text",
) -> DataFrame:
    """The documents that are kept, with all their columns, and their texts without the lines above the limit."""
    scratch = Scratch(docs.sparkSession, "quality")
    verdicts, found = _judged(docs, id_col, text_col, host_col, max_docs_per_host, max_removed_percent, copies, scratch)
    kept = scratch.save(verdicts.where("kept").select(*KEY, "host").distinct(), "kept")
    gone = scratch.save(found.groupBy(*KEY, "host").agg(F.collect_set("h").alias("gone")), "gone")  # at most a text's lines
    scratch.keep_only("kept", "gone")
    names = dict(zip(KEY, row_key(id_col, text_col)), host=F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")
    keyed = docs.select(own, *[v.alias(k) for k, v in names.items()])
    joined = keyed.join(kept, [*KEY, "host"], "left_semi").join(gone.hint("merge"), [*KEY, "host"], "left")
    text = F.col("own")[text_col]
    without = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("gone", _normalised_hash(x))), "\n")
    changed = F.when(F.col("gone").isNotNull(), without).otherwise(text)
    return joined.select(*[changed.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words"]
    return judge(load_documents(spark, sf_dir)).select(*columns)


#: The same in DuckDB; w: one row per word, l: one row per distinct normalised line.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
t0 AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
stats AS (
  SELECT doc_id, host, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM t0),
w AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM t0),
win AS (
  SELECT doc_id, i, x AS a, lead(x) OVER o AS b, lead(x, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win WHERE c IS NOT NULL),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep WHERE n > 1) GROUP BY 1),
raw AS (SELECT doc_id, host, md5(t) AS x, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT * FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY 1),
norm AS (
  SELECT doc_id, host, x, trim(regexp_replace(regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k
  FROM lines),
l AS (SELECT doc_id, host, x, md5(k) AS h, sum(len(string_split(k, ' '))) AS words FROM norm GROUP BY doc_id, host, x, md5(k)),
above AS (SELECT host, h FROM l GROUP BY 1, 2 HAVING count(DISTINCT x) > 20),
gone AS (SELECT doc_id, sum(words) AS removed FROM l JOIN above USING (host, h) GROUP BY 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND 100 * coalesce(removed, 0) <= 70 * n_words AS kept,
  coalesce(removed, 0)::BIGINT AS n_removed_words
FROM stats LEFT JOIN dup USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
