"""Operator 6, line dedup: a log-template tree of fixed depth.

Each line is a path in the tree: its token count, then its leading tokens (a token with a digit is the wildcard), which leads
to a leaf. In leaves that enough documents reach, places that hold more than ``max_children`` different tokens are variable
fields and become wildcards; a line's template is what remains, provided that at least ``min_constant`` of its tokens are
constant. Otherwise its template is its own masked text. A line of fewer than ``min_tokens`` tokens has too few of them to
generalise: its template is its exact tokens, digits included. Templates that ``min_docs`` documents hold are dropped from all.

Documents of equal text count as one. With ``copies="near"`` near-duplicates (operator 8) do, too, so that a group of near
copies keeps its text for a later stage: of documents that hold a recurring template, those with at least ``SUSPECT`` of their
bytes in such lines are put in near-duplicate classes, and a template must then occur in ``min_docs`` classes. (A document with
less of that loses less than that.)

Tokens are compared by 64-bit hashes, in a leaf's places by 32 bits of them.

Defined cases: a null text has no lines and stays null; lines without a token are kept and never counted; rows of equal id and
text get the same decisions, those of a null id as well; whole texts count, however long; an empty table gives an empty result;
only the id and text columns are read, the others are handed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, KEY_DDL, Scratch, hash_words, load_documents, mix, row_key, text_or_empty
from .near_duplicates import class_members

DEPTH = 3
MIN_TOKENS = 4
MIN_DOCS = 10
MAX_CHILDREN = 4
MIN_CONSTANT = 0.6
SUSPECT = 0.3
#: Tokens with a digit are this one.
WILDCARD = np.uint64(0)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_IS_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
LINES_DDL = f"{KEY_DDL}, line int, size int, leaf long, own long, new_leaf boolean, tokens binary"


def _line_hashes(tokens: np.ndarray, place: np.ndarray, heads: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each line's tokens in order."""
    return mix(np.add.reduceat(mix(tokens + (place + salt).astype(np.uint64) * _STEP), heads) ^ counts.astype(np.uint64))


def parsed(texts: list[bytes], min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> pd.DataFrame:
    """doc (number), line, size, leaf, own template, tokens (four bytes each) of the lines with tokens.

    A short line is a leaf of its own, without places. Tokens are runs of bytes other than ASCII white space.
    """
    data = b"\n".join(texts)
    buf = np.frombuffer(data, np.uint8)
    starts, exact = hash_words(data)
    if not len(starts):
        return pd.DataFrame({"doc": [], "line": [], "size": [], "leaf": [], "own": [], "tokens": []})
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, starts)
    digits = np.concatenate(([0], np.cumsum(_IS_DIGIT[buf])))
    tokens = np.where(np.diff(digits[np.append(starts, len(buf))]) > 0, WILDCARD, exact)
    heads = np.flatnonzero(np.diff(line, prepend=-1))
    counts = np.diff(np.append(heads, len(line)))
    place = np.arange(len(line)) - np.repeat(heads, counts)
    leaf = counts.astype(np.uint64)
    for k in range(depth):
        leaf = mix(leaf * _STEP + np.where(counts > k, tokens[np.minimum(heads + k, len(tokens) - 1)], WILDCARD) + np.uint64(1))
    short = counts < min_tokens
    own = np.where(short, _line_hashes(exact, place, heads, counts, 1 << 32), _line_hashes(tokens, place, heads, counts, 0))
    leaf = np.where(short, own, leaf)
    low = tokens.astype(np.uint32)
    codes = np.where((low == 0) & (tokens != WILDCARD), np.uint32(1), low).astype("<u4").tobytes()
    # A text's lines: those that end within it, and the break that joins it to the next text ends its last.
    ends = np.cumsum([len(t) + 1 for t in texts])
    at = line[heads]
    doc = np.searchsorted(ends, starts[heads], "right")
    first = np.searchsorted(breaks, ends - [len(t) + 1 for t in texts])
    size = np.diff(np.concatenate(([-1], breaks, [len(buf)])))[at] - 1
    cuts = [(4 * h, 4 * (h if x else h + n)) for h, n, x in zip(heads.tolist(), counts.tolist(), short.tolist())]
    return pd.DataFrame({
        "doc": doc, "line": (at - first[doc]).astype(np.int32), "size": size.astype(np.int32), "leaf": leaf.view(np.int64), "own": own.view(np.int64),
        "tokens": [codes[a:b] for a, b in cuts],
    })


def _parse(min_tokens: int, depth: int):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, first, size = [], 0, 0
            for i, text in enumerate(b["text"]):
                texts.append(text.encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size > 1 << 18 or i == len(b) - 1:
                    out = parsed(texts, min_tokens, depth)
                    doc = out.pop("doc").to_numpy(np.int64) + first
                    for place, c in enumerate(KEY):
                        out.insert(place, c, b[c].to_numpy()[doc])
                    out.insert(6, "new_leaf", ~pd.DataFrame({"doc": doc, "leaf": out["leaf"]}).duplicated().to_numpy())
                    yield out
                    texts, first, size = [], i + 1, 0

    return parse


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per place of each line: leaf, place, token code; repeats within the batch go first."""
    for b in batches:
        sizes = b["tokens"].str.len().to_numpy(np.int64) // 4
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
        rows = {"leaf": np.repeat(b["leaf"].to_numpy(), sizes), "place": places.astype(np.int32), "code": np.frombuffer(b"".join(b["tokens"]), "<i4")}
        yield pd.DataFrame(rows).drop_duplicates()


@F.pandas_udf(T.LongType())
def _template(own: pd.Series, tokens: pd.Series, variable: pd.Series, share: pd.Series) -> pd.Series:
    """The line's template: its tokens with the leaf's variable places as wildcards, if enough of them are constant."""
    import xxhash

    out = []
    for o, t, v, s in zip(own, tokens, variable, share):
        codes = np.frombuffer(t, "<i4").copy()
        codes[np.asarray(v, np.int64)] = 0
        constant = np.count_nonzero(codes) >= s * len(codes)
        out.append(xxhash.xxh3_64_intdigest(codes.tobytes(), 6) - (1 << 63) if constant else o)
    return pd.Series(out, dtype="int64")


def recurring_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, min_tokens: int = MIN_TOKENS,
    min_docs: int = MIN_DOCS, max_children: int = MAX_CHILDREN, min_constant: float = MIN_CONSTANT, copies: str = "text",
    scratch: Scratch | None = None,
) -> DataFrame:
    """A row per document that loses lines: key, dropped (the line numbers)."""
    scratch = scratch or Scratch(docs.sparkSession, "templates")
    rows = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    lines = scratch.save(rows.mapInPandas(_parse(min_tokens, depth), LINES_DDL), "lines")
    # A template lies in one leaf, so a leaf of fewer documents holds none that recurs. Spark broadcasts the leaves where they are few.
    leaves = lines.where("new_leaf").groupBy("leaf").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    leaves = scratch.save(leaves.select("leaf"), "leaves")
    reached = scratch.save(lines.join(leaves, "leaf").select(*KEY, "line", "size", "own", "leaf", "tokens"), "reached")
    places = reached.select("leaf", "tokens").mapInPandas(_places, "leaf long, place int, code int").distinct()
    counts = places.where(F.col("code") != 0).groupBy("leaf", "place").agg(F.count("*").alias("n")).where(F.col("n") > max_children)
    variable = scratch.save(counts.groupBy("leaf").agg(F.collect_list("place").alias("variable")), "variable")  # at most a line's tokens
    own = reached.join(variable, "leaf", "left_anti").select(*KEY, "line", "size", F.col("own").alias("template"))
    tree = reached.join(variable, "leaf").select(
        *KEY, "line", "size", _template("own", "tokens", "variable", F.lit(float(min_constant))).alias("template")
    )
    named = scratch.save(own.unionByName(tree), "named")
    scratch.drop("reached")
    recurring = named.groupBy("template").agg(F.count_distinct("k_text").alias("n")).where(F.col("n") >= min_docs).select("template")
    hits = scratch.save(named.join(scratch.save(recurring, "recurring"), "template"), "hits")
    scratch.drop("named")
    if copies == "near":
        sizes = lines.groupBy(*KEY).agg(F.sum("size").alias("all"))
        suspects = hits.groupBy(*KEY).agg(F.sum("size").alias("some")).join(sizes, KEY).where(F.col("some") >= SUSPECT * F.col("all"))
        classes = suspect_classes(docs, suspects, scratch, id_col, text_col)
        held = hits.select("template", *KEY).join(classes, KEY, "left").select("template", F.coalesce("class", "k_text").alias("class"))
        independent = held.groupBy("template").agg(F.count_distinct("class").alias("n")).where(F.col("n") >= min_docs).select("template")
        hits = hits.join(scratch.save(independent, "independent"), "template")
    return hits.groupBy(*KEY).agg(F.collect_set("line").alias("dropped"))


def suspect_classes(docs: DataFrame, suspects: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, class) of the documents among suspects (KEY): the near-duplicate classes of those documents, named by 64-bit hashes."""
    suspects = scratch.save(suspects.select(*KEY).distinct(), "suspects")
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    some = scratch.save(keyed.join(suspects, KEY, "left_semi").select("id", "text"), "suspect-texts")
    near = Scratch(docs.sparkSession, "near")
    classes = class_members(some, "id", "text", scratch=near)
    out = scratch.save(classes.select(*KEY, F.xxhash64("class_id", "class_text").alias("class")).distinct(), "classes")
    near.drop("")
    scratch.drop("suspect-texts")
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All documents with their recurring lines dropped, and n_dropped_lines; options are those of recurring_lines."""
    scratch = Scratch(docs.sparkSession, "templates")
    dropped = scratch.save(recurring_lines(docs, id_col, text_col, scratch=scratch, **options), "dropped")
    scratch.keep_only("dropped")
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("own")
    keyed = docs.select(own, *row_key(id_col, text_col))
    joined = keyed.join(dropped.hint("merge"), KEY, "left")
    text = F.col("own")[text_col]
    without = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    changed = F.when(F.col("dropped").isNotNull(), without).otherwise(text)
    columns = [changed.alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns]
    return joined.select(*columns, F.when(F.col("dropped").isNotNull(), F.size("dropped")).otherwise(0).alias("n_dropped_lines"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: lines dropped, and what is kept."""
    docs = load_documents(spark, sf_dir).select("doc_id", "text")
    kept = dedup_lines(docs)
    text = text_or_empty()
    return kept.select(
        "doc_id",
        F.col("n_dropped_lines").cast("long").alias("n_dropped_lines"),
        F.octet_length(text).cast("long").alias("kept_bytes"),
        F.sha2(text, 256).alias("kept_sha256"),
    )
