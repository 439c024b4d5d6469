"""Operator 9, suffix-array dedup: bytes covered by a window of 100 bytes that also starts earlier are removed.

1. Anchors. In every window the least 32-byte hash marks an anchor, so equal windows hold equal anchors at equal places, and a
   window can only repeat if an anchor of it occurs twice. Anchors that occur once are left out: this loses no repeat.
2. Contexts. An anchor's context is all bytes of the windows that it marks. Copies of one context collapse into the earliest
   before anything is shuffled by content; in a later copy every window repeats, so it is removed whole.
3. Shards. The different contexts of an anchor meet in one shard. A shard's suffix array (Larsson-Sadakane) and common prefixes
   (Kasai) give its classes of equal windows; in each class all but the earliest repeat.
4. Merging. An anchor with very many contexts is split over several shards. Their sorted lists of distinct windows are merged by
   binary search, by ranges of the windows' hash, and windows that an earlier shard's text also holds repeat.

Order is that of (doc_id, start). Contexts are compared by 128 bits of hashes (anchor and context); windows by their bytes.

Defined cases: a null text is an empty text; texts under 100 bytes lose nothing; rows of equal id go by their text's hash, and
rows equal in both are one document and get the same result; a null doc_id sorts first; an empty table gives an empty result;
columns other than id and text are only handed through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, Scratch, load_documents, mix, row_key, text_or_empty
from .suffix_array import common_prefixes, suffix_array, window_classes

WINDOW = 100
ANCHOR = 32
REACH = WINDOW - ANCHOR  # bytes around an anchor that its windows may hold on either side
SIZE_BITS = 8  # a context's place is kept as its start, shifted by these, and its size (at most ANCHOR + 2 * REACH)
SHARD_CONTEXTS = 4096
SPLIT_CONTEXTS = 2048
RANGE_WINDOWS = 8192
_FACTORS = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
ANCHORS_DDL = "anchor long, context long, doc long, at long"


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each run of width values, by doubling; the result is width - 1 shorter."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, context hash, text number, the context's place) of all anchors of some texts."""
    texts_at = [i for i, t in enumerate(texts) if len(t) >= WINDOW]
    if not texts_at:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    data = np.frombuffer(b"".join(texts[i] for i in texts_at), np.uint8)
    sizes = np.array([len(texts[i]) for i in texts_at], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h, reach = data.astype(np.uint64) + np.uint64(1), 1
    for f in _FACTORS:
        h = h[:-reach] * f + h[reach:]
        reach *= 2
    h = mix(h)  # of 32 bytes from each place on, across texts too: those only matter in windows that are left out
    least = _sliding(h, REACH + 1, np.minimum)
    real = np.ones(len(least), bool)  # windows within one text
    inner = ends[:-1]
    real[(inner[:, None] - np.arange(1, WINDOW)).ravel()] = False
    least[~real] = 0
    padded = np.zeros(len(least) + 2 * REACH, np.uint64)
    padded[REACH : REACH + len(least)] = least
    at = np.flatnonzero(_sliding(padded, REACH + 1, np.maximum) == h)
    text = np.searchsorted(ends, at, "right")
    # The windows that hold an anchor as their least hash start next to each other.
    marks = np.lib.stride_tricks.sliding_window_view(padded, REACH + 1)[at] == h[at][:, None]
    a = at - REACH + marks.argmax(1)
    b = a + marks.sum(1) - 1 + WINDOW
    context = (b - a).astype(np.uint64) * _FACTORS[0] + (at - a).astype(np.uint64)
    for j in range(6):  # 6 x 32 bytes cover every context
        context = mix(context * _FACTORS[1] + h[np.minimum(a + ANCHOR * j, b - ANCHOR)])
    return h[at].view(np.int64), context.view(np.int64), np.array(texts_at)[text], (a - starts[text] << SIZE_BITS) + b - a


def _groups(b: pd.DataFrame, limit: int = 1 << 17):  # arrays of this many places stay in the processor's cache
    docs, texts, size = [], [], 0
    for doc, t in zip(b["doc"].tolist(), b["text"]):
        docs.append(doc)
        texts.append(t.encode("utf-8", "surrogatepass"))
        size += len(texts[-1])
        if size >= limit:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _count_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [anchors_of(texts)[0] for _, texts in _groups(b)]
        anchor, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
        yield pd.DataFrame({"anchor": anchor, "n": n}, dtype="int64")


def _list_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for docs, texts in _groups(b):
            anchor, context, no, at = anchors_of(texts)
            yield pd.DataFrame({"anchor": anchor, "context": context, "doc": np.array(docs, np.int64)[no], "at": at})


def _cut_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc, text, wanted in zip(b["doc"], b["text"], b["wanted"]):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                lo = w["at"] >> SIZE_BITS
                rows.append((w["anchor"], doc, lo, data[lo : lo + w["at"] % (1 << SIZE_BITS)]))
        yield pd.DataFrame(rows, columns=["anchor", "doc", "lo", "bytes"]).astype({"anchor": "int64", "doc": "int64", "lo": "int32"})


FOUND_DDL = "doc long, lo int, hi int, anchor long, gram binary"


def _runs(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Spans of windows that start next to each other."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(doc))[: len(first)] - 1
    return pd.DataFrame({"doc": doc[first], "lo": start[first].astype(np.int32), "hi": (start[last] + WINDOW).astype(np.int32), "anchor": 0, "gram": None})


def shard_repeats(group: pd.DataFrame) -> pd.DataFrame:
    """The windows of one shard that repeat within it, as spans; of a split anchor also its distinct windows, in order."""
    parts = group["bytes"].tolist()
    text = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    order = suffix_array(text)
    lcp = common_prefixes(text, order, ends - sizes, ends, WINDOW)
    classes = window_classes(order, lcp, WINDOW)
    # In the order of suffixes the windows of a class stand together; places are compared by one number, (doc, start).
    at = order[(np.repeat(ends, sizes) - np.arange(len(text)) >= WINDOW)[order]]
    own = np.repeat(np.arange(len(parts)), sizes)[at]
    doc = group["doc"].to_numpy()[own]
    start = group["lo"].to_numpy().astype(np.int64)[own] + at - (ends - sizes)[own]
    docs, number = np.unique(group["doc"].to_numpy(), return_inverse=True)
    place = (number[own] << 32) + start
    new = np.ones(len(at), bool)
    new[1:] = np.diff(classes[at]) != 0
    heads = np.flatnonzero(new)
    first = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(at)))) if len(at) else place
    later = place != first
    found = _runs(doc[later], start[later])
    if not group["split"].iloc[0]:
        return found
    data, least = text.tobytes(), first[heads]
    runs = {"doc": docs[least >> 32], "lo": (least & 0xFFFFFFFF).astype(np.int32), "hi": -1, "anchor": group["anchor"].iloc[0], "gram": [data[i : i + WINDOW] for i in at[heads].tolist()]}
    runs = pd.DataFrame(runs)
    return pd.concat([found, runs])


def _merged(x: tuple, y: tuple) -> tuple[tuple, tuple[np.ndarray, np.ndarray]]:
    """Two sorted lists of distinct windows (grams, docs, starts) as one, with the least place of each; the places that lose."""
    (grams, docs, starts), (other, doc, start) = x, y
    at = np.searchsorted(grams, other)
    known = np.zeros(len(other), bool)
    inside = at < len(grams)
    known[inside] = grams[at[inside]] == other[inside]
    here = at[known]
    d, s = doc[known], start[known]
    earlier = (d < docs[here]) | ((d == docs[here]) & (s < starts[here]))
    same = (d == docs[here]) & (s == starts[here])
    lost = np.where(earlier, docs[here], d)[~same], np.where(earlier, starts[here], s)[~same]
    docs, starts = docs.copy(), starts.copy()
    docs[here], starts[here] = np.where(earlier, d, docs[here]), np.where(earlier, s, starts[here])
    fresh = ~known
    return tuple(np.insert(a, at[fresh], b[fresh]) for a, b in ((grams, other), (docs, doc), (starts, start))), lost


def merge_runs(group: pd.DataFrame) -> pd.DataFrame:
    """Merges the shards' sorted distinct windows by binary search, two lists at a time; windows that an earlier place holds, too, as spans."""
    runs, lost = [], []
    for _, run in group.groupby("shard"):
        grams = np.array([bytes(g) + b"\1" for g in run["gram"]], f"S{WINDOW + 1}")  # a last byte of one, as numpy drops zeros at the end
        order = np.argsort(grams, kind="stable")
        runs.append((grams[order], run["doc"].to_numpy()[order], run["lo"].to_numpy().astype(np.int64)[order]))
    while len(runs) > 1:
        pairs = [_merged(runs[i], runs[i + 1]) for i in range(0, len(runs) - 1, 2)]
        lost += [places for _, places in pairs]
        runs = [run for run, _ in pairs] + runs[len(pairs) * 2 :]
    none = [(np.zeros(0, np.int64),) * 2]
    return _runs(np.concatenate([x for x, _ in lost or none]), np.concatenate([x for _, x in lost or none]))[["doc", "lo", "hi"]]


def document_order(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """docs with ``doc``, a long that ascends with (id, text hash): the id itself where ids are unique and present."""
    keyed = docs.withColumns(dict(zip(KEY, row_key(id_col, text_col))))
    keys = keyed.select(*KEY, F.col(id_col).isNull().alias("none"))
    if keys.groupBy("k_id").agg(F.count("*").alias("n"), F.max("none").alias("none")).where("n > 1 or none").isEmpty():
        return keyed.withColumn("doc", F.col("k_id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbers = keys.select(*KEY).distinct().repartitionByRange(n, *KEY).sortWithinPartitions(*KEY).withColumn("doc", F.monotonically_increasing_id())
    return keyed.join(scratch.save(numbers, "numbers"), KEY)


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, spans) of the documents that lose bytes; docs: (doc, text). Spans may overlap and pass the text's ends."""
    texts = docs.select("doc", text_or_empty("text").alias("text"))
    counts = texts.mapInPandas(_count_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    twice = scratch.save(counts.where("n > 1").select("anchor"), "twice")
    listed = scratch.save(texts.mapInPandas(_list_anchors, ANCHORS_DDL).join(twice, "anchor"), "listed")
    contexts = listed.groupBy("anchor", "context").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
    contexts = scratch.save(contexts, "contexts")
    firsts = contexts.where("n > 1").select("anchor", "context", "first")
    later = listed.join(firsts, ["anchor", "context"]).where((F.col("doc") != F.col("first.doc")) | (F.col("at") != F.col("first.at")))
    lo = F.shiftright("at", SIZE_BITS)
    copies = scratch.save(later.select("doc", lo.cast("int").alias("lo"), (lo + F.col("at") % (1 << SIZE_BITS)).cast("int").alias("hi")), "copies")
    scratch.drop("listed")
    several = scratch.save(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = contexts.join(several.select("anchor"), "anchor").select("first.doc", F.struct("anchor", "first.at").alias("w"))
    wanted = wanted.groupBy("doc").agg(F.collect_list("w").alias("wanted"))
    cut = scratch.save(texts.join(scratch.save(wanted, "wanted"), "doc").mapInPandas(_cut_contexts, "anchor long, doc long, lo int, bytes binary"), "cut")
    for label in ("wanted", "contexts", "twice"):
        scratch.drop(label)
    shards = max(1, -(-total // SHARD_CONTEXTS))
    split = F.col("n") > SPLIT_CONTEXTS
    parts = F.ceil(F.col("n") / SPLIT_CONTEXTS)
    part = F.when(split, F.pmod(F.xxhash64("doc", "lo"), parts)).otherwise(0)
    shard = F.when(split, F.col("anchor")).otherwise(F.pmod("anchor", F.lit(shards)))
    dealt = cut.join(several, "anchor").select("anchor", "doc", "lo", "bytes", split.alias("split"), shard.alias("shard"), part.alias("part"))
    repeats = dealt.groupBy("split", "shard", "part").applyInPandas(_with_shard, f"{FOUND_DDL}, shard long")
    found = scratch.save(repeats, "found")
    scratch.drop("cut")
    # An anchor's windows are as many as its contexts, up to a factor of REACH + 1, and so are the ranges: a range stays small.
    runs = found.where("hi = -1").join(several, "anchor").withColumn("range", F.pmod(F.xxhash64("gram"), F.ceil(F.col("n") * (REACH + 1) / RANGE_WINDOWS)))
    merged = runs.groupBy("anchor", "range").applyInPandas(merge_runs, "doc long, lo int, hi int")
    spans = copies.unionByName(found.where("hi > -1").select("doc", "lo", "hi")).unionByName(merged)
    return spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _with_shard(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    return shard_repeats(group).assign(shard=int(key[2]))


def merged_spans(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs, clipped to the text."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, s["lo"]), min(size, s["hi"])) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def without_spans(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``spans``, the (lo, hi) pairs of bytes that repeat (null: none); columns doc and KEY are added."""
    scratch = Scratch(docs.sparkSession, "repeats")
    ordered = document_order(docs, scratch, id_col, text_col)
    # Rows equal in id and text are one document; where ids are unique nothing is to be done for that.
    spans = scratch.save(repeated_spans(ordered.select("doc", F.col(text_col).alias("text")), scratch), "spans")
    scratch.keep_only("spans", "numbers")
    return ordered.join(spans, "doc", "left")


@F.pandas_udf(T.StringType())
def _keep_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """Text without its spans (null: stays null); characters that lose some of their bytes go whole."""
    out = []
    for t, s in zip(text, spans):
        data = (t or "").encode("utf-8", "surrogatepass")
        out.append(t and without_spans(data, merged_spans(s, len(data))).decode("utf-8", "ignore"))
    return pd.Series(out, dtype=object)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents, repeated bytes removed from their texts."""
    found = find_repeats(docs, id_col, text_col)
    # A Python function sees every row: texts without spans go there as nulls.
    repeats = F.col("spans").isNotNull()
    empty = F.array().cast("array<struct<lo:int,hi:int>>")
    text = F.when(repeats, _keep_text(F.when(repeats, F.col(text_col)), F.coalesce("spans", empty))).otherwise(F.col(text_col))
    return found.withColumn(text_col, text).select(*docs.columns)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text, spans in zip(b["doc_id"], b["text"], b["spans"]):
            data = text.encode("utf-8", "surrogatepass")
            gone = merged_spans(spans if spans is not None else [], len(data))
            kept = without_spans(data, gone)
            rows.append((doc_id, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_repeats(load_documents(spark, sf_dir).select("doc_id", "text"))
    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "spans")
    return rows.mapInPandas(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
