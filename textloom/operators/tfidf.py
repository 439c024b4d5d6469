"""Term weights of word n-grams and the similarity join over them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import STOP_WORDS
from ..storage import Tables


_WORD = re.compile(r"\w{2,}")  # Python's \w: letters, numbers, underscore
#: So many terms are counted in a task before their counts are given away.
HELD = 200_000
#: Counters of terms, by a hash of so many bits, in chunks; hashes of words that a task keeps.
COUNTER_BITS, CHUNK, KNOWN = 21, 1 << 13, 500_000
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _words(text: str | None, stop_words: frozenset[str]) -> list[str]:
    return [x for x in _WORD.findall(text or "") if x not in stop_words]


def _grams(text: str | None, sizes: tuple[int, ...], stop_words: frozenset[str]) -> list[str]:
    w = _words(text, stop_words)
    return [g for k in sizes for g in map(" ".join, zip(*(w[i:] for i in range(k))))]


class _Hashes(dict):
    """64-bit hashes of words, the same in all tasks."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def _counters(words: list[str], sizes: tuple[int, ...], hashes: _Hashes) -> list[np.ndarray]:
    """For each size, the counters of a text's n-grams in their order."""
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = []
    for k in sizes:
        n = max(len(h) - k + 1, 0)
        x = np.zeros(n, np.uint64)
        for i in range(k):
            x = (x ^ h[i : i + n]) * _STEP
            x ^= x >> np.uint64(29)
        out.append((x * _STEP >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
    return out


def _add_counts(chunks: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in chunks["counts"])
    return pd.DataFrame({"chunk": [int(chunks["chunk"].iloc[0])], "counts": [np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()]})


def counter_totals(df: DataFrame, content: str = "content", sizes: tuple[int, ...] = (2, 3), stop_words: list[str] = STOP_WORDS) -> np.ndarray:
    """Occurrences of n-grams by counter: of no term there are more than its counter says. As large for any corpus."""
    stop = frozenset(stop_words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, hashes = np.zeros(1 << COUNTER_BITS, np.int64), _Hashes()
        for b in batches:
            held, size = [], 0
            for k, text in enumerate(b["t"]):
                own = _counters(_words(text, stop), sizes, hashes)
                held += own
                size += sum(map(len, own))
                if size > 1 << 21 or k == len(b) - 1:
                    total += np.bincount(np.concatenate(held), minlength=len(total))
                    held, size = [], 0
        chunks = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(-1, CHUNK)
        yield pd.DataFrame([(i, c.tobytes()) for i, c in enumerate(chunks) if c.any()], columns=["chunk", "counts"])

    chunks = df.select(F.lower(F.col(content)).alias("t")).mapInPandas(count, "chunk int, counts binary").groupBy("chunk").applyInPandas(_add_counts, "chunk int, counts binary")
    out = np.zeros((1 << COUNTER_BITS) // CHUNK * CHUNK, np.int32).reshape(-1, CHUNK)
    for r in chunks.toLocalIterator():
        out[r.chunk] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def ngrams(df: DataFrame, content: str = "content", sizes: tuple[int, ...] = (2, 3), stop_words: list[str] = STOP_WORDS, counters: np.ndarray | None = None) -> DataFrame:
    """(term, df, cf), to be added up by term: documents and occurrences of n-grams of lower-cased words of two characters or more, stop words left out first.

    Counted in Python, where a word costs a fraction of what it does in Spark's functions of arrays. counters: only terms of these are counted.
    """
    stop = frozenset(stop_words)
    packed = None if counters is None else df.sparkSession.sparkContext.broadcast(np.packbits(counters))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, every, hashes = Counter(), Counter(), _Hashes()
        wanted = None if packed is None else np.unpackbits(packed.value).view(bool)

        def given():
            out = pd.DataFrame({"term": list(every), "df": [docs[t] for t in every], "cf": list(every.values())})
            docs.clear(), every.clear()
            return out

        for b in batches:
            for text in b["t"]:
                if wanted is None:
                    own = _grams(text, sizes, stop)
                else:
                    w = _words(text, stop)
                    own = [" ".join(w[i : i + k]) for k, at in zip(sizes, _counters(w, sizes, hashes)) for i in np.flatnonzero(wanted[at]).tolist()]
                every.update(own)
                docs.update(set(own))
                if len(every) > HELD:
                    yield given()
        if every:
            yield given()

    return df.select(F.lower(F.col(content)).alias("t")).mapInPandas(count, "term string, df long, cf long")


def term_counts(df: DataFrame, listed: dict[str, int], content: str = "content", ord_col: str = "ord", sizes: tuple[int, ...] = (2, 3), stop_words: list[str] = STOP_WORDS) -> DataFrame:
    """(ord, term, df, tf): how often each document has the listed terms; listed: their df."""
    stop = frozenset(stop_words)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, t, listed[t], n) for o, text in zip(b["ord"], b["t"]) for t, n in Counter(g for g in _grams(text, sizes, stop) if g in listed).items()]
            if rows:
                yield pd.DataFrame(rows, columns=["ord", "term", "df", "tf"])

    texts = df.select(F.col(ord_col).alias("ord"), F.lower(F.col(content)).alias("t"))
    counts = texts.mapInPandas(count, f"ord {dict(texts.dtypes)['ord']}, term string, df long, tf long")
    return counts.repartition("ord").groupBy("ord", "term", "df").agg(F.sum("tf").alias("tf"))


def vocabulary(grams: DataFrame, n_docs: int, max_features: int = 5000, max_df: float = 0.95) -> DataFrame:
    """(term, df, cf) of ngrams' rows: the most frequent terms of the corpus, ties by term, without terms of more than max_df of the documents."""
    stats = grams.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    return stats.where(F.col("df") <= max_df * n_docs).orderBy(F.desc("cf"), "term").limit(max_features)


def listed_terms(df: DataFrame, n_docs: int, content: str, max_features: int, max_df: float, tables: Tables) -> DataFrame:
    """vocabulary() of all terms. Most terms occur once; those that their counters show to be too rare are neither shuffled nor written.

    If so many terms as are wanted occur ``least`` times or more, no term of a counter below that is among them. If fewer do, the rest
    is looked for with a smaller ``least``, at last among all terms.
    """
    totals = counter_totals(df, content)
    at = max(len(totals) - max_features, 0)
    least = int(np.partition(totals, at)[at] - 1.5 * totals.mean())
    while True:
        grams = ngrams(df, content, counters=totals >= least if least > 1 else None)
        listed = tables.save(vocabulary(grams, n_docs, max_features, max_df), "vocabulary")
        found = listed.agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
        if least <= 1 or found.n == max_features and found.cf >= least:
            return listed
        least //= 2


def tfidf_weights(df: DataFrame, content: str = "content", max_features: int = 5000, max_df: float = 0.95, tables: Tables | None = None) -> DataFrame:
    """(ord, term, df, w): raw counts times ln((1 + n) / (1 + df)) + 1, each document's vector of length one."""
    tables = tables or Tables(df.sparkSession, "tfidf")
    n = df.count()
    listed = listed_terms(df, n, content, max_features, max_df, tables)
    # Only terms of the vocabulary are counted by document; the n-grams are made again, which costs less than to shuffle and write all.
    counts = term_counts(df, {r.term: r.df for r in listed.collect()}, content)  # max_features rows at most
    weighed = counts.withColumn("raw", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("ord")))
    return weighed.select("ord", "term", "df", (F.col("raw") / norm).alias("w"))


#: Documents of a term are compared in tiles of about so many by so many.
TILE = 1024


def _tile(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Pairs of a tile (term's place at, blocks x and y, own block b, ord, k: places of terms in ascending order, w: weights).

    Cosines are products of dense blocks over the terms that the tile has. A pair whose first common term is another one is left
    to that term.
    """
    size = np.array([len(k) for k in rows["k"]])
    terms, column = np.unique(np.concatenate(rows["k"].to_numpy()), return_inverse=True)
    dense = np.zeros((len(rows), len(terms)))
    dense[np.repeat(np.arange(len(rows)), size), column] = np.concatenate(rows["w"].to_numpy())
    x, y, b, ord_ = (rows[c].to_numpy() for c in ("x", "y", "b", "ord"))
    left, right = np.flatnonzero(b == x), np.flatnonzero(b == y)
    similarity = dense[left] @ dense[right].T
    i, j = np.nonzero(similarity >= threshold)
    # Within a block either order of a pair is met, between blocks one of them.
    once = ord_[left[i]] < ord_[right[j]] if x[0] == y[0] else np.ones(len(i), bool)
    i, j = i[once], j[once]
    before = np.searchsorted(terms, rows["at"].iloc[0])
    if len(i) and before:
        has = (dense[:, :before] > 0).astype(np.float32)
        new = (has[left] @ has[right].T)[i, j] == 0
        i, j = i[new], j[new]
    p, q = ord_[left[i]], ord_[right[j]]
    return pd.DataFrame({"i": np.minimum(p, q), "j": np.maximum(p, q), "similarity": similarity[i, j]})


def similar_vectors(weights: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """Pairs (i, j, similarity) with a cosine of at least threshold.

    A document's terms go from rare to frequent. If a term is the first that two documents share, their cosine is at most the
    product of the norms that their vectors have from this term on; so a pair that reaches the threshold meets at a term where
    that product does, and a vector goes only to the terms from which on its norm is large enough. This loses no pair, and
    frequent terms, which stand last, get few vectors. Those of a term are compared in tiles, so a task's memory is bounded.
    """
    weights = tables.save(weights, "weights")
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("ord").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
    # rest: the squared norm of this term and all that are more frequent
    least = threshold * threshold - 1e-9
    # Terms by their places in the order: at most max_features rows.
    places = tables.numbered(weights.select("df", "term").distinct(), [F.col("df"), F.col("term")], "place").select("term", F.col("place").cast("int").alias("at"))
    placed = tables.save(weights.withColumn("rest", rest).join(F.broadcast(places), "term").select("ord", "at", "w", "rest"), "placed")
    entries = F.sort_array(F.collect_list(F.struct("at", "w")))
    heads = F.collect_list(F.when(F.col("rest") >= least, F.col("at")))
    vectors = placed.groupBy("ord").agg(entries.alias("v"), heads.alias("heads"))  # max_features entries at most
    vectors = tables.save(vectors.select("ord", F.col("v.at").alias("k"), F.col("v.w").alias("w"), "heads"), "vectors")
    index = vectors.select("ord", "k", "w", F.explode("heads").alias("at"))
    blocks = placed.where(F.col("rest") >= least).groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))
    dealt = index.join(F.broadcast(blocks), "at").withColumn("b", F.pmod(F.xxhash64("ord"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("at", F.least("b", "c").alias("x"), F.greatest("b", "c").alias("y"), "b", "ord", "k", "w")
    return tiles.groupBy("at", "x", "y").applyInPandas(lambda rows: _tile(rows, threshold), "i long, j long, similarity double")
