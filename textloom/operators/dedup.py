"""Removal of duplicates at three levels: equal keys, similar shingle sets, similar term vectors.

The two similarity levels are greedy and sequential by definition: pairs are visited in order, and of a similar pair the document
of the lower score goes (of equal scores the later one) unless either has gone before. A pair's outcome depends only on pairs of
its own connected component, so each component's pairs are replayed in order by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..storage import Tables

REPLAY_DDL = "i long, j long, similarity double, removed long, kept long, logged boolean"


def exact_duplicates(df: DataFrame, tables: Tables, content: str = "content", ord_col: str = "ord") -> DataFrame:
    """(ord, content_hash of the comparison key, first_ord): the first document of each hash; keepers are their own first.

    Texts are normalised and hashed once; only numbers and hashes are shuffled.
    """
    keys = tables.save(df.select(F.col(ord_col).alias("ord"), F.sha2(X.comparison_key(F.col(content)), 256).alias("content_hash")), "content-hashes")
    first = keys.groupBy("content_hash").agg(F.min("ord").alias("first_ord"))
    return keys.join(first, "content_hash")


def shingle_table(df: DataFrame, content: str = "content", ord_col: str = "ord", n: int = 5) -> DataFrame:
    """(ord, shingles, n): the distinct shingle hashes of each document."""
    t = df.select(F.col(ord_col).alias("ord"), X.word_tokens(F.col(content)).alias("t"))
    s = t.select("ord", X.shingles(F.col("t"), n).alias("shingles"))
    return s.withColumn("n", F.size("shingles"))


def equal_sets(sets: DataFrame, tables: Tables) -> DataFrame:
    """(ord, first_ord): documents with equal shingle sets have the first of them in common. Sets are told by SHA-256 of all their hashes in order, and only that is shuffled."""
    keyed = tables.save(sets.select("ord", F.sha2(F.sort_array("shingles").cast("string"), 256).alias("s")), "set-keys")
    first = keyed.groupBy("s").agg(F.min("ord").alias("first_ord"))
    return tables.save(keyed.join(first, "s").select("ord", "first_ord"), "equal-sets")


def similar_sets(sets: DataFrame, threshold: float, tables: Tables) -> DataFrame:
    """Pairs (i, j), i < j, of different sets with Jaccard similarity of at least threshold, similarity beside them.

    sets: (ord, shingles, n), one row for each set, as equal_sets gives them. Prefix filtering, which loses no pair: with hashes
    in ascending order of their frequency, a pair that reaches t shares one of its first n - ceil(t n) + 1 hashes on either side;
    of the pairs that share one, those go whose rests are too short to reach t.
    """
    flat = sets.where("n > 0").select(F.col("ord").alias("node"), "n", F.explode("shingles").alias("h"))
    # One shuffle by hash counts them and keeps who has them. Hashes of one set only go: they stand first in the order and match
    # nothing, so just their number counts, and what two sets have in common is among the others.
    df = flat.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    shared = df.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    need = F.ceil(F.col("n") * threshold - 1e-9)
    shared = tables.save(shared.where(F.size("s") >= need).select("node", "n", F.col("s.h").alias("s")), "shared")
    own = F.col("n") - F.size("s")
    prefix = F.slice("s", 1, F.greatest(F.col("n") - need + 1 - own, F.lit(0)).cast("int"))
    prefix = shared.select("node", "n", own.alias("own"), F.posexplode(prefix).alias("k", "h"))
    prefix = tables.save(prefix.select("node", "n", (F.col("n") - F.col("own") - F.col("k")).alias("rest"), "h"), "prefix")
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = F.least("a.rest", "b.rest") >= threshold / (1 + threshold) * (F.col("a.n") + F.col("b.n")) - 1e-9
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.node") < F.col("b.node")) & fits)
    pairs = pairs.select(F.col("a.node").alias("i"), F.col("b.node").alias("j")).distinct()
    left, right = shared.toDF("i", "ni", "si"), shared.toDF("j", "nj", "sj")
    common = F.size(F.array_intersect("si", "sj"))
    near = pairs.join(left, "i").join(right, "j").withColumn("similarity", common / (F.col("ni") + F.col("nj") - common))
    return near.where(F.col("similarity") >= threshold).select("i", "j", "similarity")


def _stars(batches: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Edges (i, j) as edges from the least node of each part that they connect; after so many nodes it begins anew."""
    root: dict = {}

    def find(x):
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def stars():
        return pd.DataFrame([(find(x), x) for x in list(root) if find(x) != x], columns=["i", "j"], dtype="int64")

    for b in batches:
        for i, j in zip(b["i"].tolist(), b["j"].tolist()):
            a, c = find(i), find(j)
            root[max(a, c)] = min(a, c)
        if len(root) > most:
            yield stars()
            root.clear()
    yield stars()


def component_labels(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, label): the least node of each connected component, by minimum labels and pointer jumping.

    Each task joins its own edges to stars first, which leaves fewer edges and short ways.
    """
    edges = tables.save(edges.select("i", "j").where("i <> j").mapInPandas(_stars, "i long, j long"), f"{name}-stars")
    both = tables.save(edges.select("i", "j").union(edges.select("j", "i")).toDF("a", "b").distinct(), f"{name}-edges")
    labels, step = tables.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0"), 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        least = tables.save(least, f"{name}-least-{step}")
        up = least.select(F.col("node").alias("up"), F.col("label").alias("above"))
        labels = tables.save(least.join(up, least.label == up.up).select("node", F.least("label", "above").alias("label"), "old"), f"{name}-{step}")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def replay(pairs: pd.DataFrame, gone: set | None = None) -> pd.DataFrame:
    """Visits whole components' pairs in order; columns i, j, similarity, q_i, q_j. gone: documents removed by the pairs before these."""
    gone = set() if gone is None else gone
    rows = []
    for p in pairs.sort_values(["i", "j"]).itertuples(index=False):
        if p.i in gone or p.j in gone:
            continue
        removed, kept, logged = (p.j, p.i, True) if p.q_i >= p.q_j else (p.i, p.j, False)
        gone.add(removed)
        rows.append((p.i, p.j, p.similarity, removed, kept, logged))
    return pd.DataFrame(rows, columns=["i", "j", "similarity", "removed", "kept", "logged"])


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    gone: set = set()
    for b in batches:
        if len(done := replay(b, gone)):
            yield done


def greedy_removals(pairs: DataFrame, scores: DataFrame, tables: Tables, name: str) -> DataFrame:
    """Removals (i, j, similarity, removed, kept, logged) by component; scores: (ord, score).

    A task replays all its components in one stream of sorted pairs, and holds no component whole.
    """
    pairs = tables.save(pairs, f"{name}-pairs")
    labels = component_labels(pairs, tables, name)
    q_i, q_j = scores.toDF("i", "q_i"), scores.toDF("j", "q_j")
    full = pairs.join(labels.withColumnRenamed("node", "i"), "i").join(q_i, "i").join(q_j, "j")
    return full.repartition("label").sortWithinPartitions("i", "j").mapInPandas(_replayed, REPLAY_DDL)


def expanded(pairs: DataFrame, equal: DataFrame) -> DataFrame:
    """Pairs of all documents: those between sets go for all that have them, and documents of equal sets are similar by 1.

    Only for the greedy visit, which is defined on such pairs: it comes after exact duplicates are gone, when few sets are equal.
    """
    x, y = equal.toDF("x", "i"), equal.toDF("y", "j")
    between = pairs.join(x, "i").join(y, "j").select("x", "y", "similarity")
    same = equal.toDF("x", "first_ord").join(equal.toDF("y", "first_ord"), "first_ord").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    every = between.unionByName(same)
    return every.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "similarity")


def fuzzy_pairs(sets: DataFrame, threshold: float, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Similar pairs between the first documents of equal sets, and equal_sets' membership."""
    equal = equal_sets(sets, tables)
    return similar_sets(sets.join(equal.where("ord = first_ord").select("ord"), "ord", "left_semi"), threshold, tables), equal


def fuzzy_removals(df: DataFrame, tables: Tables, threshold: float = 0.85, content: str = "content", score: str = "overall_score") -> DataFrame:
    sets = tables.save(shingle_table(df, content), "sets")
    return greedy_removals(expanded(*fuzzy_pairs(sets, threshold, tables)), df.select("ord", score), tables, "fuzzy")


def semantic_removals(df: DataFrame, tables: Tables, threshold: float = 0.80, content: str = "content", score: str = "overall_score") -> DataFrame:
    from .tfidf import similar_vectors, tfidf_weights

    pairs = similar_vectors(tfidf_weights(df, content, tables=tables), threshold, tables)
    return greedy_removals(pairs, df.select("ord", score), tables, "semantic")
