"""Connected components of an edge table, by minimum labels, pointer jumping and contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: So many edges at most (about 2 MB) are solved in one task, as its steps would each be a job of as many tasks as shuffle partitions.
ALONE = 1 << 17


def _united(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find; a root is the least node of its tree."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    yield pd.DataFrame({"node": list(up), "label": [root(x) for x in up]}, dtype="int64")


def connected_components(edges: DataFrame, scratch: Scratch, name: str, alone: int = 0) -> DataFrame:
    """(node, label) of all nodes of edges (a, b); label: the least node of its component.

    Only each node's links to its least and its greatest neighbour go through the steps, so their work grows with the nodes of a
    group of many links, not with its links. All other edges are then seen once, between the labels found; those that still lead
    from one to another are a graph of at most half as many nodes, which is solved in the same way. A graph of up to alone edges goes to one task.
    """
    if alone and edges.count() <= alone:
        kind = edges.schema["a"].dataType.simpleString()
        return scratch.save(edges.select("a", "b").coalesce(1).mapInPandas(_united, f"node {kind}, label {kind}"), f"{name}-alone")
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-all")
    ends = both.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most"))
    labels = _labels(ends.select("a", F.explode(F.array("least", "most")).alias("b")), scratch, name)
    label_of = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    rest = both.where("a < b").join(label_of, "a").select("x", "b").distinct()
    rest = rest.join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
    rest = scratch.save(rest.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-rest")
    scratch.drop(f"{name}-all")
    if rest.isEmpty():
        return labels
    above = connected_components(rest, scratch, f"{name}-up", alone).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return scratch.save(labels.join(above, "label", "left").select("node", F.coalesce("top", "label").alias("label")), f"{name}-whole")


def _labels(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """connected_components() of few edges a node.

    Each step takes the least label among a node's neighbours, then the label of that label, so the number of steps grows with
    the logarithm of a component's diameter. Partial minima go before each shuffle, and the joins are of written tables, which
    AQE splits where a node has very many edges.
    """
    both = scratch.save(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        least = scratch.save(
            labels.join(near, labels.node == near.a, "left").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")), f"{name}-least-{step}"
        )
        up = least.select(F.col("node").alias("up"), F.col("label").alias("above"))
        jumped = least.join(up, least.label == up.up).select("node", F.least("label", "above").alias("label"), "old")
        found = scratch.save(jumped, f"{name}-{step}")
        changed = not found.where(F.col("label") != F.col("old")).isEmpty()
        labels = found.select("node", "label")
        scratch.drop(f"{name}-least-{step}")
        scratch.drop(f"{name}-{step - 1}")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
