"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is two joins against an aggregate of one row for each node.  Nodes with very many
neighbours, of which there can be only a bounded number, take their side of a join from a
broadcast instead, so none is a skewed key.  Rounds are written to the shared folder, which
keeps lineage short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored

#: A node is a hub if it has this many neighbours and more than a HUBS-th of all, so that there are fewer than HUBS hubs.
HUB, HUBS = 100, 1000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component; as many as nodes at most."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            far = label != np.arange(len(nodes))
            return nodes[far], nodes[label[far]]
        label = new


def with_low(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """``edges`` (a, b) with the column ``low`` of their a from (a, low, n); hubs by broadcast, others by exchange."""
    many = F.col("n") > max(HUB, total // HUBS)
    hubs = F.broadcast(low.where(many).select("a", F.col("low").alias("hub_low")))  # fewer than HUBS rows
    split = edges.join(hubs, "a", "left")
    others = split.where("hub_low is null").select("a", "b").join(low.where(~many).select("a", "low"), "a")
    return others.unionByName(split.where("hub_low is not null").select("a", "b", F.col("hub_low").alias("low")))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); the label is the smallest node of the component.

    Loops, repeated and reversed edges are allowed; an empty table gives an empty result.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(now, "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")).first()
        total = state[0]
        if not total or state == seen:
            break
        if total == state[2] and now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break  # each node has one edge, to one that has none: these are stars already
        seen = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n"))
        large = with_low(both, low, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = with_low(large, low, total).where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = stored(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        remove(now)
        now = after
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
