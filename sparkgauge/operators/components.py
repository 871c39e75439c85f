"""Connected components of many graphs at once, whatever the size of one.

Graphs are told apart by a key.  The edges of a graph that fits a task meet there, and a
union-find counts its components.  Larger graphs are contracted by all tasks together: in each
round a node goes to the one of its neighbours and itself that a hash of the round puts first,
and edges go along.  Such a round leaves a fixed part of the nodes, so all rounds together read and write
little more than the first; what is left of a graph that fits a task then is
settled there.  Nodes with very many edges would be one task's work in the join with
where they go: there are fewer than HUBS of these by the definition of the bound, so
that goes to all tasks and their edges stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import remove, stored

#: Vertices and edges of a graph that one task takes; some hundred MB.
TASK = 2_000_000
#: Graphs whose counts are one batch.
BATCH = 10_000
#: Nodes with more than a HUBS-th of all edge ends are hubs.
HUBS = 1000
#: Rounds; a few times the logarithm of the number of nodes is enough, so that more is an error.
ROUNDS = 100


class Sets:
    """Disjoint sets of names."""

    def __init__(self, names=()):
        self.parent = {n: n for n in names}

    def root(self, x: str) -> str:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, edges: list[tuple[str, str]]) -> None:
        for a, b in edges:
            self.parent[self.root(a)] = self.root(b)


def union_find(edges: list[tuple[str, str]], nodes: list[str]) -> int:
    """Number of components among the nodes."""
    sets = Sets(nodes)
    sets.link(edges)
    return len({sets.root(n) for n in nodes})


def counted_in_tasks(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, components) of graphs that fit a task and have vertices, which are rows without ``dst``.

    A task takes its graphs one after the other from one stream in the order of the key, as a call for each would
    cost more than most of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def ends() -> Iterator[tuple]:
            for b in batches:
                types[:] = b.schema.types[: len(key)]
                *keys, src, dst = (c.to_pylist() for c in b.columns)
                yield from zip(zip(*keys), src, dst)

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [*types, pa.int64()])], [*key, "components"])

        found = []
        for k, graph in groupby(ends(), itemgetter(0)):
            nodes, edges = [], []
            for _, s, d in graph:
                if d is None:
                    nodes.append(s)
                else:
                    edges.append((s, d))
            found.append((*k, union_find(edges, nodes)))
            if len(found) == BATCH:
                yield made(found)
                found = []
        if found:
            yield made(found)

    kinds = {f.name: f.dataType for f in rows.schema}
    schema = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in key)
    dealt = rows.select(*key, "src", "dst").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, f"{schema}, components long").where("components > 0")


def led_in_tasks(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, label) as ``led`` gives them, of graphs (key, u, v) that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def ends() -> Iterator[tuple]:
            for b in batches:
                types[:] = b.schema.types
                *keys, u, v = (c.to_pylist() for c in b.columns)
                yield from zip(zip(*keys), u, v)

        for k, graph in groupby(ends(), itemgetter(0)):
            sets = Sets()
            sets.link([(u, v) for _, u, v in graph])
            found = [(*k, n, r) for n in [*sets.parent] if (r := sets.root(n)) != n]
            for i in range(0, len(found), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found[i : i + BATCH]), types)], [*key, "node", "label"])

    kinds = {f.name: f.dataType for f in edges.schema}
    schema = ", ".join(f"`{k}` {kinds[k].simpleString()}" for k in key)
    return edges.select(*key, "u", "v").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, f"{schema}, node string, label string")


def moved(rows: DataFrame, steps: DataFrame, key: list[str], end: str, most: int) -> DataFrame:
    """The edges with an end of theirs where its step leads; ends with more than ``most`` edges meet their steps by broadcast."""
    hubs = F.broadcast(steps.where(F.col("n") > most).select(*key, F.col("node").alias(end), F.col("goal").alias("at_hub")))  # fewer than HUBS rows
    others = steps.where(F.col("n") <= most).select(*key, F.col("node").alias(end), "goal")
    dealt = rows.join(hubs, [*key, end], "left")
    rest = dealt.where("at_hub is null").drop("at_hub").join(others, [*key, end])
    return rest.unionByName(dealt.where("at_hub is not null").withColumnRenamed("at_hub", "goal")).drop(end).withColumnRenamed("goal", end)


def led(edges: DataFrame, key: list[str], task: int = TASK) -> DataFrame:
    """(key, node, label): every node but one of each component, with that one."""
    pair = lambda rows, a, b: rows.select(*key, F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct()
    state, levels = stored(pair(edges, "src", "dst"), "edges"), []
    while True:
        total, largest = state.groupBy(*key).count().agg(F.sum("count"), F.max("count")).first()
        if not total or largest <= task:
            break
        if len(levels) == ROUNDS:
            raise RuntimeError("the components did not settle")
        ranked = lambda c: F.struct(F.xxhash64(F.lit(len(levels)), *key, c).alias("rank"), F.col(c).alias("name"))
        both = state.unionByName(state.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy(*key, "u").agg(F.min(ranked("v")).alias("first"), F.count("*").alias("n"))
        steps = stored(first.select(*key, F.col("u").alias("node"), F.least("first", ranked("u"))["name"].alias("goal"), "n"), "steps")
        most = max(1, 2 * total // HUBS)
        after = stored(pair(moved(moved(state, steps, key, "u", most), steps, key, "v", most), "u", "v"), "edges")
        remove(state)
        state = after
        levels.append(steps)
    labels = led_in_tasks(state, key)
    for steps in reversed(levels):  # names of a round are those of groups: a node may go while others come to its name
        goals = stored(labels, "labels").withColumnRenamed("node", "goal")
        labels = steps.join(goals, [*key, "goal"], "left").select(*key, "node", F.coalesce("label", "goal").alias("label"))
    return labels.where("node != label")


def contracted(edges: DataFrame, key: list[str], task: int = TASK) -> DataFrame:
    """(key, node, label): every node that is not the least of its component, with the least."""
    found = stored(led(edges, key, task), "labels")
    lows = stored(found.groupBy(*key, "label").agg(F.least(F.col("label"), F.min("node")).alias("low")), "lows")
    whole = found.join(lows, [*key, "label"]).select(*key, "node", "low").unionByName(lows.select(*key, F.col("label").alias("node"), "low"))
    return whole.where("node != low").withColumnRenamed("low", "label")


def counted_by_rounds(rows: DataFrame, key: list[str], task: int = TASK) -> DataFrame:
    """(key, components) of graphs of any size; vertices are rows without ``dst``."""
    labels = led(rows.where("dst is not null"), key, task)
    nodes = rows.where("dst is null").select(*key, F.col("src").alias("node")).distinct()
    label = F.coalesce("label", "node").alias("label")
    return nodes.join(labels, [*key, "node"], "left").select(*key, label).distinct().groupBy(*key).agg(F.count("*").alias("components"))


def count_components(vertices: DataFrame, edges: DataFrame, key: list[str], task: int = TASK) -> DataFrame:
    """(key, components): among the ``name`` of vertices, linked by edges ``src``, ``dst``; both ends of an edge may be helpers that no vertex bears.

    Keys are not null.  Vertices and edges are written once, as their numbers by key decide who counts them.
    """
    rows = vertices.select(*key, F.col("name").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(edges.where("src is not null and dst is not null").select(*key, "src", "dst"))
    rows = stored(rows, "graphs")
    sizes = stored(rows.groupBy(*key).count().where(F.col("count") > task).select(*key), "sizes")
    if sizes.isEmpty():
        return counted_in_tasks(rows, key)
    sizes = F.broadcast(sizes)  # a row for each so many of the rows at most, so that no graph is exchanged by its key
    large, rest = rows.join(sizes, key, "left_semi"), rows.join(sizes, key, "left_anti")
    return counted_in_tasks(rest, key).unionByName(counted_by_rounds(large, key, task))
