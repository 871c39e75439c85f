"""Components by stars, and by tasks, against a union-find over everything."""

import random

import pytest

from sparkgauge.operators import components


def graphs(seed):
    r = random.Random(seed)
    vertices, edges = [], []
    for t in range(6):
        names = [f"n{i}" for i in range(r.randint(1, 60))]
        vertices += [(t, f"m:{n}") for n in names] + [(t, "m:n0")]
        edges += [(t, f"m:{r.choice(names)}", f"{r.choice('mp')}:{r.choice(names)}") for _ in range(r.randint(0, 60))]
    vertices += [(7, f"m:{i:05}") for i in range(600)] + [(8, f"m:{i:03}") for i in range(300)] + [(9, "m:alone")]
    edges += [(7, f"m:{i:05}", f"m:{i + 1:05}") for i in range(599)]  # a long chain
    edges += [(8, f"m:{i:03}", "p:hub") for i in range(290)] + [(8, "m:001", "m:001"), (8, "m:001", None), (10, "p:a", "p:b")]
    r.shuffle(edges)
    return vertices, edges


def expected(vertices, edges):
    keys = {t for t, _ in vertices}
    return {t: components.union_find([(a, b) for k, a, b in edges if k == t and b], sorted({n for k, n in vertices if k == t})) for t in keys}


@pytest.mark.parametrize("task, hubs", [(components.TASK, 1000), (100, 3), (0, 1000)])
def test_counts_at_any_bound(spark, monkeypatch, task, hubs):
    monkeypatch.setattr(components, "HUBS", hubs)
    vertices, edges = graphs(3)
    v, e = spark.createDataFrame(vertices, "t long, name string"), spark.createDataFrame(edges, "t long, src string, dst string")
    got = {r.t: r.components for r in components.count_components(v, e, ["t"], task).collect()}
    assert got == expected(vertices, edges)


def test_labels_are_the_least_nodes(spark):
    _, edges = graphs(5)
    got = {(r.t, r.node): r.label for r in components.contracted(spark.createDataFrame([e for e in edges if e[2]], "t long, src string, dst string"), ["t"]).collect()}
    assert got[7, "m:00599"] == "m:00000" and got[8, "p:hub"] == "m:000" and got[10, "p:b"] == "p:a"
    assert all(label < node and (t, label) not in got for (t, node), label in got.items())


def test_no_graphs(spark):
    v, e = spark.createDataFrame([], "t long, name string"), spark.createDataFrame([], "t long, src string, dst string")
    assert components.count_components(v, e, ["t"]).count() == 0 and components.count_components(v, e, ["t"], -1).count() == 0


def test_graphs_stream_through_tasks(spark, monkeypatch):
    """Graphs that reach over batches, with keys of several columns; no call for each of them."""
    monkeypatch.setattr(components, "BATCH", 2)
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    vertices, edges = graphs(11)
    rows = [(t % 3, f"k{t}", a, None) for t, a in vertices] + [(t % 3, f"k{t}", a, b) for t, a, b in edges if b]
    random.Random(2).shuffle(rows)
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        found = components.counted_in_tasks(spark.createDataFrame(rows, "part int, name string, src string, dst string"), ["part", "name"])
        assert {r.name: r.components for r in found.collect()} == {f"k{t}": n for t, n in expected(vertices, edges).items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_levels_read_counts_that_are_there(spark):
    """Two sums over the counts of components do not count twice."""
    from sparkgauge.queries import cohesion_level_summary

    out = cohesion_level_summary(spark, "/root/testdata/sf0.001")
    assert "InArrow" not in out._jdf.queryExecution().toString() and out.count() > 0


def test_labels_of_rounds_and_tasks(spark):
    """Every bound gives the same least nodes, and rounds leave edges that get fewer."""
    _, edges = graphs(5)
    rows = spark.createDataFrame([e for e in edges if e[2]], "t long, src string, dst string")
    found = [{(r.t, r.node): r.label for r in components.contracted(rows, ["t"], task).collect()} for task in (components.TASK, 40, 0)]
    assert found[0] == found[1] == found[2] and found[0][7, "m:00599"] == "m:00000"


def test_rounds_shrink(spark, monkeypatch):
    """What a round leaves is a part of what it was given: all rounds write little more than the first."""
    sizes, stored = [], components.stored

    def counted(df, tag):
        out = stored(df, tag)
        if tag == "edges":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(components, "stored", counted)
    chain = spark.range(2000).selectExpr("1 as t", "concat('m', id) as src", "concat('m', id + 1) as dst")
    assert components.led(chain, ["t"], 0).count() == 2000
    assert sizes[0] == 2000 and sum(sizes) < 4 * sizes[0] and all(a > b for a, b in zip(sizes, sizes[1:]))
