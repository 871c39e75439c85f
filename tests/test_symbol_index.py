"""A stored index: no exchange of its tables, appends that touch their own buckets, batches that count as a whole."""

import os

import pytest

from sparkgauge.operators.cohesion import index_lcom4
from sparkgauge.plans.symbol_index import MANIFEST, SymbolIndex
from sparkgauge.sources.files import InvalidPathError

SYMBOLS = "usr string, name string, kind string, parent_usr string"
USES = "usr string, role string, container_usr string"


def rows(n, base=0):
    symbols, uses = [], []
    for t in range(base, base + n):
        symbols.append((f"t{t}", f"C{t % 7}", "class" if t % 2 else "struct", None))
        for m in range(6):
            symbols.append((f"m{t}.{m}", f"n{m}", ("instanceMethod", "instanceProperty")[m % 2], f"t{t}"))
        uses += [(f"m{t}.1", "reference", f"m{t}.0"), (f"m{t}.3", "reference", f"m{t}.{2 * (t % 2)}"), (f"m{t}.4", "call", f"m{t}.2")]
    return symbols, uses


def types(spark):
    return spark.createDataFrame([("f", i, f"C{i}", "class" if i % 2 else "struct") for i in range(9)], "file_path string, type_pos int, name string, type string")


def files(folder):
    return {os.path.join(top, f): os.path.getmtime(os.path.join(top, f)) for top, _, names in os.walk(folder) for f in names if f.startswith("part-")}


@pytest.fixture
def index(spark, tmp_path):
    found = SymbolIndex.open(spark, str(tmp_path / "index"), 8)
    symbols, uses = rows(40)
    found.append(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(uses, USES), "first")
    yield found
    found.close()


def test_index_is_joined_where_it_lies(spark, index):
    symbols, uses = (spark.createDataFrame(r, s) for r, s in zip(rows(40), (SYMBOLS, USES)))
    want = sorted(map(tuple, index_lcom4(types(spark), symbols, uses).collect()))
    assert sorted(map(tuple, index.lcom4(types(spark)).collect())) == want and want
    for name, keys in (("symbols", "parent_usr"), ("occurrences", "container_usr"), ("types", "name")):
        one = spark.createDataFrame([("x",)], f"{keys} string")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            grouped = index.table(name).groupBy(*(["name", "kind"] if name == "types" else [keys])).count()
            plan = grouped._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan, plan
            if name != "types":
                plan = index.table(name).join(one, keys)._jdf.queryExecution().executedPlan().toString()
                assert plan.count("hashpartitioning") == 1 and "SelectedBucketsCount" in plan, plan  # of the other side
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.unset("spark.sql.adaptive.enabled")


def test_append_touches_its_own_buckets(spark, index):
    before = files(index.folder)
    symbols, uses = rows(1, 100)
    index.append(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(uses, USES), "second")
    after = files(index.folder)
    assert all(after[f] == t for f, t in before.items())
    new = [f for f in after if f not in before and "/manifest/" not in f]
    assert 0 < len(new) <= 2 + 1 + 3  # a parent and the top, one type, three containers
    assert index.table("symbols").count() == 41 * 7
    index.append(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(uses, USES), "second")  # a batch counts once
    assert index.table("symbols").count() == 41 * 7


def test_what_the_manifest_does_not_name_is_not_there(spark, index, monkeypatch):
    from pyspark.sql import SparkSession

    symbols, uses = (spark.createDataFrame(r, s) for r, s in zip(rows(5, 200), (SYMBOLS, USES)))
    monkeypatch.setattr(SparkSession, "createDataFrame", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        index.append(symbols, uses, "lost")
    monkeypatch.undo()
    assert index.table("symbols").count() == 40 * 7 and index.table("occurrences").count() == 40 * 3
    again = SymbolIndex.open(spark, index.folder, 3)
    assert again.buckets == 8 and again.table("symbols").count() == 40 * 7
    again.append(symbols, uses, "lost")
    assert again.table("symbols").count() == 45 * 7 and [r.batches for r in spark.read.schema(MANIFEST).parquet(f"{index.folder}/manifest").selectExpr("count(*) as batches").collect()] == [2]
    again.close()


def test_a_folder_of_something_else(spark, tmp_path):
    (tmp_path / "file").write_text("x")
    with pytest.raises(InvalidPathError):
        SymbolIndex.open(spark, str(tmp_path))


def test_types_of_one_symbol_share_its_graph(spark, monkeypatch):
    """Many types that find the same symbol make one graph, and answers as by one each."""
    from sparkgauge.operators import cohesion

    symbols, uses = (spark.createDataFrame(r, s) for r, s in zip(rows(14), (SYMBOLS, USES)))
    graphs, count = [], cohesion.count_components
    monkeypatch.setattr(cohesion, "count_components", lambda v, e, key: graphs.append((v.select(*key).distinct().count(), e.count())) or count(v, e, key))
    once = {r.type_pos % 9: r.lcom4 for r in index_lcom4(types(spark), symbols, uses).collect()}
    many = types(spark).crossJoin(spark.range(20)).selectExpr("file_path", "id * 9 + type_pos as type_pos", "name", "type")
    found = index_lcom4(many, symbols, uses).collect()
    assert len(found) == 20 * len(once) and all(r.lcom4 == once[r.type_pos % 9] for r in found)
    assert graphs[0] == graphs[1] and graphs[0][0] <= len(once)
