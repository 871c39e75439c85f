"""Every query that has an oracle gives the oracle's rows."""

import os

import duckdb
import pytest

from sparkgauge.queries import CASES, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    return sorted((tuple(None if x is None else round(float(x), 9) if isinstance(x, (int, float)) else str(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


CASE_QUERIES = {f.__name__: (f, sql) for f, sql in CASES.items()}


@pytest.mark.parametrize("name", sorted({**ORACLES, **CASE_QUERIES}))
def test_oracle(spark, duck, name):
    query, oracle = CASE_QUERIES[name] if name in CASE_QUERIES else (QUERIES[name], ORACLES[name])
    got = query(spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(oracle)
    assert sorted(want.columns) == columns
    assert plain(got.select(columns).collect()) == plain(want.select(", ".join(columns)).fetchall())


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators():
    """Whatever of them is missing, the other queries stand."""
    import subprocess
    import sys

    for missing in ("sparkgauge.llm", "ahocorasick", "corpus_pipeline"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()))"
        here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        done = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True)
        assert done.stdout.strip() == str(len(QUERIES)), done.stderr
