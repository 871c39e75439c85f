"""Summaries after any batches in any order are those of one pass; state outlives the query."""

import random

import pytest

from sparkgauge.streaming.summaries import follow, summaries, summaries_at_once

SCHEMA = "file_path string, version long, cyclomatic long, cognitive long, deleted boolean"


def rows(seed):
    r = random.Random(seed)
    out = [(f"f{r.randrange(12)}", r.randrange(4), r.randint(1, 9), r.randint(0, 20), False) for _ in range(300)]
    return out + [(f"f{k}", r.randrange(5), None, None, True) for k in range(6)] + [("only deleted", 1, None, None, True), ("back again", 1, None, None, True), ("back again", 2, 3, 4, False)]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches(spark, tmp_path, seed):
    every, r = rows(seed), random.Random(seed)
    want = sorted(map(tuple, summaries_at_once(spark.createDataFrame(every, SCHEMA)).select("file_path", "version", "total_functions", "total_cyclomatic", "max_cognitive", "avg_cyclomatic").collect()))
    r.shuffle(every)
    source, out, check = (str(tmp_path / x) for x in ("source", "out", "check"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    for k in range(4):  # two batches a run, then a new query with the same checkpoint
        spark.createDataFrame(every[k::4], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k % 2:
            query = follow(stream(), out, check)
            query.awaitTermination(240)
            assert query.exception() is None
    got = summaries(spark, out)
    assert sorted(map(tuple, got.select("file_path", "version", "total_functions", "total_cyclomatic", "max_cognitive", "avg_cyclomatic").collect())) == want
    assert "only deleted" not in {x[0] for x in want} and ("back again", 2) in {x[:2] for x in want}
