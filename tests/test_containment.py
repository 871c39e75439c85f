"""Containment by sweeps against a loop over all pairs."""

import collections
import random

import pytest

from sparkgauge.operators import containment
from sparkgauge.operators.containment import containers, nearest_container


def cases(spark, seed, keys, hot=0.0, nested=False):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < hot else r.choice(keys)
    points = [(i, key(), r.choice([r.randint(-50, 50), 7])) for i in range(400)] + [(900, None, 3), (901, "hot", None), (902, "none such", 3), (0, "hot", 7), (0, "hot", 7)]
    spans = []
    for i in range(150):
        a = r.randint(-60, 60)
        spans.append((i, key(), a, a + r.choice([0, 3, 10, 60 if not nested else 40])))
    spans += [(200, "hot", -60, 60), (201, "hot", -60, 60), (202, "hot", 5, 4), (203, None, -60, 60), (204, "hot", None, 9), (205, "hot", 1, None)]
    return points, spans, spark.createDataFrame(points, "id long, k string, at long").repartition(3), spark.createDataFrame(spans, "span_id long, k string, a long, e long").repartition(3)


def holds(p, s):
    return None not in (*p, *s) and p[1] == s[1] and s[2] <= p[2] <= s[3]


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("seed, keys, hot", [(1, ["a", "b", "hot"], 0.0), (2, ["a", "hot"], 0.9), (3, list("abcdefghijklmnop"), 0.3)])
def test_containment(spark, parts, seed, keys, hot):
    points, spans, p, s = cases(spark, seed, keys, hot)
    args = (["k"], "at", "a", "e", "span_id", parts)
    got = collections.Counter((r.id, r.at, r.span.span_id) for r in containers(p, s, *args).collect())
    assert got == collections.Counter((x[0], x[2], y[0]) for x in points for y in spans if holds(x, y))
    near = collections.Counter((r.id, r.k, r.at, r.span and r.span.span_id) for r in nearest_container(p, s, *args).collect())
    best = lambda x: max(((y[2], -y[3], -y[0]) for y in spans if holds(x, y)), default=None)
    assert near == collections.Counter((*x, b and -b[2]) for x in points for b in [best(x)])


def test_empty_tables(spark):
    _, _, p, s = cases(spark, 1, ["a"])
    args = (["k"], "at", "a", "e", "span_id")
    assert containers(p, s.where("false"), *args).count() == 0 and containers(p.where("false"), s, *args).count() == 0
    assert nearest_container(p, s.where("false"), *args).where("span is null").count() == p.count()


def test_a_key_with_most_rows_is_in_many_tasks_and_rows_do_not_multiply(spark):
    """90 % of the rows have one key; long spans reach no more rows than two for each, and one for each task and part."""
    n, parts = 20_000, 16
    p = spark.range(n).selectExpr("id", "if(id % 10 = 0, id, -1) as k", "(id * 7919) % 1000003 as at").repartition(4)
    s = spark.range(2000).selectExpr("id as span_id", "-1L as k", "(id * 104729) % 500000 as a", "(id * 104729) % 500000 + 400000 as e").repartition(4)
    places = containment.placed(p, ["k"], p.at, "p")
    cuts = containment.bounds(places, parts)
    sizes = [r["count"] for r in containment.deal_places(places, cuts).groupBy("part").count().collect()]
    assert len(sizes) == parts and max(sizes) < 3 * n / parts
    opened = containment.placed(s, ["k"], s.a, "s").selectExpr("h", "key", "at", "s.e as end", "s.span_id as id", "s")
    assert containment.deal_spans(opened, cuts, True).count() <= 2 * 2000 + 4 * parts
    plan = nearest_container(p, s, ["k"], "at", "a", "e", "span_id")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
