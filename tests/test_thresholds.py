"""Rules by tries, and beyond their bound by exchange, against a loop over all rules."""

import random
import time

import pytest

from sparkgauge.operators import thresholds


@pytest.mark.parametrize("bound", [thresholds.TRIE, 2])
def test_any_number_of_rules(spark, monkeypatch, bound):
    rules = [("A", None, 5), (None, "View", 4), ("A", "View", 3), ("", None, 9), (None, None, 1), ("A", None, 7), (None, "", 8), ("Bé", "w", 2), ("A", "x", None)]
    rules = spark.createDataFrame(rules, "prefix string, suffix string, threshold int")
    names = spark.createDataFrame([(x,) for x in ("AView", "A", "View", "BéView", "x", "", None, "Ax")], "enclosing_type string")
    want = {"AView": 3, "A": 5, "View": 4, "BéView": 2, "x": 8, "": 8, None: 15, "Ax": 5}
    monkeypatch.setattr(thresholds, "TRIE", bound)
    out = thresholds.with_threshold(names, rules, 15)
    assert dict(map(tuple, out.collect())) == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_trie_is_the_loop():
    r = random.Random(6)
    part = lambda most: "".join(r.choices("abé", k=r.randint(0, most)))
    rules = [(r.choice([None, part(3)]), r.choice([None, part(3)]), r.randint(1, 99)) for _ in range(150)]
    trie = thresholds.RuleTrie(rules)
    for _ in range(500):
        name = part(7)
        holds = [t for p, s, t in rules if (p is not None or s is not None) and name.startswith(p or "") and name.endswith(s or "")]
        assert trie.strictest(name) == min(holds, default=None)


def test_work_follows_the_letters_of_names():
    """A hundred times the rules cost a name hardly more."""
    r = random.Random(7)
    names = ["".join(r.choices("abcdefgh", k=12)) for _ in range(3000)]

    def seconds(n):
        trie = thresholds.RuleTrie(("".join(r.choices("abcdefgh", k=5)), "".join(r.choices("abcdefgh", k=3)), 1) for _ in range(n))
        began = time.process_time()
        for name in names:
            trie.strictest(name)
        return time.process_time() - began

    few = seconds(1000)
    assert seconds(100_000) < 12 * few + 0.1


def test_exchanged_rules_meet_only_names_for_which_they_hold(spark, monkeypatch):
    """1500 names that begin alike, and as many rules of their beginning with ends of their own: no join makes a row for every pair."""
    monkeypatch.setattr(thresholds, "TRIE", 2)
    names = spark.range(1500).selectExpr("concat('large ring ', id + 1000) as enclosing_type", "id")
    rules = spark.range(1500).selectExpr("'large r' as prefix", "cast(id + 1000 as string) as suffix", "cast(id % 50 + 1 as int) as threshold")
    out = thresholds.with_threshold(names, rules)
    assert all(r.threshold == r.id % 50 + 1 for r in out.collect())
    plan, made = [out._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            plan.append(node.plan())
        children = node.children()
        plan += [children.apply(k) for k in range(children.size())]
        if node.metrics().contains("numOutputRows"):
            made.append(node.metrics().apply("numOutputRows").value())
    assert made and max(made) < 100_000
