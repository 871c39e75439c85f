"""Bracket matching by chunks against one walk with a stack."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators.brackets import matched

KINDS = {"(": "open", ")": "close", "&": "logical", "+": "other"}


def walked(text):
    """(depth, partner, scope, continued) of every token."""
    stack, runs, out = [], [False], []
    for i, c in enumerate(text):
        if c == "(":
            out.append([len(stack), None, None, False])
            stack.append(i)
            runs.append(False)
        elif c == ")":
            if stack:
                opened = stack.pop()
                runs.pop()
                out[opened][1] = i
                out.append([len(stack), opened, None, False])
            else:
                runs[-1] = False  # what is outside begins anew behind a closing that closes nothing
                out.append([0, None, None, False])
        else:
            out.append([len(stack), None, stack[-1] if stack else None, c == "&" and runs[-1]])
            runs[-1] = c == "&"
    return out


R = random.Random(4)
TEXTS = ["", "(", ")", "&&", "()", ")(", "((((((((", "))))))))", "&(&&)&", "&(&(&)&)&&+&", "(&" * 30 + "&)" * 30, "&&)&&", ")&&(&&", *("".join(R.choice(s) for _ in range(R.randint(1, 80))) for s in ["()&", "()&+", "((&)", "())&", "(&+", ")&"] for _ in range(6))]


@pytest.mark.parametrize("chunk", [1, 2, 7, 100_000])
def test_any_chunks(spark, chunk):
    rows = [(k, "x", i, KINDS[c]) for k, t in enumerate(TEXTS) for i, c in enumerate(t)]
    R.shuffle(rows)
    got = {(r.doc, r.at): [r.depth, r.partner, r.scope, r.continued] for r in matched(spark.createDataFrame(rows, "doc long, part string, at long, kind string"), ["doc", "part"], "at", chunk).collect()}
    assert len(got) == len(rows)
    for k, t in enumerate(TEXTS):
        assert [got[k, i] for i in range(len(t))] == walked(t), t


def test_positions_may_have_holes(spark):
    text = "&(&)&&(" * 5
    rows = [(0, i * 13 + 5, KINDS[c]) for i, c in enumerate(text)]
    got = sorted((r["at"], r.depth, r.partner, r.scope, r.continued) for r in matched(spark.createDataFrame(rows, "doc long, at long, kind string"), ["doc"], "at", 40).collect())
    place = lambda i: None if i is None else i * 13 + 5
    assert got == [(place(i), d, place(p), place(s), c) for i, (d, p, s, c) in enumerate(walked(text))]


def test_no_group_is_a_whole_sequence(spark):
    """Of a hundred thousand tokens of one sequence no window sees more than a chunk, or a row for each chunk."""
    rows = spark.range(100_000).selectExpr("0 as doc", "id as at", "element_at(array('open', 'logical', 'close', 'logical'), cast(id % 4 as int) + 1) as kind")
    out = matched(rows, ["doc"], "at", 1000)
    assert out.where("continued").count() == 25_000 - 1 and out.agg({"depth": "max"}).first()[0] == 1
    assert matched(rows.where("false"), ["doc"]).count() == 0


def test_tasks_grow_with_the_tokens(spark, monkeypatch):
    """However many tokens, no task gets more than its share of them, whatever the session's number of partitions."""
    monkeypatch.setattr("sparkgauge.operators.brackets.TASK", 500, raising=False)
    rows = spark.range(20_000).selectExpr("id % 7 as doc", "id div 7 as at", "element_at(array('open', 'logical', 'close', 'close'), cast(id % 4 as int) + 1) as kind")
    out = matched(rows, ["doc"], "at", 20)
    most = out.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0]
    assert out.count() == 20_000 and most < 2000
