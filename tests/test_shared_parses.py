"""Texts that differ in numbers of names only share a parse, and sources are parsed once for all their metrics."""

import random

import pytest
from pyspark.sql import functions as F

from sparkgauge import analyze_sources, samples
from sparkgauge.sources import syntax as syntax_module
from sparkgauge.sources.syntax import Parsed, columns_of

R = random.Random(7)
SHAPES = [
    *samples.SOURCES.values(),
    "func f1(x2: Int, y3: [T4]) -> Int { if x2 > 0x1.a5 && y3 || z10 { g1(`x2`) }\nreturn x1 + 1.5e5 }",
    "class C1 { var p1 = 0, p2: Int { p1 + \"\\(x7) a1 é1\" }\n func m1() { p1(); m2() }\n func m2() { a1b2; $0; $x1; _1; a_1 } }",
    "extension A1.B2 { var v1: Int { get { x1 } set { x2 } } }\nstruct S12 { static func < (a1: Int) { } /* c1 */ let r = #/x1+/# }",
    "func é1(x1: Int) { y1 }\nvar x1, x2: Int\nvar x2, x1: Int",
]


def renumbered(text):
    new = {}
    return syntax_module.NUMBERED.sub(lambda m: new.setdefault(m[0], m[1] + "".join(R.choice("0123456789") for _ in m[2])), text)


@pytest.mark.parametrize("idents", [True, False])
@pytest.mark.parametrize("kept", [0, 3000, 1_000_000])
def test_columns_are_those_of_the_own_parse(idents, kept):
    parsed = Parsed(idents, kept)
    texts = [renumbered(t) for t in SHAPES for _ in range(12)] + SHAPES + ["", "x1 x2", "x2 x1", "x2 x2", "x1 x12"]
    R.shuffle(texts)
    for t in texts:
        assert parsed.columns(t) == columns_of(t, idents), t


def test_texts_of_one_shape_share_a_parse(monkeypatch):
    calls, known = [], syntax_module.parse
    monkeypatch.setattr(syntax_module, "parse", lambda *a: calls.append(a) or known(*a))
    parsed = Parsed(True)
    names = [parsed.columns(f"func f{k + 1000}(x: Int) {{ if a{k % 10} {{ }} }}")["name"][1] for k in range(300)]
    assert names == [f"f{k + 1000}" for k in range(300)] and len(calls) == 1


def test_metrics_read_the_sources_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(k):
        read.add(1)
        return f"func f{k + 1000}(x: Int) -> Int {{ if a && b || c {{ return {k % 2} }} ; while a && b && c {{ }} }}"

    sources = spark.range(0, 300, 1, 2).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("file_path"), text("id").alias("code"))
    with analyze_sources(sources) as result:
        functions = result.functions
    rows = functions.collect()
    assert {(r.name, r.cyclomatic, r.cognitive) for r in rows} == {(f"f{k + 1000}", 7, 3) for k in range(300)}
    assert read.value == 300
