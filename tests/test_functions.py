"""Column functions: formatting as C does, bands, escapes, descriptions."""

import pytest
from pyspark.sql import functions as F

from sparkgauge.functions import text
from sparkgauge.operators import thresholds
from sparkgauge.sources.files import excluded


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("number, places, expected", [(2.25, 1, "2.2"), (0.35, 1, "0.3"), (2.75, 1, "2.8"), (1234567.0, 2, "1234567.00"), (0.005, 2, "0.01"), (7 / 3, 2, "2.33"), (0.0, 1, "0.0")])
def test_fixed(spark, number, places, expected):
    assert value(spark, text.fixed(F.lit(number), places)) == expected == f"{number:.{places}f}"


def test_padding_cuts_and_fills(spark):
    assert value(spark, text.padded(F.lit("abc"), 5)) == "abc  " and value(spark, text.padded(F.lit("abcdef"), 4)) == "abcd"
    assert value(spark, text.padded(F.lit(12), 4)) == "12  "


def test_escape_and_trim(spark):
    assert value(spark, text.xml_escaped(F.lit("<a & \"b\" 'c'>"))) == "&lt;a &amp; &quot;b&quot; &apos;c&apos;&gt;"
    assert value(spark, text.trimmed(F.lit("\n\t x y \r\n"))) == "x y"


@pytest.mark.parametrize("n, ui, risk, cognitive", [(5, "green", "low", "low"), (6, "yellow", "low", "moderate"), (10, "yellow", "low", "moderate"), (11, "red", "moderate", "high"), (21, "red", "high", "very high"), (50, "red", "high", "extreme"), (51, "red", "very high", "extreme")])
def test_bands(spark, n, ui, risk, cognitive):
    assert [value(spark, f(F.lit(n))) for f in (text.ui_band, text.risk_band, text.cognitive_band)] == [ui, risk, cognitive]


def test_severities(spark):
    assert [value(spark, text.severity(F.lit(a), F.lit(b), F.lit(10))) for a, b in ((20, 20), (21, 0), (0, 21))] == ["warning", "error", "error"]
    assert [value(spark, text.cohesion_severity(F.lit(n))) for n in (4, 5)] == ["warning", "error"]


def test_descriptions(spark):
    assert value(spark, text.location_text(F.lit(3), F.lit(7))) == "3:7"
    assert value(spark, text.function_text(F.lit("f"), F.lit(2), F.lit(1), F.lit(3), F.lit(7))) == "f - Cyclomatic: 2, Cognitive: 1 at 3:7"
    assert value(spark, text.cohesion_text(F.lit("C"), F.lit("class"), F.lit(2), F.lit("moderate"))) == "C (class): LCOM4=2, cohesion=moderate"
    assert value(spark, text.cohesion_summary_text(F.lit(2), F.lit(2.5), F.lit(4), F.lit(1))) == "Cohesion Summary:\n  Total classes: 2\n  Average LCOM4: 2.50\n  Max LCOM4: 4\n  Low cohesion classes: 1"


@pytest.mark.parametrize(
    "name, prefix, suffix, expected",
    [("ToiletRepository", "Toilet", None, True), ("ToiletRepository", None, "Repository", True), ("ToiletRepository", "Toilet", "UseCase", False), ("toiletX", "Toilet", None, False), ("X", None, None, False), ("X", "", None, True), (None, "X", None, None)],
)
def test_rule_matches(spark, name, prefix, suffix, expected):
    columns = [F.lit(x).cast("string") for x in (name, prefix, suffix)]
    assert value(spark, thresholds.matches(*columns)) is expected


@pytest.mark.parametrize("cyclomatic, cognitive, threshold, expected", [(5, 1, 5, True), (5, 3, 8, False), (1, 6, 5, True), (99, 99, None, False)])
def test_exceeds(spark, cyclomatic, cognitive, threshold, expected):
    assert value(spark, thresholds.exceeds(F.lit(cyclomatic), F.lit(cognitive), F.lit(threshold).cast("int"))) is expected


def test_excluded(spark):
    assert [value(spark, excluded(F.lit("/a/TestsX.swift"), p, g)) for p, g in ((["Tests"], []), (["^Tests"], []), (["*Tests*"], []), ([], ["*Tests*"]), ([], []))] == [True, False, False, True, False]
