"""Reports written by all tasks are the reports that the driver would make."""

import glob
import json

import pytest

import sparkgauge as sg
from sparkgauge import samples
from sparkgauge.plans.analysis import analyze_sources
from sparkgauge.plans.report_sink import read_lines, report_lines, write_report
from sparkgauge.sources.files import strings


def read(path):
    """The part files in order of their names."""
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture(scope="module", params=["syntax", None])
def result(request, spark):
    sources = {**samples.SOURCES, "empty.swift": "", 'odd "name" <&>.swift': "func a<T: B>() { if x && y { } }", "types.swift": "enum E { }\nstruct S { }"}
    return analyze_sources(strings(spark, sources), request.param)


@pytest.mark.parametrize("fmt, metrics", [("text", "both"), ("text", "cognitive"), ("xml", "both"), ("json", "both"), ("xcode", "both")])
def test_written_report_is_the_rendered_one(spark, result, tmp_path, fmt, metrics):
    path = str(tmp_path / "report")
    write_report(result, path, fmt, threshold=1, metrics=metrics)
    want = sg.render(result, fmt, threshold=1, metrics=metrics)
    assert json.loads(read(path)) == json.loads(want) if fmt == "json" else read(path).strip("\n") == want.strip("\n")
    rows = read_lines(spark, path).orderBy("place").collect()
    lines = [r.line for r in rows]
    assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and lines == read(path).removesuffix("\n").split("\n")
    assert glob.glob(f"{path}/_SUCCESS") and not glob.glob(f"{path}/_temporary*")


def test_report_of_nothing(spark, result, tmp_path):
    none = result.filtered(threshold=10_000)
    left = none.cohesions is not None
    for fmt in ("text", "json", "xml"):
        write_report(none, str(tmp_path / fmt), fmt)
        assert read(tmp_path / fmt).replace("\n", "") if left or fmt != "text" else read(tmp_path / fmt) == ""
    assert json.loads(read(tmp_path / "json")) == json.loads(sg.render(none, "json"))


def test_no_file_is_gathered(result):
    """A file with any number of functions is a line for each of them."""
    for fmt in ("text", "json", "xml"):
        assert "collect_list" not in report_lines(result, fmt)._jdf.queryExecution().toString()


def test_unknown_formats(result, tmp_path):
    with pytest.raises(sg.SourceError):
        write_report(result, str(tmp_path / "x"), "yaml")
    with pytest.raises(sg.SourceError):
        write_report(result, str(tmp_path / "y"), "text", metrics="all")


def test_empty_rules_filter_nothing(spark, result):
    assert result.filtered(sg.Rules()).functions.count() == result.functions.count()
    assert result.filtered(sg.Rules(), 10_000).functions.count() == 0 and result.filtered(sg.Rules(default=10_000)).functions.count() == 0
    assert not result.exceeded(sg.Rules())
