"""Counts and failures of a run, and the guard against an empty input."""

import pytest

import sparkgauge as sg
from sparkgauge.sources import syntax as syntax_module

SOURCE = "struct S {\n  var a = 1\n  func f() -> Int { if a > 0 { return 1 }\n return a }\n  func g() { f() }\n}\n"


@pytest.fixture
def folder(tmp_path):
    for k in range(5):
        inner = tmp_path / f"d{k % 2}"
        inner.mkdir(exist_ok=True)
        (inner / f"S{k}.swift").write_text(SOURCE)
    (tmp_path / "empty.swift").write_text("")
    (tmp_path / "bytes.swift").write_bytes(b"\xff\xfe")
    return str(tmp_path)


def test_counts_of_a_tolerant_run(spark, folder):
    spark.sparkContext.setJobGroup("before-counts", "")
    with sg.analyze(spark, [folder], recursive=True, tolerant=True) as result:
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("before-counts")
        assert result.functions.count() == 10
        assert result.check() == {"files": 6, "functions": 10, "types": 5, "members": 15, "not_text": 1, "unreadable": 0, "unparsed": 0}
        failed = result.failures.collect()
        assert [(r.file_path, r.kind) for r in failed] == [(f"{folder}/bytes.swift", "not_text")] and "decode" in failed[0].reason
        assert result.files.count() == 6
    spark.sparkContext.setJobGroup("after-counts", "")
    with pytest.raises(Exception, match="cannot read"):
        sg.analyze(spark, [folder], recursive=True).functions.collect()


def test_an_empty_input(spark, folder):
    with sg.analyze(spark, [folder], recursive=True, exclude=["."], tolerant=True) as result:
        assert result.functions.count() == 0
        with pytest.raises(sg.NoSourceFilesError):
            result.check()
    with sg.analyze(spark, [f"{folder}/bytes.swift"], tolerant=True) as result:
        assert result.check()["not_text"] == 1 and result.functions.count() == 0


def test_failures_of_given_sources(spark, monkeypatch):
    rows = [("a", SOURCE, None), ("b", None, None), ("c", None, "no such file"), ("d", None, "'utf-8' codec can't decode byte 0xff"), ("e", "", "")]
    sources = spark.createDataFrame(rows, "file_path string, code string, error string")
    with sg.analyze_sources(sources, "syntax", tolerant=True) as result:
        assert result.check() == {"files": 2, "functions": 2, "types": 1, "members": 3, "not_text": 1, "unreadable": 2, "unparsed": 0}
        assert sorted((r.file_path, r.kind, r.reason) for r in result.failures.collect()) == [("c", "unreadable", "no such file"), ("d", "not_text", rows[3][2]), ("e", "unreadable", "")]
        assert result.cohesions.count() == 1
    assert syntax_module.syntax(sources.limit(0)).count() == 0


def test_what_does_not_parse(spark):
    deep = "".join("func f%d() { " % k for k in range(3)) + "(" * 10
    sources = spark.createDataFrame([("a", SOURCE), ("b", deep)], "file_path string, code string")
    with sg.analyze_sources(sources, tolerant=True) as result:
        counts = result.check()
        assert counts["files"] + counts["unparsed"] == 2 and counts["functions"] >= 2
