"""Tools and web requests: payloads, and errors that are answers."""

import json

import pytest

import sparkgauge as sg
from sparkgauge import samples
from sparkgauge.plans import service

CODE = "struct A { func f() { if a { } }\nfunc g() { } }"


def test_tools(spark, tmp_path):
    (tmp_path / "a.swift").write_text(CODE)
    (tmp_path / "aTests.swift").write_text(CODE)
    (tmp_path / "own.yml").write_text("rules:\n  - prefix: A\n    threshold: 2\n")
    found = service.call_tool(spark, "analyze_complexity", {"paths": [str(tmp_path), 7], "exclude": ["Tests"], "recursive": "yes"})
    assert not found.is_error and [f["name"] for f in json.loads(found.text)["files"][0]["functions"]] == ["f", "g"]
    left = service.call_tool(spark, "analyze_complexity", {"paths": [str(tmp_path)], "exclude": ["Tests"], "config_path": str(tmp_path / "own.yml"), "format": "text", "cognitive_only": True})
    assert "| f                    | 1          |" in left.text and "| g " not in left.text and "Cyclomatic" not in left.text
    one = service.call_tool(spark, "analyze_code_string", {"code": CODE, "threshold": 3})
    assert json.loads(one.text)["files"][0]["filePath"] == "<stdin>"
    assert json.loads(service.call_tool(spark, "analyze_code_string", {"code": "", "file_name": "x"}).text)["files"][0]["functions"] == []


def test_index(spark, tmp_path):
    spark.createDataFrame(samples.SYMBOLS, "usr string, name string, kind string, parent_usr string").write.parquet(str(tmp_path / "index/symbols"))
    spark.createDataFrame(samples.OCCURRENCES, "usr string, role string, container_usr string").write.parquet(str(tmp_path / "index/occurrences"))
    (tmp_path / "Store.swift").write_text(samples.SOURCES["Sources/Shop/Store.swift"])
    found = service.call_tool(spark, "analyze_complexity", {"paths": [str(tmp_path)], "lcom4": True, "index_store_path": str(tmp_path / "index")})
    assert {c["name"]: c["lcom4"] for c in json.loads(found.text)["files"][0]["classCohesions"]} == {"Store": 2, "Counter": 1}
    assert service.call_tool(spark, "analyze_complexity", {"paths": [str(tmp_path)], "lcom4": True, "index_store_path": str(tmp_path / "none")}).is_error


@pytest.mark.parametrize(
    "name, arguments",
    [
        ("analyze_complexity", None),
        ("analyze_complexity", {"paths": []}),
        ("analyze_complexity", {"paths": "a.swift"}),
        ("analyze_complexity", {"paths": ["/no/such/path"]}),
        ("analyze_complexity", {"paths": ["."], "cyclomatic_only": True, "cognitive_only": True}),
        ("analyze_complexity", {"paths": ["."], "lcom4": True}),
        ("analyze_complexity", {"paths": ["."], "config_path": "/no/such.yml"}),
        ("analyze_code_string", {"code": 5}),
        ("other", {}),
    ],
)
def test_errors_are_answers(spark, name, arguments):
    found = service.call_tool(spark, name, arguments)
    assert found.is_error and found.text.startswith("Error: ")


def test_web_requests(spark):
    raw = service.analyze_response(spark, {"code": CODE, "fileName": "a.swift"})["result"]
    assert raw["filePath"] == "a.swift" and raw["summary"]["totalFunctions"] == 2
    text = service.analyze_response(spark, {"code": CODE, "fileName": "a.swift", "format": "text", "showCyclomaticOnly": True})["formatted"]
    assert text.startswith("File: a.swift") and "Cognitive" not in text
    both = service.batch_response(spark, {"files": [{"code": "func b() { }", "path": "b"}, {"code": "func a() { }", "path": "a"}]})["results"]
    assert [(r["filePath"], r["functions"][0]["name"]) for r in both] == [("a", "a"), ("b", "b")]
    assert service.batch_response(spark, {}) == {"results": []}
    assert service.format_response(spark, {"results": [raw], "format": "xcode", "threshold": 1})["formatted"].count("high complexity") == 1
    assert "<function name=" in service.format_response(spark, {"results": both, "format": "xml"})["formatted"]
    for request in ({}, {"results": [raw]}, {"results": [raw], "format": "csv"}):
        with pytest.raises(sg.SourceError):
            service.format_response(spark, request)
    for request in ({"code": CODE}, {"code": CODE, "fileName": "a", "format": "csv"}):
        with pytest.raises(sg.SourceError):
            service.analyze_response(spark, request)
