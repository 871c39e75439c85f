"""Plans on Spark: metrics, cohesion, thresholds, files and reports."""

import json
import random

import pytest
from test_parser import metrics

import sparkgauge as sg
from sparkgauge import rule_cases, samples
from sparkgauge.operators.components import count_components, union_find
from sparkgauge.plans.analysis import analyze_sources
from sparkgauge.sources import files
from sparkgauge.sources.files import strings
from sparkgauge.streaming.files import measure_stream

DEEP = """
func deep(a: Int) -> Int {
    guard a > 0 else { return 0 }
    if a > 1 {
        if a > 2 {
            for i in 0..<a where i > 1 && i < 9 { if i == 3 { return 1 } else if i == 4 { return 2 } else { return 3 } }
        } else { while a > 3 || a < 0 { return 4 } }
    } else if a == 5 { return 5 }
    return [1, 2].filter { $0 > 1 && $0 < 5 }.count
}
"""


def test_metrics_equal_the_direct_evaluator(spark):
    sources = {**samples.SOURCES, "Deep.swift": DEEP}
    got = {}
    for r in sg.batch_analyze(spark, sources).functions.orderBy("file_path", "pos").collect():
        got.setdefault(r.file_path, []).append((r.name, r.cyclomatic, r.cognitive))
    assert got == {p: m for p, c in sources.items() if (m := metrics(c))}


def test_random_sources(spark):
    r = random.Random(5)

    def block(depth):
        kinds = ["x = a && b || c && g(d || e && f) && h", "y = a == b", "if a && b { %s } else if c { %s } else { %s }", "while a || b && c { %s }", "for i in s { %s }", "switch k { case 1: %s\n default: %s }", "func n() { %s }", "z.map { v in %s }", "guard a && b && c else { return }", "do { %s } catch { %s }", "repeat { %s } while a && b"]
        out = []
        for _ in range(r.randint(1, 3)):
            k = r.choice(kinds if depth else kinds[:2])
            out.append(k % tuple(block(depth - 1) for _ in range(k.count("%s"))))
        return "\n".join(out)

    sources = {f"f{i}.swift": f"func f() {{ {block(3)} }}" for i in range(25)}
    got = {}
    for row in sg.batch_analyze(spark, sources).functions.orderBy("file_path", "pos").collect():
        got.setdefault(row.file_path, []).append((row.name, row.cyclomatic, row.cognitive))
    assert got == {p: metrics(c) for p, c in sources.items()}


def test_empty_code(spark):
    result = sg.analyze_code(spark, "")
    assert result.functions.count() == 0
    assert [tuple(r) for r in result.summary.collect()] == [("<stdin>", 0, 0.0, 0.0, 0, 0, 0, 0)]
    assert json.loads(sg.render(result, "json")) == {"files": [{"filePath": "<stdin>", "functions": [], "summary": {"totalFunctions": 0, "averageCyclomaticComplexity": 0.0, "averageCognitiveComplexity": 0.0, "maxCyclomaticComplexity": 0, "maxCognitiveComplexity": 0, "totalCyclomaticComplexity": 0, "totalCognitiveComplexity": 0}}]}
    assert sg.render(result, "text") == ""


def cohesion(spark, code):
    rows = analyze_sources(strings(spark, {"a.swift": code}), "syntax").cohesions.collect()
    return {r.name: (r.lcom4, r.method_count, r.property_count) for r in rows}


@pytest.mark.parametrize("members, expected", [(members, tuple(values)) for members, *values in rule_cases.MEMBERS])
def test_cohesion(spark, members, expected):
    assert cohesion(spark, f"class C {{\n{members}\n}}") == {"C": expected}


def test_cohesion_of_nested_types(spark):
    assert cohesion(spark, "struct A { var x = 1; func f() { x }\n actor B { var y = 1; func g() { y }; func h() { } } }\nenum E { func f() { } }") == {"A": (1, 1, 1), "B": (2, 2, 1)}


def test_index_and_fallback(spark):
    symbols = spark.createDataFrame(samples.SYMBOLS, "usr string, name string, kind string, parent_usr string")
    uses = spark.createDataFrame(samples.OCCURRENCES, "usr string, role string, container_usr string")
    rows = analyze_sources(strings(spark, samples.SOURCES), "index", symbols, uses).cohesions.collect()
    assert {r.name: r.lcom4 for r in rows} == {"Cart": 2, "Store": 2, "Counter": 1}
    with pytest.raises(sg.SourceError):
        analyze_sources(strings(spark, samples.SOURCES), "index")


def test_components_equal_label_propagation(spark):
    r = random.Random(9)
    edges = [(k, f"n{r.randrange(30)}", f"n{r.randrange(30)}") for k in range(5) for _ in range(12)]
    nodes = [(k, f"n{i}") for k in range(5) for i in range(30)]
    got = count_components(spark.createDataFrame(nodes, "k int, name string"), spark.createDataFrame(edges, "k int, src string, dst string"), ["k"]).collect()
    for k, n in got:
        label = {i: i for _, i in nodes}
        for _ in range(30):
            for e, a, b in edges:
                if e == k:
                    label[a] = label[b] = min(label[a], label[b])
        assert n == len(set(label.values())) == union_find([(a, b) for e, a, b in edges if e == k], [i for _, i in nodes[:30]])


RULES = sg.Rules((("Audit", None, 9), (None, "Ledger", 6), ("Audit", "Ledger", 4), ("Net", "Ledger", 8), (None, None, 2)), 11)


def test_thresholds(spark):
    names = ("AuditTrail", "SalesLedger", "AuditLedger", "NetLedger", "LedgerBook", "audit")
    result = sg.analyze_code(spark, "".join(f"struct {n} {{ func f() {{ }} }}\n" for n in names) + "func f() { }")

    def of(rules, threshold=None):
        return {r.enclosing_type: r.threshold for r in result.with_thresholds(rules, threshold).collect()}

    own = {"AuditTrail": 9, "SalesLedger": 6, "AuditLedger": 4, "NetLedger": 6}
    rest = ("LedgerBook", "audit", None)
    assert of(RULES) == own | dict.fromkeys(rest, 11)
    assert of(RULES, 7) == own | dict.fromkeys(rest, 7)
    assert of(sg.Rules()) == dict.fromkeys([*names, None]) and set(of(sg.Rules(), 13).values()) == {13}
    assert result.exceeded(threshold=1) and not result.exceeded(threshold=2) and not result.exceeded()


def test_filters_and_equality(spark):
    result = analyze_sources(strings(spark, {**samples.SOURCES, "Deep.swift": DEEP}), "syntax")
    most = max(max(r.cyclomatic, r.cognitive) for r in result.functions.collect())
    assert result.exceeded(threshold=most) and sg.render(result, "xcode", threshold=most).count("high complexity") == 0
    left = result.filtered(threshold=most)
    assert {r.file_path for r in left.files.collect()} == {"Deep.swift", "Sources/Shop/Store.swift"}
    assert [r.total_functions for r in left.summary.orderBy("file_path").collect()] == [1, 0]
    assert {r.name for r in left.cohesions.collect()} == {"Store"}
    assert result.filtered() is result


def test_reports(spark):
    result = analyze_sources(strings(spark, samples.SOURCES), "syntax")
    text = sg.render(result, "text")
    assert text.startswith("File: Sources/Shop/Cart.swift\n| Function/Method      | Cyclomatic | Cognitive  |\n+----------------------+------------+------------+\n| isEmpty              | 2          | 0          |\n")
    assert "| Cart                      | struct | 2     | 3       | 2          | moderate   |\n" in text and "Total: 2 classes, Average LCOM4: 2.50, Low cohesion: 1" in text
    assert "Empty.swift" not in text
    short = sg.render(result, "text", metrics="cognitive")
    assert "| Function/Method      | Cognitive  |\n+----------------------+------------+\n" in short and "Cyclomatic" not in short
    data = json.loads(sg.render(result, "json"))["files"]
    assert [f["filePath"] for f in data] == sorted(samples.SOURCES)
    assert "classCohesions" not in data[1] and data[0]["classCohesions"][0]["lcom4"] == 2 and "enclosingTypeName" not in data[2]["functions"][0]
    xml = sg.render(result, "xml")
    assert 'signature="func describe()  -&gt; String" enclosing-type="Cart" line="35" column="5">' in xml and xml.endswith("</complexity-report>\n")
    again = sg.render(result, "json")
    for fmt in ("text", "xml", "xcode"):
        assert sg.format_results(spark, again, fmt) == sg.render(result, fmt)
    with pytest.raises(sg.SourceError):
        sg.render(result, "csv")


def test_files(spark, tmp_path, caplog):
    for name in ("a.swift", ".hidden.swift", "_b.swift", "notes.txt", "sub/c.swift", "sub/cTests.swift"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("func f() { }")

    def names(**more):
        return [f.removeprefix(f"{tmp_path}/") for f in files.collect_files(spark, [str(tmp_path)], **more)]

    assert names() == [".hidden.swift", "_b.swift", "a.swift"]
    assert names(recursive=True, exclude=["Tests", "*bad"]) == [".hidden.swift", "_b.swift", "a.swift", "sub/c.swift"]
    assert names(recursive=True, exclude_globs=["*Tests.swift", "*/_*"]) == [".hidden.swift", "a.swift", "sub/c.swift"]
    with pytest.raises(sg.NoSourceFilesError):
        files.collect_files(spark, [str(tmp_path / "notes.txt")])
    with pytest.raises(sg.InvalidPathError):
        files.collect_files(spark, [str(tmp_path / "none")])
    with pytest.raises(sg.SourceError):
        files.collect_files(spark, [])
    assert sg.analyze(spark, [str(tmp_path)], recursive=True).functions.count() == 5
    assert files.scan(spark, str(tmp_path), exclude=["Tests"]).count() >= 2
    (tmp_path / "bad.swift").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="cannot read"):
        sg.analyze(spark, [str(tmp_path / "bad.swift")]).functions.count()


def test_rule_files(tmp_path):
    assert files.discover_rules(str(tmp_path)) is None
    path = tmp_path / ".sparkgauge.yaml"
    path.write_text("rules:\n  - suffix: Ledger\n    threshold: 17\n  - prefix: Net\n    suffix: Audit\n    threshold: 21\n")
    assert files.discover_rules(str(tmp_path)) == sg.Rules(((None, "Ledger", 17), ("Net", "Audit", 21)), None)
    for bad in ("defaultThreshold: 3", "rules: 3", "rules: [{threshold: x}]", "rules: [", "rules: []\ndefaultThreshold: many"):
        path.write_text(bad)
        with pytest.raises(sg.RuleFileError):
            files.load_rules(str(path))
    with pytest.raises(sg.RuleFileError):
        files.load_rules(str(tmp_path / "none.yml"))


def test_rule_file_names_and_environment(spark, tmp_path, monkeypatch):
    (tmp_path / ".sparkgauge.yaml").write_text("rules: []\ndefaultThreshold: 4")
    (tmp_path / "own.yml").write_text("rules: []\ndefaultThreshold: 5")
    assert files.discover_rules(str(tmp_path)).default == 4
    (tmp_path / ".sparkgauge.yml").write_text("rules: []\ndefaultThreshold: 3")
    assert files.discover_rules(str(tmp_path)).default == 3
    assert files.discover_rules(str(tmp_path), ["own.yml"]).default == 5
    assert files.env_threshold() == 10
    result = analyze_sources(strings(spark, {"a.swift": "func f() { " + "if a { }; " * 4 + "}"}))
    assert sg.render(result, "xcode") == ""
    monkeypatch.setenv("SPARKGAUGE_THRESHOLD", "3")
    assert files.env_threshold() == 3 and "Threshold: 3" in sg.render(result, "xcode") and sg.render(result, "xcode", threshold=9) == ""
    monkeypatch.setenv("SPARKGAUGE_THRESHOLD", "many")
    assert files.env_threshold() == 10
    monkeypatch.setenv("MINE", "6")
    assert files.env_threshold(variable="MINE") == 6


def test_remote_paths_and_release(spark, tmp_path):
    for name in ("a.swift", "sub/b.swift", "sub/bTests.swift"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("func f() { if a { } }")
    top = f"file://{tmp_path}"
    with sg.analyze(spark, [top, f"{top}/a.swift"], recursive=True, exclude=["Tests"]) as result:
        assert sorted(r.file_path.rpartition("/")[2] for r in result.functions.collect()) == ["a.swift", "b.swift"]
        assert result.held.storageLevel.useMemory
    assert not result.held.storageLevel.useMemory and result.functions.count() == 2
    assert sg.analyze(spark, [top, str(tmp_path / "sub")]).functions.count() == 3
    with pytest.raises(sg.NoSourceFilesError):
        sg.analyze(spark, [top], exclude=["swift"])


def test_a_file_that_fails_is_named(spark, monkeypatch):
    from sparkgauge.sources import syntax

    frame = spark.createDataFrame([("x/odd.swift", 5)], "file_path string, code int")
    assert syntax.syntax(frame).count() == 1  # a number is text too

    def run(code, idents):
        raise RecursionError("too deep")

    monkeypatch.setattr(syntax, "parse", run)
    with pytest.raises(Exception, match="cannot parse x/odd.swift: RecursionError: too deep"):
        syntax.syntax(frame).count()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.swift").write_text(DEEP)
    for _ in range(2):
        measure_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.name, r.cyclomatic, r.cognitive) for r in rows] == metrics(DEEP)
