"""Parser and metrics against values worked out by hand, and against a direct evaluator."""

import random

import pytest

from sparkgauge import rule_cases
from sparkgauge.sources.lexer import lex
from sparkgauge.sources.parser import parse

BRANCHES = {"if", "guard", "while", "for", "repeat", "case", "catch"}


def metrics(code):
    """(name, cyclomatic, cognitive) by walking the rows one by one."""
    rows = parse(code)
    out = []
    for f in (r for r in rows if r.row == "function"):
        cyclomatic, cognitive, runs = 1, 0, {}
        for r in sorted((r for r in rows if r.row == "node" and f.pos in r.fns), key=lambda r: r.pos):
            logical = r.kind == "binop" and r.name in ("&&", "||")
            cyclomatic += r.kind in BRANCHES or logical
            if r.condition > f.condition:
                continue
            depth = r.nest - f.nest
            if r.kind == "if":
                cognitive += 1 if r.is_else_if else 1 + depth
            elif r.kind in ("else", "guard"):
                cognitive += 1
            elif r.kind in ("while", "for", "repeat", "switch", "catch"):
                cognitive += 1 + depth
            elif r.kind == "binop":
                scope = r.scope if r.scope > f.body else -1
                cognitive += logical and runs.get(scope, False)
                runs[scope] = logical
        out.append((f.name, cyclomatic, cognitive))
    return out


def one(body):
    return metrics(f"func f() {{\n{body}\n}}")[0][1:]


@pytest.mark.parametrize("body, expected", [(body, tuple(values)) for body, *values in rule_cases.METRICS])
def test_rules(body, expected):
    assert one(body) == expected


def test_nested_functions_count_in_both():
    assert metrics("func f() { if a { func g() { while b { } } } }") == [("f", 3, 3), ("g", 2, 1)]


def test_names_signatures_and_places():
    code = "extension  A.B where T: C {\n  static func <(a: Int, b: Int) -> Bool { true }\n  func g<T>(_ x: T = d()) async throws -> [T]\n  { }\n  é: do { }\n}\n"
    rows = [r for r in parse(code) if r.row == "function"]
    assert [(r.name, r.signature, r.enclosing) for r in rows] == [("<", "func <(a: Int, b: Int)  -> Bool", "A.B"), ("g", "func g<T>(_ x: T = d())  -> [T]", "A.B")]
    assert [(r.line, r.column) for r in rows] == [(2, 10), (3, 3)]
    assert [(r.line, r.column) for r in parse("let é = 1; func f() { }") if r.row == "function"] == [(1, 13)]


def test_accessors():
    code = "class C { var a: Int { 1 }\n var b: Int = g { $0 } { didSet { if x { } } }\n var c: Int { get { 1 } set(v) { } }\n subscript(i: Int) -> Int { get { i } }\n lazy var d: Int = { if y { } }() }"
    rows = [r for r in parse(code) if r.row == "function"]
    assert [r.name for r in rows] == ["a", "b.didSet", "c.get", "c.set", "get"]
    assert rows[0].signature == "var a : Int" and rows[1].signature == "var b { didSet }"


def test_protocols_have_no_rows():
    assert [r.name for r in parse("protocol P { func a(); var b: Int { get } }\nextension P { func c() { } }") if r.row == "function"] == ["c"]


@pytest.mark.parametrize("kind, enclosing", [("class", "T"), ("struct", "T"), ("enum", "T"), ("actor", "T"), ("extension", "T")])
def test_enclosing_types(kind, enclosing):
    assert [r.enclosing for r in parse(f"{kind} T {{ func f() {{ }} }}\nfunc g() {{ }}") if r.row == "function"] == [enclosing, None]


def test_innermost_type():
    assert [r.enclosing for r in parse("class A { struct B { init() { } } }") if r.row == "function"] == ["B"]


def test_broken_texts_end():
    pieces = ["{", "}", "(", ")", "if", "func f", '"', "\\(", "case", "<", ">", "&&", "in", "let x =", "class A", "#if", "/*", "'", "é", "get", "\n"]
    r = random.Random(3)
    for _ in range(400):
        parse(" ".join(r.choice(pieces) for _ in range(r.randint(0, 40))))


def test_tokens_cover_the_text():
    code = 'a.b?.c!(1...2) == "x\\(y)" as? Z'
    assert [t.text for t in lex(code)][:5] == ["a", ".", "b", "?", "."]
    assert all(code[t.start : t.end] == t.text for t in lex(code))


@pytest.mark.parametrize("opened, closed, within", [("(", ")", "let x = %s"), ("[", "]", "let x = %s"), ("if a { ", "} ", "%s"), ("g { ", "}", "%s"), ("[", "]", "var x: %s"), ("!", "", "let x = %sa"), ("if a { } else ", "", "%s { }")])
def test_deep_texts(opened, closed, within):
    code = "func f() { " + within % (opened * 100_000 + closed * 100_000) + " }"
    rows = parse(code)
    assert [r.name for r in rows if r.row == "function"] == ["f"]
    assert sum(r.kind == "if" for r in rows) == 100_000 * opened.startswith("if")
