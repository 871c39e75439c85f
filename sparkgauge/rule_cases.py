"""Small sources of our own with values worked out by hand from the rules; tests and oracles share them.

Fixed values: every list below is what the rules give, not what a run of the code gave.
"""

from __future__ import annotations

#: Body of a function, its cyclomatic and its cognitive complexity.
METRICS = [
    ("", 1, 0),
    ("if a { }", 2, 1),
    ("if a { } else { }", 2, 2),
    ("if a { } else if b { } else { }", 3, 3),
    ("if a { if b { } }", 3, 3),
    ("if a { } else { if b { } }", 3, 3),
    ("guard let x = y else { return }", 2, 1),
    ("for i in 0..<3 where i > 1 { while i < 2 { } }", 3, 3),
    ("repeat { } while x", 2, 1),
    ("switch x { case 1, 2: a() \n case 3: if b { } \n default: c() }", 4, 3),
    ("do { try g() } catch let e as E { } catch { if x { } }", 4, 4),
    ("return a && b && c", 3, 1),
    ("return a && b || c", 3, 1),
    ("if a && b && c { }", 4, 1),
    ("while a && b && c { }", 4, 2),
    ("guard a || b || c else { return }", 4, 2),
    ("let x = a && b == c && d", 3, 0),
    ("let x = a && b\nlet y = c && d", 3, 1),
    ("let x = a && g(b && c) && d", 4, 1),
    ("let x = a ? b : c ?? d", 1, 0),
    ("let x = if a { 1 } else { 2 }", 2, 2),
    ("items.forEach { i in if i { } }", 2, 1),
    ("items.map { $0 > 1 }.filter { x, y in x && y }", 2, 0),
    ('print("{ if a \\(b && c ? "}" : "x") {")', 2, 0),
    ('let s = """\n if a { \\(x || y)\n """', 2, 0),
    ('let r = #"\\(a && b) if { "#', 1, 0),
    ("// if a { }\n/* while b { /* nested */ } */", 1, 0),
    ("#if DEBUG\nif a { }\n#else\nif b { }\n#endif", 3, 2),
    ("outer: for x in y { break outer }", 2, 1),
    ("if case .some(let x) = y, x > 1 { }", 2, 1),
    ("if let x = y.first(where: { $0 && a }) { }", 3, 1),
    ("let a = b < c && d > (e)", 2, 0),
    ("let a: Dictionary<String, Array<Int>> = x as? [Int: Int] ?? y", 1, 0),
    ("func g() { if a { } }", 2, 1),
    ("defer { if a { } }", 2, 1),
    ("let x = y / z; if a / b > c { }", 2, 1),
    ("switch x { case 1: for i in y { if i { } }\n default: break }", 4, 6),
    ("while a { repeat { if b { } else { } } while c }", 4, 7),
]

#: The same where conditional and coalescing operators count: a conditional operator and each ``??`` is a decision, and the former nests.
FOLDED = [
    ("let x = a ? b : c ?? d", 3, 1),
    ("return a ?? b ?? c", 3, 0),
    ("if a { return b ? c : d }", 3, 3),
    ("return a && b ? c : d", 3, 1),
    ("while a { let y = b ? 1 : 2; let z = c ?? 3 }", 4, 3),
]

#: A source and its functions: name, signature, line, column, enclosing type.
DECLARATIONS = [
    (
        "extension  A.B where T: C {\n  static func <(a: Int, b: Int) -> Bool { true }\n  func g<T>(_ x: T = d()) async throws -> [T]\n  { }\n  é: do { }\n}\n",
        [("<", "func <(a: Int, b: Int)  -> Bool", 2, 10, "A.B"), ("g", "func g<T>(_ x: T = d())  -> [T]", 3, 3, "A.B")],
    ),
    ("let é = 1; func f() { }", [("f", "func f()", 1, 13, None)]),
    (
        "class C { var a: Int { 1 }\n var b: Int = g { $0 } { didSet { if x { } } }\n var c: Int { get { 1 } set(v) { } }\n}",
        [("a", "var a : Int", 1, 15, "C"), ("b.didSet", "var b { didSet }", 2, 26, "C"), ("c.get", "var c { get }", 3, 15, "C"), ("c.set", "var c { set }", 3, 25, "C")],
    ),
    ("protocol P { func a(); var b: Int { get } }\nextension P { func c() { } }", [("c", "func c()", 2, 15, "P")]),
    ("struct S { init(a: Int) { } }\nenum E { func f() { } }", [("init", "init(a: Int)", 1, 12, "S"), ("f", "func f()", 2, 10, "E")]),
    ("class A { deinit { }\n struct B { func g() { } } }", [("deinit", "deinit", 1, 11, "A"), ("g", "func g()", 2, 13, "B")]),
    ("actor T { func f() { func inner() { } } }\nfunc g() { }", [("f", "func f()", 1, 11, "T"), ("inner", "func inner()", 1, 22, "T"), ("g", "func g()", 2, 1, None)]),
]

#: Members of a class: components, instance methods, stored instance properties.
MEMBERS = [
    ("", 0, 0, 0),
    ("var a = 1", 0, 0, 1),
    ("func f() { }", 0, 1, 0),
    ("var a = 1; func f() { }", 1, 1, 1),
    ("func f() { }; func g() { }", 0, 2, 0),
    ("var a = 1; var b = 2\nfunc f() { a }\nfunc g() { self.b }", 2, 2, 2),
    ("var a = 1\nfunc f() { a }\nfunc g() { a }", 1, 2, 1),
    ("var a = 1\nfunc f() { g() }\nfunc g() { }", 1, 2, 1),
    ("var a = 1\nfunc f() { other.a }\nfunc g() { a }", 1, 2, 1),
    ("var a = 1\nfunc f() { x.g() }\nfunc g() { }", 1, 2, 1),
    ("var a = 1; var b = 2\nfunc f(x: Int) { a }\nfunc f(y: String) { b }\nfunc g() { b }", 1, 3, 2),
    ("var a = 1; var b = 2\nfunc f(x: Int) { a }\nfunc f(y: String) { b }\nfunc g() { a }", 2, 3, 2),
    ("static var a = 1; var b = 2\nstatic func f() { b }\nfunc g() { }\nfunc h() { b }", 2, 2, 1),
    ("var a = 1 { didSet { } }\nvar b: Int { 1 }\nvar c = 1\nfunc f() { a }\nfunc g() { a }", 2, 2, 1),
    ("var a = 1\ninit() { a = 2 }\ndeinit { a = 3 }", 1, 2, 1),
    ("var a = 1\nfunc f() { a }\nfunc g() { }\nfunc h() { }", 3, 3, 1),
    ("var a = 1\nfunc f() { f() }\nfunc g() { a }", 2, 2, 1),
]

#: Functions of the embedded sources in their order: file, name, signature, cyclomatic, cognitive, line, column, enclosing type.
FUNCTIONS = [
    ("Sources/Shop/Cart.swift", "isEmpty", "var isEmpty : Bool", 2, 0, 9, 9, "Cart"),
    ("Sources/Shop/Cart.swift", "total.willSet", "var total { willSet }", 2, 0, 14, 9, "Cart"),
    ("Sources/Shop/Cart.swift", "total.didSet", "var total { didSet }", 2, 1, 15, 9, "Cart"),
    ("Sources/Shop/Cart.swift", "add", "func add(_ name: String, count: Int = 1)  -> Bool", 2, 1, 20, 14, "Cart"),
    ("Sources/Shop/Cart.swift", "recount", "func recount()", 2, 1, 27, 14, "Cart"),
    ("Sources/Shop/Cart.swift", "describe", "func describe()  -> String", 1, 0, 35, 5, "Cart"),
    ("Sources/Shop/Rules.swift", "classify", "func classify(_ kind: Kind, _ flags: [Bool])  -> Int", 11, 11, 3, 1, None),
    ("Sources/Shop/Rules.swift", "risky", "func risky()", 6, 3, 17, 1, None),
    ("Sources/Shop/Rules.swift", "inner", "func inner(_ a: Bool, _ b: Bool)  -> Bool", 5, 2, 18, 5, None),
    ("Sources/Shop/Store.swift", "save", "func save()", 1, 0, 7, 5, "Storing"),
    ("Sources/Shop/Store.swift", "init", "init(name: String)", 1, 0, 15, 5, "Store"),
    ("Sources/Shop/Store.swift", "deinit", "deinit", 1, 0, 16, 5, "Store"),
    ("Sources/Shop/Store.swift", "rename", "func rename(_ to: String)", 1, 0, 18, 5, "Store"),
    ("Sources/Shop/Store.swift", "note", "func note(_ line: String)", 1, 0, 19, 5, "Store"),
    ("Sources/Shop/Store.swift", "report", "func report()  -> String", 1, 0, 20, 5, "Store"),
    ("Sources/Shop/Store.swift", "joined", "func joined()  -> String", 1, 0, 21, 5, "Store"),
    ("Sources/Shop/Store.swift", "version", "func version()  -> Int", 1, 0, 22, 5, "Store"),
    ("Sources/Shop/Store.swift", "make", "func make()  -> Store", 1, 0, 23, 11, "Store"),
    ("Sources/Shop/Store.swift", "up", "func up()", 1, 0, 27, 9, "Counter"),
]

#: The same of types: file, name, kind, components from syntax, components from the index, methods (those of the class too, as only ``static`` ones are left out), properties, line and column of the keyword.
TYPES = [
    ("Sources/Shop/Cart.swift", "Cart", "struct", 2, 2, 3, 2, 4, 1),
    ("Sources/Shop/Store.swift", "Store", "class", 4, 2, 8, 3, 10, 7),
    ("Sources/Shop/Store.swift", "Counter", "actor", 1, 1, 1, 1, 25, 5),
]

#: What lies below ``examples/Shop``: name, and whether a listing of the folder alone finds it.
LISTED = [(".Store.swift", True), ("Cart.swift", True), ("Parts/Rules.swift", False), ("Tests/CartTests.swift", False)]

#: Rules of ``examples/.sparkgauge.yml`` (with the default where none matches), and type names with the threshold of each, without and with a fallback of 3.
RULES = [(None, "Ledger", 6), ("Audit", "Ledger", 4), ("Audit", None, 9), (None, None, 11)]
NAMES = [("AuditLedger", 4, 4), ("AuditTrail", 9, 9), ("SalesLedger", 6, 6), ("LedgerBook", 11, 3), ("audit", 11, 3), (None, 11, 3)]

#: What tools answer on ``examples/Shop``: whether it is an error, and the functions told of.
TOOL_ANSWERS = [
    ("paths", False, 19),
    ("wrong types", False, 16),
    ("threshold", False, 3),
    ("rule file", False, 1),
    ("code", False, 1),
    ("empty code", False, 0),
    ("no code", True, None),
    ("no paths", True, None),
    ("empty paths", True, None),
    ("missing path", True, None),
    ("no sources", True, None),
    ("both metrics", True, None),
    ("no index", True, None),
    ("no rule file", True, None),
    ("no such tool", True, None),
]
