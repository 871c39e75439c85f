"""Source texts of our own that the queries on embedded sources and the tests use."""

from __future__ import annotations

SOURCES = {
    "Sources/Shop/Cart.swift": '''\
import Foundation

/* A cart /* with a nested comment */ of "items" { */
struct Cart {
    private var items: [String: Int] = [:]
    var coupon: String?
    static let shared = Cart()

    var isEmpty: Bool {
        return items.isEmpty && coupon == nil
    }

    var total: Int = 0 {
        willSet { print("now \\(newValue > 0 || total > 0 ? "a" : "b")") }
        didSet {
            if total < 0 { total = 0 }
        }
    }

    mutating func add(_ name: String, count: Int = 1) -> Bool {
        guard count > 0 else { return false }
        items[name, default: 0] += count
        recount()
        return true
    }

    mutating func recount() {
        var sum = 0
        for (_, n) in items where n > 0 {
            sum += n
        }
        total = sum
    }

    func describe() -> String { "cart" }
}
''',
    "Sources/Shop/Rules.swift": '''\
enum Kind { case plain, special(Int) }

func classify(_ kind: Kind, _ flags: [Bool]) -> Int {
    switch kind {
    case .plain: return 0
    case .special(let n) where n > 3 && flags[0]:
        while n > 4 || flags[1] && flags[2] {
            if n == 5, flags.contains(where: { $0 && !$0 }) { break } else if n == 6 { continue } else { return 2 }
        }
        return n
    default:
        do { try risky() } catch { return -1 }
        return flags.first ?? false ? 1 : 2
    }
}

func risky() throws {
    func inner(_ a: Bool, _ b: Bool) -> Bool {
        return a && b && check(a || b) && !b
    }
    repeat { _ = inner(true, false) } while false
}
''',
    "Sources/Shop/Store.swift": '''\
protocol Storing {
    func save()
    var name: String { get set }
}

extension Storing where Self: AnyObject {
    func save() { print("saved") }
}

final class Store: Storing {
    var name = "store"
    private var log: [String] = []
    weak var owner: Store?

    init(name: String) { self.name = name }
    deinit { log.removeAll() }

    func rename(_ to: String) { name = to }
    func note(_ line: String) { log.append(line) }
    func report() -> String { joined() }
    func joined() -> String { log.joined(separator: ", ") }
    func version() -> Int { 3 }
    class func make() -> Store { Store(name: "x") }

    actor Counter {
        var n = 0
        func up() { n += 1 }
    }
}
''',
    "Sources/Shop/Empty.swift": "",
}

#: An index of the same types: what has which member, and which member uses which.
SYMBOLS = [
    ("s:Store", "Store", "class", None),
    ("s:Store.name", "name", "instanceProperty", "s:Store"),
    ("s:Store.log", "log", "instanceProperty", "s:Store"),
    ("s:Store.init", "init(name:)", "constructor", "s:Store"),
    ("s:Store.deinit", "deinit", "destructor", "s:Store"),
    ("s:Store.rename", "rename(_:)", "instanceMethod", "s:Store"),
    ("s:Store.note", "note(_:)", "instanceMethod", "s:Store"),
    ("s:Store.report", "report()", "instanceMethod", "s:Store"),
    ("s:Store.joined", "joined()", "instanceMethod", "s:Store"),
    ("s:Counter", "Counter", "class", None),
    ("s:Counter.n", "n", "instanceProperty", "s:Counter"),
    ("s:Counter.up", "up()", "instanceMethod", "s:Counter"),
]
OCCURRENCES = [
    ("s:Store.name", "reference", "s:Store.init"),
    ("s:Store.name", "reference", "s:Store.rename"),
    ("s:Store.log", "reference", "s:Store.note"),
    ("s:Store.log", "reference", "s:Store.joined"),
    ("s:Store.joined", "call", "s:Store.report"),
    ("s:Counter.n", "reference", "s:Counter.up"),
]
