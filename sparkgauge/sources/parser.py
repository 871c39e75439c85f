"""Structural parser of Swift: one pass over the tokens that emits flat rows.

No tree is kept.  While it descends, the parser knows how deep control flow nests, how
many ``if`` conditions it is inside of, the nearest call, and the bodies of functions
around it; every row carries them as plain numbers, so that metrics are joins and sums.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from dataclasses import dataclass, field

from .lexer import END, NUMBER, OPERATOR, POUND, PUNCTUATION, REGEX, STRING, WORD, Token, lex

# Words of the Swift grammar.
MODIFIERS = frozenset(
    "public private fileprivate internal package open static class final override mutating nonmutating lazy weak unowned required convenience optional dynamic indirect nonisolated isolated distributed prefix postfix infix borrowing consuming async".split()
)
DECLARATIONS = frozenset("func init deinit var let class struct enum actor extension protocol subscript typealias associatedtype import operator precedencegroup macro".split())
ACCESSORS = frozenset("get set willSet didSet _read _modify unsafeAddress unsafeMutableAddress addressWithOwner init".split())
STATEMENTS = frozenset("if guard while for repeat switch do defer return throw break continue fallthrough case default else catch in where".split())
PREFIX_WORDS = frozenset("try await consume copy any some each inout repeat borrowing consuming unsafe".split())
CLOSERS = {"(": ")", "[": "]", "{": "}"}
BODY = -1  # the call scope of what no call encloses


@dataclass(slots=True)
class Row:
    row: str  # function, type, member, node
    pos: int
    kind: str
    name: str | None = None
    signature: str | None = None
    line: int | None = None
    column: int | None = None
    enclosing: str | None = None
    owner: int | None = None  # of members, the position of the type
    fn: int | None = None  # of member functions, their position
    has_body: bool | None = None
    is_static: bool | None = None
    has_accessor: bool | None = None
    nest: int = 0
    condition: int = 0
    scope: int = BODY
    body: int | None = None
    is_else_if: bool | None = None
    inside: list[Row] = field(default_factory=list)  # the functions whose bodies hold it

    @property
    def fns(self) -> list[int]:
        return [f.pos for f in self.inside]

    @property
    def depths(self) -> list[int]:
        """How deep it nests in each of them; -1 where the condition of an ``if`` hides it."""
        return [self.nest - f.nest if self.condition <= f.condition else -1 for f in self.inside]

    @property
    def runs(self) -> list[int]:
        """The call that holds it in each of them, or BODY."""
        return [self.scope if self.scope > f.body else BODY for f in self.inside]


class Parser:
    def __init__(self, code: str, idents: bool = True):
        self.code = code
        self.idents = idents
        self.rows: list[Row] = []
        self.starts = [0, *(i + 1 for i, c in enumerate(code) if c == "\n")]
        self.nest = self.condition = 0
        self.scope = BODY
        self.fns: list[Row] = []
        self.types: list[str] = []
        self.bindings: list[str] = []
        self.owners: list[int | None] = [None]  # the type whose direct members are being read
        self.conditional = 0  # inside #if
        self.feed(lex(code))

    # ---- tokens

    def feed(self, tokens: list[Token]) -> None:
        self.tokens, self.i = tokens, 0

    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def step(self) -> Token:
        t = self.t
        if t.kind != END:
            self.i += 1
        return t

    def at(self, *texts: str) -> bool:
        return self.t.text in texts and self.t.kind not in (STRING, REGEX)

    def take(self, text: str) -> bool:
        if self.at(text):
            self.step()
            return True
        return False

    def split(self, n: int = 1) -> None:
        """Cut the operator token so that its first n characters stand alone."""
        t = self.t
        if t.kind == OPERATOR and len(t.text) > n:
            self.tokens[self.i : self.i + 1] = [Token(OPERATOR, t.text[:n], t.start, t.start + n, t.newline, t.spaced), Token(OPERATOR, t.text[n:], t.start + n, t.end, False, False)]

    def skip_balanced(self) -> None:
        """From an opening bracket to behind its end."""
        depth = 0
        while self.t.kind != END:
            t = self.step()
            if t.kind == PUNCTUATION:
                depth += (t.text in CLOSERS) - (t.text in (")", "]", "}"))
                if depth <= 0:
                    return

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.starts, at)
        return line, len(self.code[self.starts[line - 1] : at].encode("utf-8", "surrogatepass")) + 1

    def description(self, first: int, last: int) -> str:
        """Text of tokens first .. last with white space around them as far as it belongs to them: before them from a line's end on, behind them up to it."""
        a, b = self.tokens[first], self.tokens[last]
        start = a.start
        if a.newline and first:
            gap = self.code[self.tokens[first - 1].end : a.start]
            start -= len(gap) - gap.index("\n") if "\n" in gap else 0
        end = b.end
        while end < len(self.code) and self.code[end] in " \t":
            end += 1
        return self.code[start:end]

    # ---- rows

    def emit(self, kind: str, t: Token, name: str | None = None, **more) -> Row:
        row = Row("node", t.start, kind, name, nest=self.nest, condition=self.condition, scope=self.scope, inside=[*self.fns], **more)
        self.rows.append(row)
        return row

    def function(self, t: Token, kind: str, name: str, signature: str, place: int, has_body: bool) -> Row:
        line, column = self.place(place)
        row = Row("function", t.start, kind, name, signature, line, column, self.types[-1] if self.types else None, has_body=has_body, nest=self.nest, condition=self.condition, inside=[*self.fns])
        self.rows.append(row)
        return row

    def member(self, t: Token, kind: str, name: str, **more) -> None:
        if self.owners[-1] is not None and not self.conditional:
            self.rows.append(Row("member", t.start, kind, name, owner=self.owners[-1], **more))

    def body(self, row: Row | None) -> None:
        """A block in braces, as the body of a function if ``row`` is one."""
        if not self.at("{"):
            return
        if row is not None:
            row.body = self.t.start
            self.fns.append(row)
        self.block()
        if row is not None:
            self.fns.pop()

    def block(self) -> None:
        self.owners.append(None)
        self.take("{")
        self.statements()
        self.take("}")
        self.owners.pop()

    # ---- statements

    def parse(self) -> list[Row]:
        while self.t.kind != END:
            before = self.i
            self.statements()
            if self.i == before:
                self.step()
        return self.rows

    def statements(self) -> None:
        while self.t.kind != END and not self.at("}"):
            before = self.i
            self.statement()
            if self.i == before:
                self.step()

    def attributes(self) -> None:
        while self.at("@"):
            self.step()
            self.step()
            while self.at(".") and not self.t.spaced:
                self.step()
                self.step()
            if self.at("(") and not self.t.spaced:
                self.skip_balanced()

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.t.kind == POUND and self.t.text in ("#if", "#elseif", "#else", "#endif", "#sourceLocation", "#warning", "#error"):
            self.directive()
            return
        self.attributes()
        t, text = self.t, self.t.text
        if t.kind != WORD:
            self.expression()
            return
        if self.declaration():
            return
        if text == "if":
            self.if_()
            self.more_of_expression()
        elif text == "guard":
            self.step()
            self.emit("guard", t)
            self.conditions()
            self.take("else")
            self.block()
        elif text == "while":
            self.step()
            self.emit("while", t)
            self.nest += 1
            self.conditions()
            self.block()
            self.nest -= 1
        elif text == "for":
            self.for_()
        elif text == "repeat" and self.peek().text == "{":
            self.step()
            self.emit("repeat", t)
            self.nest += 1
            self.block()
            if self.take("while"):
                self.expression()
            self.nest -= 1
        elif text == "switch":
            self.switch()
            self.more_of_expression()
        elif text == "do" and self.peek().text in ("{", "throws"):
            self.do()
        elif text == "defer" and self.peek().text == "{":
            self.step()
            self.block()
        elif text in ("return", "throw"):
            self.step()
            if not self.t.newline and not self.at("}", ";") or text == "throw":
                self.expression()
        elif text in ("break", "continue", "fallthrough"):
            self.step()
            if self.t.kind == WORD and not self.t.newline and text != "fallthrough":
                self.step()
        elif self.peek().text == ":" and self.peek(2).text in ("for", "while", "repeat", "switch", "if", "do"):
            self.step()
            self.step()
        else:
            self.expression()

    def directive(self) -> None:
        t = self.step()
        if t.text == "#if":
            self.conditional += 1
        elif t.text == "#endif":
            self.conditional -= 1
        while self.t.kind != END and not self.t.newline:
            if self.at("(", "["):
                self.skip_balanced()
            else:
                self.step()

    def if_(self, is_else_if: bool = False) -> None:
        t = self.step()
        self.emit("if", t, is_else_if=is_else_if)
        self.condition += 1
        self.conditions()
        self.condition -= 1
        self.nest += 1
        self.block()
        self.nest -= 1
        if self.at("else"):
            e = self.step()
            if self.at("if"):
                self.if_(True)
            else:
                self.emit("else", e)
                self.block()

    def conditions(self) -> None:
        while True:
            if self.at("let", "var"):
                self.step()
                self.pattern()
                if self.take("="):
                    self.expression(closures=False)
            elif self.at("case"):
                self.step()
                self.expression(closures=False, pattern=True)
                if self.take(":"):
                    self.type()
                if self.take("="):
                    self.expression(closures=False)
            else:
                self.expression(closures=False)
            if not self.take(","):
                return

    def for_(self) -> None:
        self.emit("for", self.step())
        self.nest += 1
        while self.at("try", "await", "case", "let", "var") or self.at("?", "!"):
            self.step()
        self.expression(closures=False, pattern=True)
        if self.take(":"):
            self.type()
        self.take("in")
        self.expression(closures=False)
        if self.take("where"):
            self.expression(closures=False)
        self.block()
        self.nest -= 1

    def switch(self) -> None:
        self.emit("switch", self.step())
        self.nest += 1
        self.expression(closures=False)
        self.take("{")
        while self.t.kind != END and not self.at("}"):
            before = self.i
            if self.t.kind == POUND and self.t.text in ("#if", "#elseif", "#else", "#endif"):
                self.directive()
                continue
            self.attributes()
            if self.at("case"):
                self.emit("case", self.step())
                while True:
                    self.expression(pattern=True)
                    if self.take("where"):
                        self.expression()
                    if not self.take(","):
                        break
                self.take(":")
            elif self.at("default"):
                self.step()
                self.take(":")
            while self.t.kind != END and not self.at("}", "case", "default") and not (self.at("@") and self.peek().text == "unknown"):
                inner = self.i
                self.owners.append(None)
                self.statement()
                self.owners.pop()
                if self.i == inner:
                    break
            if self.i == before:
                self.step()
        self.take("}")
        self.nest -= 1

    def do(self) -> None:
        self.step()
        if self.take("throws") and self.at("("):
            self.skip_balanced()
        self.block()
        while self.at("catch"):
            self.emit("catch", self.step())
            self.nest += 1
            while not self.at("{") and self.t.kind != END:
                before = self.i
                self.expression(closures=False, pattern=True)
                if self.take("where"):
                    self.expression(closures=False)
                self.take(",")
                if self.i == before:
                    break
            self.block()
            self.nest -= 1

    # ---- declarations

    def declaration(self) -> bool:
        """Read a declaration if one begins here."""
        k, static = self.i, False
        while self.tokens[k].kind == WORD and self.tokens[k].text in MODIFIERS:
            word, after = self.tokens[k].text, self.tokens[min(k + 1, len(self.tokens) - 1)]
            if word == "class" and after.kind == WORD and after.text not in DECLARATIONS | MODIFIERS:
                break
            if after.text == "(" and not after.spaced and self.tokens[min(k + 3, len(self.tokens) - 1)].text == ")":
                k += 3
            elif after.kind != WORD and after.text != "@":
                return False
            static = static or word == "static"
            k += 1
            while self.tokens[k].text == "@" and k + 2 < len(self.tokens):
                k += 2
        t, after = self.tokens[k], self.tokens[min(k + 1, len(self.tokens) - 1)]
        if t.kind != WORD or (t.text not in DECLARATIONS and not (t.text == "case" and self.owners[-1] == -1)):
            return False
        text = t.text
        if text == "actor" and not (after.kind == WORD and not after.newline):
            return False
        if text == "init" and not (after.text in ("(", "<", "?", "!") or after.kind == OPERATOR and after.text[0] in "?!<"):
            return False
        if text in ("operator", "precedencegroup", "macro", "extension", "subscript") and after.kind == END:
            return False
        self.i = k
        if text in ("class", "struct", "enum", "actor"):
            self.nominal(text)
        elif text == "extension":
            self.extension()
        elif text == "protocol":
            while self.t.kind != END and not self.at("{"):
                self.step()
            self.skip_balanced()
        elif text in ("func", "init"):
            self.func(static)
        elif text == "deinit":
            self.step()
            row = self.function(t, "deinit", "deinit", "deinit", t.start, self.at("{"))
            self.member(t, "method", "deinit", fn=t.start, has_body=row.has_body, is_static=False)
            self.body(row)
        elif text in ("var", "let"):
            self.variable(static)
        elif text == "subscript":
            self.subscript()
        else:
            self.line()
        return True

    def line(self) -> None:
        """A declaration without code of interest: up to the end of its line, with blocks and lists in it."""
        self.step()
        while self.t.kind != END and not self.t.newline and not self.at("}", ";"):
            if self.at("(", "[", "{"):
                self.skip_balanced()
            else:
                self.step()
            if self.tokens[self.i - 1].text in (",", "=", ":", "&", "|") and self.t.newline and self.t.kind != END and not self.at("}"):
                self.step()

    def inheritance(self) -> None:
        """Generic parameters, inherited types and where clause: up to the block."""
        while self.t.kind != END and not self.at("{", "}", ";"):
            if self.at("(", "["):
                self.skip_balanced()
            else:
                self.step()

    def nominal(self, kind: str) -> None:
        t = self.step()
        name = self.step().text.strip("`")
        if kind != "enum":
            line, column = self.place(t.start)
            self.rows.append(Row("type", t.start, kind, name, line=line, column=column))
        self.inheritance()
        self.members(name, t.start if kind != "enum" else -1)

    def members(self, name: str, owner: int) -> None:
        held, self.conditional = self.conditional, 0
        self.types.append(name)
        self.owners.append(owner)
        self.take("{")
        self.statements()
        self.take("}")
        self.owners.pop()
        self.types.pop()
        self.conditional = held

    def extension(self) -> None:
        self.step()
        first = self.i
        self.type()
        name = self.code[self.tokens[first].start : self.tokens[max(first, self.i - 1)].end]
        self.inheritance()
        self.members(name, -2)

    def func(self, static: bool) -> None:
        t = self.step()
        kind = t.text
        name = "init"
        if kind == "func":
            n = self.step()
            name = n.text.strip("`")
            if n.kind == OPERATOR and self.at("<") is False and n.text.endswith("<") and len(n.text) > 1 and self.t.kind == WORD:
                name = n.text[:-1]  # an operator that its generic parameters touch
                self.i -= 1
                self.split(len(name))
                self.step()
        elif self.t.kind == OPERATOR and self.t.text[0] in "?!":
            self.split()
            self.step()
        signature = f"func {name}" if kind == "func" else "init"
        if self.at("<"):
            first = self.i
            self.angles()
            signature += self.description(first, self.i - 1)
        row = self.function(t, kind, name, "", t.start, False)
        if self.at("("):
            first = self.i
            self.parameters()
            signature += self.description(first, self.i - 1)
        while self.at("async", "throws", "rethrows", "reasync"):
            self.step()
            if self.at("(") and self.tokens[self.i - 1].text == "throws":
                self.skip_balanced()
        if self.at("->"):
            first = self.i
            self.step()
            self.type()
            if kind == "func":
                signature += " " + self.description(first, self.i - 1)
        if self.at("where"):
            while self.t.kind != END and not self.at("{", "}", ";") and not (self.t.newline and self.t.text in DECLARATIONS | MODIFIERS):
                self.step()
        row.signature, row.has_body = signature.strip(), self.at("{")
        self.member(t, "method", name, fn=t.start, has_body=row.has_body, is_static=static and kind == "func")
        self.body(row)

    def parameters(self) -> None:
        """A list of parameters; default values are expressions of what surrounds the function."""
        self.step()
        while self.t.kind != END and not self.at(")"):
            before = self.i
            self.attributes()
            while self.t.kind == WORD:
                self.step()
            if self.take(":"):
                self.type()
            if self.t.kind == OPERATOR and self.t.text == "=":
                self.step()
                self.expression()
            self.take(",")
            if self.i == before:
                self.step()
        self.take(")")

    def subscript(self) -> None:
        self.step()
        if self.at("<"):
            self.angles()
        if self.at("("):
            self.parameters()
        if self.take("->"):
            self.type()
        if self.at("where"):
            self.inheritance()
        if self.at("{"):
            if self.accessors_follow():
                self.accessors(None)
            else:
                self.block()

    def variable(self, static: bool) -> None:
        t = self.step()
        shorthand = []
        where = len(self.rows)
        while True:
            first, name = self.i, None
            self.attributes()
            p = self.t
            if p.kind == WORD and p.text != "_":
                name = self.step().text.strip("`")
                last = self.i - 1
            else:
                self.pattern()
                last = self.i - 1
            typed = ""
            if self.at(":"):
                colon = self.i
                self.step()
                self.type()
                typed = " " + self.description(colon, self.i - 1).strip(" \t")
            if name:
                self.bindings.append(name)
            if self.at("="):
                self.step()
                self.expression(initial=True)
            has_accessor = self.at("{") and not (self.t.newline and not (self.accessors_follow() or typed))
            if has_accessor:
                if self.accessors_follow():
                    self.accessors(name)
                elif name:
                    signature = f"{t.text} {self.description(first, last)}{typed}".strip()
                    row = self.function(t, "getter_shorthand", name, signature, p.start, True)
                    self.rows.insert(where + len(shorthand), self.rows.pop())
                    shorthand.append(row)
                    row.pos = t.start + len(shorthand) - 1
                    self.body(row)
                else:
                    self.block()
            if name:
                self.bindings.pop()
                self.member(t, "property", name, is_static=static, has_accessor=has_accessor)
            if not self.take(","):
                return

    def accessors_follow(self) -> bool:
        """Whether the block that begins here lists accessors."""
        k = 1
        while self.peek(k).text == "@":
            k += 2
            if self.peek(k).text == "(":
                return True
        while self.peek(k).text in ("mutating", "nonmutating", "private", "borrowing", "consuming") and self.peek(k + 1).kind == WORD:
            k += 1
        t, after = self.peek(k), self.peek(k + 1)
        if t.kind != WORD or t.text not in ACCESSORS:
            return False
        return after.text in ("{", "}", "async", "throws") or after.text == "(" and self.peek(k + 3).text == ")" and self.peek(k + 4).text == "{" or after.kind == WORD and after.text in ACCESSORS

    def accessors(self, name: str | None) -> None:
        self.take("{")
        self.owners.append(None)
        while self.t.kind != END and not self.at("}"):
            before = self.i
            if self.t.kind == POUND:
                self.directive()
                continue
            self.attributes()
            while self.at("mutating", "nonmutating", "private", "borrowing", "consuming"):
                self.step()
            t = self.step()
            if self.at("("):
                self.skip_balanced()
            while self.at("async", "throws", "rethrows"):
                self.step()
                if self.at("("):
                    self.skip_balanced()
            if t.text in ACCESSORS:
                owner = self.bindings[-1] if self.bindings else None
                row = self.function(t, "accessor", f"{owner}.{t.text}" if owner else t.text, f"var {owner} {{ {t.text} }}" if owner else t.text, t.start, self.at("{"))
                self.body(row)
            if self.i == before:
                self.step()
        self.owners.pop()
        self.take("}")

    # ---- types and patterns

    def angles(self) -> None:
        """Generic parameters or arguments, from ``<`` to behind its ``>``."""
        depth = 0
        while self.t.kind != END:
            if self.t.kind == OPERATOR and self.t.text[0] in "<>" and self.t.text != "->":
                self.split()
            t = self.step()
            if t.kind == OPERATOR:
                depth += (t.text == "<") - (t.text == ">")
                if depth <= 0:
                    return
            elif t.text in ("(", "["):
                self.i -= 1
                self.skip_balanced()
            elif t.text in ("{", "}"):
                self.i -= 1
                return

    def type(self) -> None:
        while self.t.kind != END:
            self.attributes()
            if self.at("(", "["):
                self.skip_balanced()
            elif self.t.kind == OPERATOR and self.t.text[0] == "~":
                self.split()
                self.step()
                continue
            elif self.t.kind == WORD and self.t.text not in STATEMENTS:
                word = self.step().text
                if word in ("inout", "some", "any", "borrowing", "consuming", "sending", "isolated", "each", "repeat", "__owned", "__shared"):
                    continue
            else:
                return
            while True:
                if self.t.kind == OPERATOR and self.t.text[0] == "<" and not self.t.newline:
                    self.split()
                    self.angles()
                elif self.at("."):
                    self.step()
                    self.step()
                elif self.t.kind == OPERATOR and self.t.text[0] in "?!" and not self.t.spaced:
                    self.split()
                    self.step()
                elif self.at("...") and not self.t.spaced:
                    self.step()
                else:
                    break
            while self.at("async", "throws", "rethrows") and self.peek().text in ("->", "throws", "("):
                self.step()
                if self.at("(") and self.tokens[self.i - 1].text == "throws":
                    self.skip_balanced()
            if self.at("->", "&"):
                self.step()
                continue
            return

    def pattern(self) -> None:
        if self.at("(", "["):
            self.skip_balanced()
        elif self.t.kind == WORD:
            self.step()
        if self.take(":"):
            self.type()

    # ---- expressions

    def expression(self, closures: bool = True, pattern: bool = False, initial: bool = False) -> None:
        """One expression; ``closures`` tells whether a brace may belong to it."""
        while True:
            if not self.operand(closures, pattern, initial):
                return
            if not self.operator(closures, pattern, initial):
                return

    def more_of_expression(self) -> None:
        """What may follow an if or switch that was an expression."""
        if self.t.kind == PUNCTUATION and self.t.text == "." and self.t.newline is False:
            self.postfix(len(self.rows), True, False, None)

    def operator(self, closures: bool, pattern: bool, initial: bool) -> bool:
        """Read what joins two operands; False at the end of the expression."""
        t = self.t
        if t.kind == WORD and t.text in ("as", "is"):
            self.step()
            if self.t.kind == OPERATOR and self.t.text[0] in "?!" and not self.t.spaced:
                self.split()
                self.step()
            self.type()
            return self.operator(closures, pattern, initial)
        if t.kind != OPERATOR:
            return False
        if t.text == "=":
            if pattern:
                return False
            self.step()
            return True
        if t.text == "?" and t.spaced:
            self.emit("ternary", self.step())
            self.expression(closures)
            self.take(":")
            return True
        if t.text == "->":
            self.step()
            self.type()
            return False
        after = self.peek()
        right = after.spaced or after.kind == END
        if t.newline and not right:  # a prefix operator that begins the next statement
            return False
        if not t.spaced and right:  # postfix
            self.step()
            return self.operator(closures, pattern, initial)
        self.emit("binop", self.step(), t.text)
        return True

    def operand(self, closures: bool, pattern: bool, initial: bool) -> bool:
        while True:
            t = self.t
            if t.kind == WORD and t.text in PREFIX_WORDS and self.peek().kind != END and self.peek().text not in (".", ",", ")", "=", ":", "]", "}"):
                if t.text == "repeat" and self.peek().text == "{":
                    break
                self.step()
                if t.text == "try" and self.t.kind == OPERATOR and self.t.text[0] in "?!" and not self.t.spaced:
                    self.split()
                    self.step()
                continue
            if t.kind == WORD and t.text in ("let", "var") and self.peek().kind == WORD or t.kind == WORD and t.text in ("let", "var") and self.peek().text == "(":
                self.step()
                pattern = True
                if self.t.kind == WORD:
                    self.step()
                    return self.finish(closures, pattern, None, len(self.rows), initial)
                continue
            if t.kind == WORD and t.text == "is":
                self.step()
                self.type()
                return True
            if t.kind == OPERATOR and t.text not in ("=", "->"):
                self.step()
                if self.at(")", ",", "]", "}", ":"):  # an operator as a value, or a range without an end
                    return True
                continue
            break
        first = len(self.rows)
        t = self.t
        if t.kind == END or t.kind == PUNCTUATION and t.text in (")", "]", "}", ",", ";", ":"):
            return False
        if t.kind == STRING:
            self.step()
            for part in t.parts:
                self.nested(part)
            return self.finish(closures, pattern, None, first, initial)
        if t.kind in (NUMBER, REGEX):
            self.step()
            return self.finish(closures, pattern, None, first, initial)
        if t.kind == POUND:
            self.step()
            if self.at("(") and not self.t.spaced:
                self.list()
            if closures and self.at("{") and not self.t.newline:
                self.closure()
            return self.finish(closures, pattern, None, first, initial)
        if t.text == "{":
            if not closures:
                return False
            self.closure()
            return self.finish(closures, pattern, None, first, initial)
        if t.text in ("(", "["):
            self.list()
            return self.finish(closures, pattern, None, first, initial)
        if t.text == ".":
            self.step()
            return self.name(closures, pattern, first, initial)
        if t.text == "\\":
            self.step()
            while self.t.kind == WORD or self.at(".", "[", "?", "!"):
                if self.t.newline or self.t.spaced and not self.at("."):
                    break
                if self.at("["):
                    self.skip_balanced()
                else:
                    self.step()
            return True
        if t.text == "@":
            self.attributes()
            return self.operand(closures, pattern, initial)
        if t.kind == WORD:
            if t.text == "if":
                self.if_()
                return True
            if t.text == "switch":
                self.switch()
                return True
            if t.text == "do" and self.peek().text == "{":
                self.do()
                return True
            if t.text in STATEMENTS:
                return False
            return self.name(closures, pattern, first, initial)
        return False

    def nested(self, tokens: list[Token]) -> None:
        """Tokens of an interpolation, in the middle of the others."""
        held = self.tokens, self.i
        self.feed(tokens)
        self.arguments(END)
        self.tokens, self.i = held

    def name(self, closures: bool, pattern: bool, first: int, initial: bool) -> bool:
        t = self.step()
        word = t.text.strip("`")
        if t.kind == WORD and self.idents:
            self.emit("ident", t, word)
        return self.finish(closures, pattern, word if t.kind == WORD else None, first, initial)

    def finish(self, closures: bool, pattern: bool, callee: str | None, first: int, initial: bool) -> bool:
        self.postfix(first, closures, initial, callee)
        return True

    def postfix(self, first: int, closures: bool, initial: bool, callee: str | None) -> None:
        """Members, calls, subscripts and marks behind an operand whose rows begin at ``first``; ``callee`` is the name that a call would call."""
        while True:
            t = self.t
            if t.text == "." and t.kind == PUNCTUATION:
                if t.newline and self.peek().kind not in (WORD, NUMBER):
                    return
                self.step()
                m = self.t
                callee = None
                if m.kind == WORD and not m.newline:
                    self.step()
                    callee = m.text.strip("`")
                    if self.idents:
                        self.emit("ident", m, callee)
                elif m.kind == NUMBER:
                    self.step()
                elif m.text != "(":
                    return
            elif t.text == "(" and t.kind == PUNCTUATION and not t.newline:
                self.call(first, callee, closures, initial)
                callee = None
            elif t.text == "[" and t.kind == PUNCTUATION and not t.newline and not t.spaced:
                self.list()
                callee = None
            elif t.text == "{" and closures and not t.newline and self.callable(first) and not (initial and self.accessors_follow()):
                self.call(first, callee, closures, initial)
                callee = None
            elif t.kind == OPERATOR and t.text[0] in "?!" and not t.spaced and (len(t.text) == 1 or set(t.text) <= set("?!") and t.text != "??" and t.text != "!!"):
                self.split()
                self.step()
                callee = None
            elif t.kind == OPERATOR and t.text[0] == "<" and not t.spaced and self.generic_arguments():
                callee = None
            else:
                return

    def callable(self, first: int) -> bool:
        """Whether the token before the brace can be called with a closure."""
        before = self.tokens[self.i - 1]
        return before.kind == WORD and before.text not in STATEMENTS or before.kind == PUNCTUATION and before.text in (")", "]") or before.kind == OPERATOR and before.text in (">", "?", "!")

    def generic_arguments(self) -> bool:
        """Skip ``<...>`` if it holds types and what follows fits."""
        held, kept = self.i, self.tokens[:]
        self.split()
        depth = 0
        while self.t.kind != END:
            if self.t.kind == OPERATOR and self.t.text[0] in "<>" and self.t.text != "->":
                self.split()
            t = self.t
            if t.kind == OPERATOR and t.text in ("<", ">"):
                depth += 1 if t.text == "<" else -1
            elif not (t.kind == WORD and t.text not in STATEMENTS or t.text in (".", ",", ":", "->", "&", "@") or t.kind == OPERATOR and t.text[0] in "?!"):
                if t.text in ("(", "["):
                    self.skip_balanced()
                    continue
                break
            self.step()
            if not depth:
                after = self.t
                if after.kind == END or after.newline or after.text in ("(", ")", "]", "}", ".", ",", ";", ":", "{", "=", "?", "!"):
                    return True
                break
        self.tokens, self.i = kept, held
        return False

    def call(self, first: int, callee: str | None, closures: bool, initial: bool) -> None:
        """A call: its callee's rows and its arguments form a scope of their own."""
        outer = self.scope
        start = self.rows[first].pos if first < len(self.rows) else self.t.start
        # positions of calls may coincide (as in f()()); the opening bracket tells them apart
        self.scope = self.t.start
        for row in self.rows[first:]:
            if row.row == "node" and row.scope == outer and row.pos >= start:
                row.scope = self.scope
        if callee is not None and self.idents:
            self.emit("call", self.t, callee)
        if self.at("("):
            self.list()
        while closures and self.at("{") and not self.t.newline and not (initial and self.accessors_follow()):
            self.closure()
            while self.t.kind == WORD and self.peek().text == ":" and self.peek(2).text == "{" and self.t.text not in STATEMENTS and not self.t.newline:
                self.step()
                self.step()
                self.closure()
            break
        self.scope = outer

    def list(self) -> None:
        """Expressions in parentheses or brackets."""
        close = CLOSERS[self.step().text]
        self.arguments(close)
        self.take(close)

    def arguments(self, close: str) -> None:
        while self.t.kind != END and not self.at(close):
            before = self.i
            if self.t.kind == POUND and self.t.text in ("#if", "#elseif", "#else", "#endif"):
                self.directive()
                continue
            if self.t.kind == WORD and self.peek().text == ":" and self.t.text not in ("self", "true", "false", "nil") and close != "]":
                self.step()
            self.take(":")
            self.expression()
            while self.at(",", ":", ";"):
                self.step()
            if self.i == before:
                if self.at("}", ")", "]"):
                    return
                self.step()

    def closure(self) -> None:
        self.step()
        self.closure_head()
        self.owners.append(None)
        self.statements()
        self.owners.pop()
        self.take("}")

    def closure_head(self) -> None:
        """Skip captures, parameters and result up to ``in``, if they are there."""
        k, depth = self.i, 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.kind == WORD and t.text == "in" and not depth:
                self.i = k + 1
                return
            if t.kind == PUNCTUATION and t.text in ("(", "["):
                depth += 1
            elif t.kind == PUNCTUATION and t.text in (")", "]"):
                depth -= 1
            elif t.kind == END or t.kind == PUNCTUATION and t.text in ("{", "}", ";"):
                return
            elif not depth and (t.kind in (STRING, NUMBER, REGEX, POUND) or t.kind == WORD and t.text in STATEMENTS | DECLARATIONS or t.kind == OPERATOR and t.text not in ("->", "<", ">", "?", "!", "&", ">>", ">?") or t.newline and k > self.i and self.tokens[k - 1].text not in (",", "->", "]", ")")):
                return
            if depth < 0:
                return
            k += 1


def parse(code: str, idents: bool = True) -> list[Row]:
    """All rows of a source text, in source order.

    The descent is as deep as the text nests; Python's frames are not on the C stack, so the
    bound on them may follow the text, whose every token opens a few calls at most.
    """
    known = sys.getrecursionlimit()
    sys.setrecursionlimit(known + 40 * len(code))
    try:
        return Parser(code, idents).parse()
    finally:
        sys.setrecursionlimit(known)
