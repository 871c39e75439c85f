"""Tokens of Swift source text.

White space and comments (nested ones too) vanish into the offsets of the tokens around
them.  A string literal is one token that carries the tokens of its interpolations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

WORD, NUMBER, STRING, REGEX, OPERATOR, PUNCTUATION, POUND, END = "word", "number", "string", "regex", "operator", "punctuation", "pound", "end"

OPERATOR_CHARS = frozenset("/=-+!*%<>&|^~?") | {chr(c) for c in (0xA1, 0xA2, 0xA7, 0xA9, 0xAC, 0xB1, 0xB6, 0xD7, 0xF7)}
BRACKETS = frozenset("(){}[],;:@\\")
SKIPPED = re.compile(r"[ \t\r\n\f\v\0]+|//[^\n]*")
WORD_RE = re.compile(r"`[^`\n]+`|\$?[^\W\d]\w*|\$\d+|[^\x00-\x7f]\w*")
NUMBER_RE = re.compile(r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]+)?(?:[pP][+-]?[0-9_]+)?|0[bo][0-9_]+|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?")
COMMENT_MARK = re.compile(r"/\*|\*/")
REGEX_RE = re.compile(r"/(?![ \t*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])*(?<![ \t])/")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    newline: bool  # a line ends between this token and the one before
    spaced: bool  # something separates the two
    parts: list[list[Token]] = field(default_factory=list)


class Lexer:
    def __init__(self, code: str):
        self.code, self.at = code, 0

    def tokens(self, closing: bool = False) -> list[Token]:
        """All tokens; with ``closing``, those up to the parenthesis that ends an interpolation."""
        out: list[Token] = []
        depth = 0
        while True:
            before = self.at
            self.skip()
            gap = self.code[before : self.at]
            token = self.next(out[-1] if out else None, "\n" in gap or not out and not closing, bool(gap) or not out)
            if token.kind == END:
                out.append(token)
                return out
            if closing:
                depth += (token.text == "(") - (token.text == ")")
                if depth < 0:
                    out.append(Token(END, "", token.start, token.start, False, False))
                    return out
            out.append(token)

    def skip(self) -> None:
        while True:
            if m := SKIPPED.match(self.code, self.at):
                self.at = m.end()
            elif self.code.startswith("/*", self.at):
                depth, self.at = 1, self.at + 2
                while depth:
                    m = COMMENT_MARK.search(self.code, self.at)
                    if not m:
                        self.at = len(self.code)
                        return
                    depth += 1 if m[0] == "/*" else -1
                    self.at = m.end()
            else:
                return

    def next(self, previous: Token | None, newline: bool, spaced: bool) -> Token:
        code, start = self.code, self.at
        if start >= len(code):
            return Token(END, "", start, start, True, True)

        def made(kind: str, end: int, **more) -> Token:
            self.at = end
            return Token(kind, code[start:end], start, end, newline, spaced, **more)

        c = code[start]
        if c == "#":
            hashes = len(code[start:]) - len(code[start:].lstrip("#")) if code.startswith("##", start) else 1
            after = code[start + hashes : start + hashes + 1]
            if after == '"':
                return self.string(start, hashes, newline, spaced)
            if after == "/":
                close = code.find("/" + "#" * hashes, start + hashes + 1)
                return made(REGEX, len(code) if close < 0 else close + 1 + hashes)
            m = WORD_RE.match(code, start + 1)
            return made(POUND, m.end() if m else start + 1)
        if c == '"':
            return self.string(start, 0, newline, spaced)
        if c.isdigit() and (m := NUMBER_RE.match(code, start)):
            return made(NUMBER, m.end())
        if c in BRACKETS:
            return made(PUNCTUATION, start + 1)
        if c == ".":
            end = start
            while end < len(code) and code[end] in ".<>=" and (code[end] == "." or end > start + 1):
                end += 1
            return made(OPERATOR if end > start + 1 else PUNCTUATION, end)
        if c == "/" and self.operand_expected(previous, spaced) and (m := REGEX_RE.match(code, start)):
            return made(REGEX, m.end())
        if c in OPERATOR_CHARS:
            end = start
            while end < len(code) and code[end] in OPERATOR_CHARS and not (end > start and code.startswith(("//", "/*"), end)):
                end += 1
            return made(OPERATOR, end)
        if m := WORD_RE.match(code, start):
            return made(WORD, m.end())
        return made(PUNCTUATION, start + 1)

    @staticmethod
    def operand_expected(previous: Token | None, spaced: bool) -> bool:
        if previous is None:
            return True
        if previous.kind == OPERATOR:
            return True
        if previous.kind == PUNCTUATION:
            return previous.text in "([{,;:"
        return previous.kind == WORD and previous.text in ("return", "in", "case", "where", "else") and spaced

    def string(self, start: int, hashes: int, newline: bool, spaced: bool) -> Token:
        """A string literal, raw and of several lines too; interpolations become token lists."""
        code = self.code
        pounds = "#" * hashes
        quote = '"""' if code.startswith('"""', start + hashes) else '"'
        at, parts, close, escape = start + hashes + len(quote), [], quote + pounds, "\\" + pounds
        while at < len(code):
            if code.startswith(close, at):
                at += len(close)
                break
            if code.startswith(escape, at):
                at += len(escape)
                if code.startswith("(", at):
                    self.at = at + 1
                    parts.append(self.tokens(closing=True))
                    at = self.at
                else:
                    at += 1
            elif code[at] == "\n" and len(quote) == 1:
                break
            else:
                at += 1
        self.at = at
        return Token(STRING, code[start:at], start, at, newline, spaced, parts)


def lex(code: str) -> list[Token]:
    return Lexer(code).tokens()
