"""Secret scans: keyword automaton, anchored expressions at its hits, checksum validation.

An Aho-Corasick automaton runs once over the lower-cased text; an expression is tried
only where one of its keywords begins, anchored there.  Hexadecimal runs have no
keyword and are found by their own run expression.  Kinds with an embedded checksum
or signature are kept only if it holds.

Work is linear in the text: no expression goes over a stretch again after it has failed there.

Defined results: a null or empty text has no spans (and the digest of the empty
string); repeated rows and ids each give their own row; clashing extra columns are
ignored by ``scan`` and kept by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, texts, tidy

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(token: str) -> bool:
    """Tokens of the form prefix_ + 30 letters + the CRC-32 of those 30, six digits in base 62."""
    body, check = token.partition("_")[2][:-6], token[-6:]
    n, digits = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def signed_header(token: str) -> bool:
    """The first part of a signed web token is a JSON object that names its algorithm."""
    head = token.partition(".")[0]
    try:
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error, RecursionError):  # also where it is nested too deeply to be a header
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


@dataclass(frozen=True)
class Kind:
    name: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    holds: Callable[[re.Match], bool]
    base: bool = False
    #: Where a match fails at a hit, so it does at all further ones in this run.
    run: re.Pattern | None = None


#: In the order in which spans that begin together are listed.
KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?((?-i:[A-Za-z0-9+/_.=-]+))""", re.ASCII | re.IGNORECASE),
        lambda m: len(m[2]) >= 6,
        True,
    ),
    Kind("access", ("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20, True),
    Kind("hex", (), re.compile(r"[0-9a-f]{24,}"), lambda m: True, True),
    Kind("hosting", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: base62_crc(m[0])),
    Kind("package", ("npm_",), re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z])"), lambda m: base62_crc(m[0])),
    Kind("signed", ("eyj",), re.compile(r"eyJ[\w-]+\.[\w-]+\.[\w-]+", re.ASCII), lambda m: signed_header(m[0]), run=re.compile(r"[\w-]+", re.ASCII)),
    Kind("private", ("-----begin ",), re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"), lambda m: True),
)

Span = tuple[int, int, int]  # start, place in KINDS, end


class Scanner:
    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.automaton = ahocorasick.Automaton()
        words: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                words.setdefault(word, []).append(i)
        for word, users in words.items():
            self.automaton.add_word(word, (len(word) - 1, users))
        self.automaton.make_automaton()
        self.runs = [i for i, kind in enumerate(kinds) if not kind.keywords]

    def lowered(self, text: str) -> str:
        """Lower case with every character at its place."""
        low = text.lower()
        return low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)

    def spans(self, text: str) -> list[Span]:
        """All spans, by start and then by kind; those of one kind never overlap, the leftmost comes first."""
        found: list[Span] = []
        ends = [0] * len(self.kinds)
        hits = sorted({(last - back, i) for last, (back, users) in self.automaton.iter(self.lowered(text)) for i in users})
        for start, i in hits:
            kind = self.kinds[i]
            if start < ends[i]:
                continue
            m = kind.pattern.match(text, start)
            if m and kind.holds(m):
                found.append((start, i, m.end()))
                ends[i] = m.end()
            elif kind.run:
                ends[i] = kind.run.match(text, start).end()
            elif m:
                ends[i] = m.end()
        for i in self.runs:
            found += [(m.start(), i, m.end()) for m in self.kinds[i].pattern.finditer(text) if self.kinds[i].holds(m)]
        found.sort()
        return found

    def listed(self, spans: list[Span]) -> str:
        return ",".join(f"{self.kinds[i].name}:{a}:{b}" for a, i, b in spans)

    def redacted(self, text: str, spans: list[Span]) -> str:
        """The text with each run of overlapping spans replaced by the name of its first kind."""
        out, at = [], 0
        for a, i, b in spans:
            if a >= at:
                out += [text[at:a], f"[{self.kinds[i].name}]"]
            at = max(at, b)
        return "".join([*out, text[at:]]) if out else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        base = [i for i, k in enumerate(scanner.kinds) if k.base]
        names = [scanner.kinds[i].name for i in base]
        for b in batches:
            counts, digests, listed = [[] for _ in base], [], []
            for t in b.column(1):
                spans = scanner.spans(t.as_py() or "")
                kinds = [i for _, i, _ in spans]
                for column, i in zip(counts, base):
                    column.append(kinds.count(i))
                digests.append(hashlib.sha256(scanner.listed([s for s in spans if s[1] in base]).encode()).hexdigest())
                listed.append(scanner.listed(spans))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string())],
                ["doc_id", *(f"n_{n}" for n in names), "base_sha256", "spans"],
            )

    return texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced in the text; other values, nulls too, stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        scanner = Scanner()
        for b in batches:
            texts = [t and scanner.redacted(t, scanner.spans(t)) for t in (x.as_py() for x in b.column(at))]
            yield b.set_column(at, b.schema.field(at).name, pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
