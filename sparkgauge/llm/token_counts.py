"""Token counts: rank-synchronous merging over ragged arrays of distinct pieces.

Per row the text is split at special strings, then into pieces; the pieces that a
task has not met before merge together, batch by batch.  A task keeps a bounded
table of the pieces it knows.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows and
ids each give their own row; other input columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, Vocabulary, count_merged
from .common import tidy
from .common import texts as texts_of

#: Pieces that a task remembers; beyond it the table starts anew.
KNOWN_PIECES = 300_000
#: Characters whose pieces are counted at once.
GROUP = 4_000_000


@lru_cache(2)
def special_strings(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


class TokenCounter:
    """Counts as the library does for a byte-level .json file: each special string is one token."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary.from_json(path)
        self.special = special_strings(path)
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Number of special strings, and the pieces between them."""
        if not any(s in text for s in self.special):
            return 0, PIECES.findall(text)
        import regex

        parts = regex.split("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))), text)
        return len(parts) - 1, [p for part in parts for p in PIECES.findall(part)]

    def learn(self, wanted: set[str]) -> None:
        new = [p for p in wanted if p not in self.known]
        if len(self.known) + len(new) > KNOWN_PIECES:
            self.known, new = {}, list(wanted)
        if new:
            self.known.update(zip(new, count_merged(self.vocabulary, [p.encode() for p in new]).tolist()))

    def counts(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        held: list[tuple[int, list[str]]] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(self.pieces(text or ""))
            size += len(text or "")
            if size >= GROUP or i == len(texts) - 1:
                self.learn(set().union(*(p for _, p in held)))
                look = self.known.__getitem__
                out += [n + sum(map(look, p)) for n, p in held]
                held, size = [], 0
        return out


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of every text, and whether it has more tokens than ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for b in batches:
            n = np.array(counter.counts(b.column(1).to_pylist()), np.int64)
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
