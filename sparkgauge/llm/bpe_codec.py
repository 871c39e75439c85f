"""Byte-level BPE encoding and decoding with a rank file.

Distinct pieces of a batch are grouped by length into padded matrices whose rows
merge their leftmost pair of lowest rank each round; texts are then gathered from
the ids of their pieces.  Decoding gathers the bytes of the ids.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated
rows and ids each give their own row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PIECES, Vocabulary, encode_matrix
from .common import tidy
from .common import texts as texts_of
from .ragged import gather, starts_of, text_groups

#: Pieces, and ids of pieces, that a task remembers; beyond it the table starts anew.
KNOWN_PIECES, KNOWN_IDS = 200_000, 2_000_000
#: Characters that are encoded at once.
GROUP = 1_000_000


class Codec:
    def __init__(self, path: str):
        self.vocabulary = Vocabulary.from_ranks(path)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, wanted: set[str]) -> None:
        new = [p for p in wanted if p not in self.index]
        if len(self.index) + len(new) > KNOWN_PIECES or len(self.ids) > KNOWN_IDS:
            self.forget()
            new = list(wanted)
        if new:
            flat, counts = encode_matrix(self.vocabulary, [p.encode() for p in new])
            self.index.update(zip(new, range(len(self.counts), len(self.counts) + len(new))))
            self.starts = np.concatenate((self.starts, starts_of(counts)[:-1] + len(self.ids)))
            self.counts = np.concatenate((self.counts, counts))
            self.ids = np.concatenate((self.ids, flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number of each."""
        pieces = [PIECES.findall(t) for t in texts]
        self.learn(set().union(*pieces))
        ends = starts_of(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(pieces)), np.int64, ends[-1])
        n = self.counts[at]
        total = starts_of(n)
        return gather(self.ids, self.starts[at], n), np.diff(total[ends])

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each row of ids."""
        v = self.vocabulary
        return split(gather(v.bytes, v.starts[flat], v.lengths[flat]), v.lengths[flat], counts)

    def decimals(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each row of ids as decimal numbers with commas between them."""
        v = self.vocabulary
        return [x[:-1] for x in split(gather(v.decimal, v.dec_starts[flat], v.dec_lengths[flat]), v.dec_lengths[flat], counts)]


def split(joined: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = starts_of(sizes)[starts_of(counts)].tolist()
    raw = joined.tobytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[slice, list[str]]]:
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for part in text_groups(size, GROUP):
        yield part, [t or "" for t in batch.column(column)[part.start : part.stop].to_pylist()]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text."""

    def run(batches):
        codec = Codec(path)
        for b in batches:
            for part, texts in groups(b, 1):
                flat, counts = codec.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(starts_of(counts).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], ids], ["doc_id", "ids"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes binary) of every row of ids; a null row decodes to no bytes."""

    def run(batches):
        codec = Codec(path)
        for b in batches:
            ids = b.column(1)
            flat = ids.flatten().to_numpy()
            counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec.decode(flat, counts), pa.binary())], ["doc_id", "bytes"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(tidy(run), "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids of every text and of what they decode to, in one pass."""

    def run(batches):
        codec = Codec(path)
        for b in batches:
            counts, coded, back = [], [], []
            for _, texts in groups(b, 1):
                flat, n = codec.encode(texts)
                counts.append(n)
                coded += [hashlib.sha256(x).hexdigest() for x in codec.decimals(flat, n)]
                back += [hashlib.sha256(x).hexdigest() for x in codec.decode(flat, n)]
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
