"""Byte-pair merging on numpy arrays.

``count_merged`` works rank by rank on ragged arrays, ``encode_matrix`` on padded
matrices, one per length bucket.  Both look pairs up in a hash table that is
itself a numpy array, so no step handles one pair at a time.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex

from .ragged import gather, starts_of

NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this go through a heap; rounds over them would cost the square of their length.
LONG_PIECE = 2048
#: Cells of one padded matrix or ragged batch.
CELLS = 1 << 21

#: The published pattern that splits text before the merges, with white space as the Unicode property, as the libraries understand it.
PIECES = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class PairTable:
    """(left id, right id) -> (rank, merged id), open addressing in numpy arrays."""

    EMPTY = np.uint64(2**64 - 1)
    ODD = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, left, right, rank, merged):
        key = self.keys(np.asarray(left, np.int64), np.asarray(right, np.int64))
        bits = max(4, int(np.ceil(np.log2(4 * max(1, len(key))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key = np.full(1 << bits, self.EMPTY)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        rank, merged = np.asarray(rank, np.int32), np.asarray(merged, np.int32)
        waiting, at = np.arange(len(key)), self.slots(key)
        while len(waiting):
            free = waiting[self.key[at[waiting]] == self.EMPTY]
            place, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.key[place], self.rank[place], self.merged[place] = key[put], rank[put], merged[put]
            waiting = np.setdiff1d(waiting, put, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & self.mask

    @staticmethod
    def keys(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slots(self, key):
        return ((key * self.ODD) >> self.shift).astype(np.int64)

    def find(self, left, right):
        """Table slots of the pairs; pairs without a merge get a slot whose rank is NONE. Ids below 0 never match."""
        key = self.keys(left & 0xFFFFFFF, right & 0xFFFFFFF)
        at = self.slots(key)
        got = self.key[at]
        open_ = np.flatnonzero((got != key) & (got != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.key[at[open_]]
            open_ = open_[(got != key[open_]) & (got != self.EMPTY)]
        return at


class Vocabulary:
    """Merge table and bytes of the tokens of one tokenizer file.

    ``one_way`` tells that each token comes from one pair only, so that all places
    of a sequence's lowest pair may merge at once.
    """

    def __init__(self, tokens: list[bytes], byte_ids, pairs, one_way: bool):
        self.byte_ids = np.asarray(byte_ids, np.int32)
        self.pairs = PairTable(*pairs)
        self.one_way = one_way
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = starts_of(self.lengths)[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        decimal = [b"%d," % i for i in range(len(tokens))]
        self.dec_lengths = np.array([len(t) for t in decimal], np.int64)
        self.dec_starts = starts_of(self.dec_lengths)[:-1]
        self.decimal = np.frombuffer(b"".join(decimal), np.uint8)

    @staticmethod
    @lru_cache(2)
    def from_ranks(path: str) -> Vocabulary:
        """A rank file: each line has a token in base 64 and its rank, which is its id."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            tokens[r] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        return Vocabulary(tokens, [ranks[bytes([i])] for i in range(256)], (left, right, rank, rank), False)

    @staticmethod
    @lru_cache(2)
    def from_json(path: str) -> Vocabulary:
        """A tokenizer file with a byte-level vocabulary and a list of merges."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, to_byte = model["vocab"], {c: b for b, c in byte_letters().items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(to_byte.get(c, 63) for c in token)
        made = [vocab[a + b] for a, b in merges]
        pairs = [vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), made
        return Vocabulary(tokens, [vocab[byte_letters()[i]] for i in range(256)], pairs, len(set(made)) == len(made))


@lru_cache(1)
def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge_long(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """One long sequence: a heap of (rank, place) over a doubly linked list."""
    n, sym = len(ids), ids.tolist()
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    key, rank, merged, mask, shift, odd = v.pairs.key, v.pairs.rank, v.pairs.merged, v.pairs.mask, int(v.pairs.shift), int(v.pairs.ODD)
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def look(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in known:
            k = a << 32 | b
            at = (k * odd & 0xFFFFFFFFFFFFFFFF) >> shift
            while int(key[at]) not in (k, 0xFFFFFFFFFFFFFFFF):
                at = at + 1 & mask
            known[a, b] = (int(rank[at]), int(merged[at]))
        return known[a, b]

    slots = v.pairs.find(ids[:-1].astype(np.int64), ids[1:].astype(np.int64))
    heap = [(r, i, a, b) for i, (r, a, b) in enumerate(zip(rank[slots].tolist(), sym, sym[1:])) if r != NONE]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j < 0 or sym[i] != a or sym[j] != b:
            continue
        sym[i] = look(a, b)[1]
        alive[j] = 0
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        for p in (left[i], i):
            if p >= 0 and (q := right[p]) >= 0 and (r := look(sym[p], sym[q])[0]) != NONE:
                heapq.heappush(heap, (r, p, sym[p], sym[q]))
    return np.array([s for s, a in zip(sym, alive) if a], np.int32)


def count_merged(v: Vocabulary, pieces: list[bytes]) -> np.ndarray:
    """Number of tokens of each piece, by rank-synchronous merging of ragged arrays."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out = lengths.copy()
    for i in np.flatnonzero(lengths > LONG_PIECE):
        out[i] = len(merge_long(v, v.byte_ids[np.frombuffer(pieces[i], np.uint8)]))
    live = np.flatnonzero((lengths > 1) & (lengths <= LONG_PIECE))
    sym = v.byte_ids[np.frombuffer(b"".join([pieces[i] for i in live]), np.uint8)].astype(np.int64)
    length = lengths[live]
    while len(live):
        start = starts_of(length)
        slot = v.pairs.find(sym[:-1], sym[1:])
        rank = np.append(v.pairs.rank[slot], NONE)
        rank[start[1:] - 1] = NONE  # the last symbol of a piece has no right neighbour
        best = np.minimum.reduceat(rank, start[:-1])
        done = best == NONE
        out[live[done]] = length[done]
        hit = np.flatnonzero((rank == np.repeat(best, length)) & (rank != NONE))
        owner = np.repeat(np.arange(len(live)), length)
        if v.one_way:  # of touching hits, as in "aaa", every second one counts from the left
            run = np.concatenate(([True], np.diff(hit) != 1))
            first = np.flatnonzero(run)[np.cumsum(run) - 1] if len(hit) else hit
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        else:
            hit = hit[np.unique(owner[hit], return_index=True)[1]]
        sym[hit] = v.pairs.merged[slot[hit]]
        keep = ~np.repeat(done, length)
        keep[hit + 1] = False
        length = (length - np.bincount(owner[hit], minlength=len(live)))[~done]
        sym, live = sym[keep], live[~done]
    return out


def encode_matrix(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, flat, and the number of each; by padded matrices, one for each length bucket."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, their numbers of ids, ids
    for i in np.flatnonzero(lengths > LONG_PIECE):
        ids = merge_long(v, v.byte_ids[np.frombuffer(pieces[i], np.uint8)])
        parts.append((np.array([i]), np.array([len(ids)]), ids))
    low = 0
    for width in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 128, 256, 512, 1024, LONG_PIECE):
        rows = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        step = max(1, CELLS // width)
        for i in range(0, len(rows), step):
            parts += merge_bucket(v, [pieces[k] for k in rows[i : i + step]], rows[i : i + step], width)
    counts = np.zeros(len(pieces), np.int64)
    for row, n, _ in parts:
        counts[row] = n
    start = starts_of(counts)
    flat = np.empty(start[-1], np.int32)
    for row, n, ids in parts:
        flat[gather(np.arange(len(flat)), start[row], n)] = ids
    return flat, counts


def merge_bucket(v: Vocabulary, pieces: list[bytes], row: np.ndarray, width: int) -> list[tuple]:
    """Each round every row of the matrix loses one symbol, so the matrix loses a column; rows without a pair leave."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    sym = np.full((len(pieces), width), -1, np.int64)
    inside = np.arange(width) < length[:, None]
    sym[inside] = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = np.full((len(pieces), max(1, width - 1)), NONE, np.int32)
    if width > 1:
        pair = inside[:, 1:]
        rank[pair] = v.pairs.rank[v.pairs.find(sym[:, :-1][pair], sym[:, 1:][pair])]
    out = []
    while len(row):
        at = rank.argmin(1)
        live = rank[np.arange(len(row)), at] != NONE
        if not live.all():
            gone = ~live
            ids = sym[gone]
            ids = ids[ids >= 0].astype(np.int32)
            out.append((row[gone], length[gone], ids))
            sym, rank, at, row, length = sym[live], rank[live], at[live], row[live], length[live]
            if not len(row):
                break
        k = np.arange(len(row))
        sym[k, at] = v.pairs.merged[v.pairs.find(sym[k, at], sym[k, at + 1])]
        keep = np.ones(sym.shape, bool)
        keep[k, at + 1] = False
        sym = sym[keep].reshape(len(row), -1)
        length = length - 1
        if rank.shape[1] > 1:
            keep = np.ones(rank.shape, bool)
            keep[k, at] = False
            rank = rank[keep].reshape(len(row), -1)
            for where, a, b in ((at > 0, at - 1, at), (at + 1 < length, at, at + 1)):
                i = k[where]
                rank[i, a[where]] = v.pairs.rank[v.pairs.find(sym[i, a[where]], sym[i, b[where]])]
        else:
            rank[:] = NONE
    return out
