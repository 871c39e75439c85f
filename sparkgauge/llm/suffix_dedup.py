"""Removal of repeated 200-byte strings by a logarithmic family of sampled suffix arrays.

Suffixes are sampled where the text itself says so: of each 200-byte window the one
whose 32 bytes have the smallest hash (leftmost of equals) among those that begin 16
to 152 bytes into it.  Equal windows choose the same place in themselves, so repeated
windows meet at suffixes that agree on 16 bytes to the left and 48 to the right.

Texts are gathered into packs.  For every pack the sampled suffixes, ordered by digests
of those 64 bytes (the short context) and of up to 200 bytes on both sides within the
document (the long context), make the suffix array of one batch; it is dealt out by
digest.  Each bucket keeps a family of levels: a new batch is scanned against all levels,
equal entries learn of each other, and a level that is not larger than the new one is
merged with it, so sizes grow geometrically.  What an entry has learned goes back to
its pack:

* a short context that has occurred before, always in the same long one, or a long
  context that has occurred before: all windows in the long context are repeated;
* a short context in several long ones: the windows that chose the suffix are digested
  themselves and go through a second family; of equal long contexts only one does.

A pack contributes each digest once, so a passage in a third of all documents is one
entry for each pack.  Packs grow with the corpus, from 2 to 16 MB, so that there are few of them.
The number of buckets follows the bytes of the corpus, so that no task holds more than a bucket of
bounded size; as many packs make one batch of a bucket as have some thousands of entries in it.

Long contexts and windows are equal if three polynomials agree, each modulo the prime 2^31 - 1
and at a base of its own: whatever two different strings of up to 400 bytes are, at most 400 of
the bases equate them in one polynomial, so fewer than one choice of bases in 2^67 in all three,
and for texts not made for it one pair in 2^93.  Over 10^12 places chance equates none.  Short
contexts have a plain digest modulo 2^64: where it errs, windows speak for themselves.

Defined results: a null or empty text has no bytes and loses none; texts under 200 bytes
are kept whole; rows that share an id are documents of their own; repeated rows are
removed entirely (from 200 bytes on), as each repeats the other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, tidy
from .common import texts as texts_of

LENGTH = 200
LEFT, SEED, CONTEXT = 16, 32, 48  # bytes before a suffix, hashed for the choice, and of the short context after it
CHOICES = LENGTH - LEFT - CONTEXT + 1  # places of a window among which it chooses
#: Bytes of text in a pack, unless one document has more: at least, at most, and how many packs there are to be between; and in one step over a pack.
PACK = 2_000_000
LARGE_PACK, MANY_PACKS = 16_000_000, 100_000
STEP = 1 << 21
#: Entries that a bucket takes as one batch.
BATCH_ENTRIES = 1 << 14

#: Bytes of text to a bucket at most; what a task holds of a bucket is about half of them, however large the corpus.
BUCKET = 64_000_000

rng = np.random.default_rng(20240229)
SYMBOLS = rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x5851F42D4C957F2D
#: The prime of the digests that tell equality, and their symbols and bases.
BITS = np.uint64(31)
PRIME = np.uint64(2**31 - 1)
PROOFS = [(rng.integers(1, 2**31 - 1, 256, np.uint64), int(rng.integers(2**20, 2**31 - 1))) for _ in range(3)]
#: Bits of the first digest of long contexts and windows, which has two of the polynomials, and of the second one, which has the third.
FIRST, SECOND = np.uint64(2**64 - 1), np.uint64(2**32 - 1)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int, modulus: int = 1 << 64) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64 or the prime."""
    kept = POWERS.get((base, modulus))
    if kept is None or len(kept) < n:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done = 1
        while done < n:
            more = min(done, n - done)
            np.multiply(out[:more], np.uint64(pow(base, done, modulus)), out=out[done : done + more])
            if modulus < 1 << 64:
                out[done : done + more] %= np.uint64(modulus)
            done += more
        kept = POWERS[base, modulus] = out
    return kept[:n]


POWERS: dict[tuple[int, int], np.ndarray] = {}


def folded(x: np.ndarray) -> np.ndarray:
    """The same residue modulo the prime in fewer bits: 33 for 63, 32 for 54."""
    high = x >> BITS
    x &= PRIME
    x += high
    return x


class Proof:
    """Digests modulo the prime of any stretch of some bytes, 2**31 at most."""

    def __init__(self, data: np.ndarray, symbols: np.ndarray, base: int):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = symbols.take(data)
        terms *= powers(base, len(data) + 1, int(PRIME))[:-1]
        np.cumsum(folded(terms), out=self.sums[1:])
        self.back = powers(pow(base, -1, int(PRIME)), len(data) + 1, int(PRIME))

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = folded(self.sums[end] - self.sums[start])
        x *= self.back[start]
        x = folded(folded(x))
        return np.minimum(x, x - PRIME)  # what is below the prime is large without it


def proofs(data: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
    """Two polynomials of every stretch in one number, and the third in another."""
    one, two, three = (Proof(data, *p).of(start, end) for p in PROOFS)
    return one | two << BITS, three


class Digests:
    """Digests of any stretch of some bytes, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SYMBOLS.take(data) * powers(BASE, len(data) + 1)[:-1], out=self.sums[1:])
        self.back = powers(pow(BASE, -1, 1 << 64), len(data) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def all(self, size: int) -> np.ndarray:
        """Of every stretch of that size, by its start."""
        return (self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size]


class Suffixes:
    """The sampled suffixes of a pack: place, short and long context (and its check), and the windows that chose each."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        self.data = data
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.n = len(data)
        parts = [self.step(at, min(self.n, at + STEP)) for at in range(0, self.n, STEP)] or [self.nothing()]
        columns = [np.concatenate(x) for x in zip(*parts)]
        place, last = columns[0], columns[5]
        again = np.flatnonzero(place[1:] == place[:-1])  # the windows of one suffix lie on both sides of a step
        last[again] = last[again + 1]
        self.place, self.short, self.long, self.check, self.first, self.last = (np.delete(x, again + 1) for x in columns)

    @staticmethod
    def nothing() -> tuple[np.ndarray, ...]:
        return np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 3, *[np.empty(0, np.int64)] * 2

    def step(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Suffixes chosen by windows that begin in start .. stop - 1."""
        low, high = max(0, start - LENGTH), min(self.n, stop + 2 * LENGTH)
        view = Digests(self.data[low:high])
        window = np.arange(start, stop)
        doc = np.searchsorted(self.ends, window, "right")
        window = window[window + LENGTH <= self.ends[doc]]
        if not len(window):
            return self.nothing()
        # the smallest hash and, in the low bits, the leftmost place that has it
        order = mixed(view.all(SEED)) & ~np.uint64((1 << 24) - 1) | np.arange(high - low - SEED + 1, dtype=np.uint64)
        reach = 1
        while 2 * reach <= CHOICES:
            order = np.minimum(order[:-reach], order[reach:])
            reach *= 2
        if reach < CHOICES:
            order = np.minimum(order[: len(order) - (CHOICES - reach)], order[CHOICES - reach :])
        chosen = (order[window + LEFT - low] & np.uint64((1 << 24) - 1)).astype(np.int64) + low
        # windows of one suffix follow each other
        head = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1))))
        tail = np.append(head[1:], len(chosen)) - 1
        place = chosen[head]
        doc = np.searchsorted(self.ends, place, "right")
        a, b = np.maximum(self.begins[doc], place - LENGTH), np.minimum(self.ends[doc], place + LENGTH)
        short = mixed(view.of(place - LEFT - low, place + CONTEXT - low), 1)
        shape = ((place - a) << 9 | (b - place)).astype(np.uint64)
        digest, check = proofs(self.data[low:high], a - low, b - low)
        long_ = mixed(mixed(digest, 2) ^ shape, 3) & FIRST
        check = (check + shape * np.uint64(0x9E3779B1)) & SECOND
        return place, short, long_, check, window[head], window[tail]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of each suffix's long context."""
        doc = np.searchsorted(self.ends, self.place, "right")
        return np.maximum(self.begins[doc], self.place - LENGTH), np.minimum(self.ends[doc], self.place + LENGTH)

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, digest and check of every window that chose one of these suffixes."""
        count = self.last[which] - self.first[which] + 1
        offset = np.cumsum(count) - count
        start = np.arange(count.sum()) - np.repeat(offset - self.first[which], count)
        digest, check = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        # only the bytes of these windows, moved together: a window lies within one stretch of them
        held = np.zeros(self.n, bool)
        for a, b in zip(self.first[which].tolist(), self.last[which].tolist()):
            held[a : b + LENGTH] = True
        data, begin = self.data[held], (np.cumsum(held) - 1)[start]
        for low in range(0, len(data), STEP):
            part = slice(*np.searchsorted(begin, (low, low + STEP)))
            view = data[low : low + STEP + LENGTH - 1]
            both = proofs(view, slice(0, len(view) - LENGTH + 1), slice(LENGTH, None)) if part.start < part.stop else ()
            for out, x in zip((digest, check), both):
                out[part] = x[begin[part] - low]
        return start, mixed(digest, 4) & FIRST, check & SECOND


MIXED = np.uint64(0)


class Levels:
    """Sorted arrays of geometrically growing sizes; every entry knows whether its key has occurred more than once.

    An entry has a key (two numbers, in order by the first), ``many``, a value (MIXED once two
    differ) and the first pack that held it.
    """

    def __init__(self):
        self.levels: list[tuple[np.ndarray, ...]] = []

    def add(self, key, check, many, value, first) -> None:
        new = (key, check, many.copy(), value.copy(), first.copy())
        for level in self.levels:
            at, hit = find(level, key, check)
            if len(hit):
                meet(level, at, new, hit)
        while self.levels and len(self.levels[-1][0]) <= len(new[0]):
            new = merge(self.levels.pop(), new)
        self.levels.append(new)

    def look(self, key, check) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """many, value and first of keys that have been added."""
        out = np.zeros(len(key), bool), np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64)
        for level in self.levels:
            at, hit = find(level, key, check)
            for column, known in zip(out, level[2:]):
                column[hit] = known[at]
        return out


def in_order(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """An order by key in which equal pairs of key and check stand together."""
    order = np.argsort(key, kind="stable")
    k, c = key[order], check[order]
    if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any():  # next to never
        order = np.lexsort((check, key))
    return order


def heads(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Whether each of the ordered pairs is the first of its kind."""
    return np.concatenate(([True], (key[1:] != key[:-1]) | (check[1:] != check[:-1])))[: len(key)]


def find(level: tuple[np.ndarray, ...], key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a level of the keys that it has, and which they are."""
    if not len(level[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, last = np.searchsorted(level[0], key), len(level[0]) - 1
    open_ = np.flatnonzero(level[0][np.minimum(at, last)] == key)
    hit = np.empty(0, np.int64)
    while len(open_):
        good = level[1][at[open_]] == check[open_]
        hit, open_ = np.concatenate((hit, open_[good])), open_[~good]
        at[open_] += 1  # the same first number with another second one
        open_ = open_[at[open_] <= last]
        open_ = open_[level[0][at[open_]] == key[open_]]
    hit.sort()
    return at[hit], hit


def meet(a, i, b, j) -> None:
    """Entries i of a and j of b have the same keys: both learn what the other knows."""
    a[2][i] = b[2][j] = True
    a[3][i] = b[3][j] = np.where(a[3][i] == b[3][j], a[3][i], MIXED)
    a[4][i] = b[4][j] = np.minimum(a[4][i], b[4][j])


def merge(a, b):
    """Two levels as one; equal keys have met before, so either entry will do."""
    both = [np.concatenate(x) for x in zip(a, b)]
    order = in_order(both[0], both[1])
    order = order[heads(both[0][order], both[1][order])]
    return tuple(x[order] for x in both)


def batch_of(key: np.ndarray, check: np.ndarray | None = None, value: np.ndarray | None = None):
    """One entry for each key of a pack, in order: key, check, many, value."""
    if check is None:
        check = np.zeros(len(key), np.uint64)
    order = in_order(key, check)
    key, check = key[order], check[order]
    head = np.flatnonzero(heads(key, check))
    size = np.diff(np.append(head, len(key)))
    if value is None:
        return key[head], check[head], size > 1, np.ones(len(head), np.uint64)
    value = value[order] | np.uint64(1)
    low = np.minimum.reduceat(value, head) if len(head) else value[:0]
    high = np.maximum.reduceat(value, head) if len(head) else value[:0]
    return key[head], check[head], size > 1, np.where(low == high, low, MIXED)


def places(entries, key: np.ndarray, check: np.ndarray | None = None) -> np.ndarray:
    """Where keys stand that are all among the entries."""
    return find(entries, key, np.zeros(len(key), np.uint64) if check is None else check)[0]


@lru_cache(maxsize=4)
def bucket_edges(buckets: int) -> np.ndarray:
    """Where each bucket begins: buckets are equal ranges of the key."""
    return np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)


def bucket_parts(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted keys fall into, and where each one's keys begin, with the end of all."""
    bucket = np.searchsorted(bucket_edges(buckets), key, "right") - 1
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(key)])
    return bucket[begin], np.append(begin, len(key))


def packed(kind: int, key, check, many, value) -> bytes:
    """Short contexts have a value and no check, the others a check and no value."""
    return b"".join(x.tobytes() for x in (key, value if kind == SHORT else check.astype(np.uint32), many))


def unpacked(kind: int, blob: bytes):
    wide = np.uint64 if kind == SHORT else np.uint32
    each = 8 + wide().itemsize
    n = len(blob) // (each + 1)
    key, other, many = np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, wide, n, 8 * n).astype(np.uint64), np.frombuffer(blob, bool, n, each * n)
    return (key, np.zeros(n, np.uint64), many, other) if kind == SHORT else (key, other, many, np.ones(n, np.uint64))


REQUEST = "bucket int, kind int, pack long, entries binary"
REPLY = "pack long, kind int, bucket int, flags binary"
SHORT, LONG, WINDOW = 0, 1, 2
#: What a pack hears of an entry: it is alone; it is repeated; it is repeated and this pack speaks for it, or, of short contexts, the long ones differ.
ALONE, REPEATED, SPOKEN = 0, 1, 2


def requests(pack: int, kind: int, entries, buckets: int) -> Iterator[dict]:
    found, bounds = bucket_parts(entries[0], buckets)
    for k, a, b in zip(found.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        yield {"bucket": k, "kind": kind, "pack": pack, "entries": packed(kind, *(x[a:b] for x in entries))}


def told(replies, kind: int, key: np.ndarray, buckets: int) -> np.ndarray:
    """The flags of a pack's sorted keys, put together from the replies of all buckets."""
    out = np.zeros(len(key), np.uint8)
    found, bounds = bucket_parts(key, buckets)
    begin = dict(zip(found.tolist(), bounds.tolist()))
    for r in replies or ():
        if r["kind"] == kind:
            flags = np.frombuffer(r["flags"], np.uint8)
            out[begin[r["bucket"]] :][: len(flags)] = flags
    return out


def one_batch(parts: list[tuple[np.ndarray, ...]], packs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The entries of several packs as one batch: key, check, many, value and first pack."""
    key, check, many, value = (np.concatenate(x) for x in zip(*parts))
    order = in_order(key, check)
    key, check, many, value, packs = (x[order] for x in (key, check, many, value, packs))
    head = np.flatnonzero(heads(key, check))
    size = np.diff(np.append(head, len(key)))
    low, high = np.minimum.reduceat(value, head), np.maximum.reduceat(value, head)
    return key[head], check[head], np.logical_or.reduceat(many, head) | (size > 1), np.where(low == high, low, MIXED), np.minimum.reduceat(packs, head)


def gathered(rows: list[tuple[int, bytes]], kind: int) -> Iterator[tuple[list[int], list[tuple[np.ndarray, ...]]]]:
    """Packs and their entries, as many at once as make a batch."""
    packs, parts, n = [], [], 0
    for pack, blob in rows:
        packs.append(pack)
        parts.append(unpacked(kind, blob))
        n += len(parts[-1][0])
        if n >= BATCH_ENTRIES:
            yield packs, parts
            packs, parts, n = [], [], 0
    if parts:
        yield packs, parts


def answered(asked: DataFrame) -> DataFrame:
    """Runs the family of each bucket over its batches, and answers each pack."""

    def answer(kind: int, bucket: int, rows: list[tuple[int, bytes]]) -> Iterator[dict]:
        family = Levels()
        for packs, parts in gathered(rows, kind):
            family.add(*one_batch(parts, np.repeat(np.array(packs, np.int64), [len(p[0]) for p in parts])))
        for packs, parts in gathered(rows, kind):
            sizes = [len(p[0]) for p in parts]
            many, value, first = family.look(*(np.concatenate(x) for x in zip(*(p[:2] for p in parts))))
            strong = value == MIXED if kind == SHORT else first == np.repeat(np.array(packs, np.int64), sizes)
            flags = np.where(many, np.where(strong, SPOKEN, REPEATED), ALONE).astype(np.uint8)
            for pack, part in zip(packs, np.split(flags, np.cumsum(sizes)[:-1])):
                if part.any():
                    yield {"pack": pack, "kind": kind, "bucket": bucket, "flags": part.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
        for (kind, bucket), group in groupby(rows, lambda r: (r[1], r[0])):
            yield from batches_of(answer(kind, bucket, [(r[2], r[3]) for r in group]), REPLY_SCHEMA)

    dealt = asked.repartition(partitions(asked.sparkSession), "kind", "bucket").sortWithinPartitions("kind", "bucket", "pack")
    return dealt.select("bucket", "kind", "pack", "entries").mapInArrow(tidy(run), REPLY)


REQUEST_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("pack", pa.int64()), ("entries", pa.binary())])
REPLY_SCHEMA = pa.schema([("pack", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])


def batches_of(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


PACKS = "pack long, ids array<long>, sizes array<int>, texts binary"
PACK_SCHEMA = pa.schema([("pack", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("texts", pa.binary())])


def make_packs(docs: DataFrame, n_bytes: int) -> DataFrame:
    """(pack, ids, sizes, texts): documents in the order they are read, their bytes compressed together."""
    most = max(PACK, min(LARGE_PACK, n_bytes // MANY_PACKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, size = [], [], 0

        def pack():
            return pa.RecordBatch.from_pylist([{"pack": number, "ids": ids, "sizes": [len(t) for t in texts], "texts": zstandard.ZstdCompressor(3).compress(b"".join(texts))}], PACK_SCHEMA)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(t) > most:
                    yield pack()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)
        if texts:
            yield pack()

    return stored(docs.mapInArrow(tidy(run), PACKS), "text-packs")


def opened(row: dict) -> Suffixes:
    raw = zstandard.ZstdDecompressor().decompress(row["texts"]) if row["texts"] else b""
    return Suffixes(np.frombuffer(raw, np.uint8), np.array(row["sizes"], np.int64))


def row_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def contexts(s: Suffixes):
    return batch_of(s.short, value=s.long ^ s.check), batch_of(s.long, s.check)


def heard(s: Suffixes, replies, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose whole long context is repeated, and those whose windows speak for themselves."""
    short, long_ = contexts(s)
    at_short, at_long = places(short, s.short), places(long_, s.long, s.check)
    short_told = told(replies, SHORT, short[0], buckets)[at_short] if len(short[0]) else np.empty(0, np.uint8)
    long_told = told(replies, LONG, long_[0], buckets)[at_long] if len(long_[0]) else np.empty(0, np.uint8)
    differ = short_told == SPOKEN
    whole = (short_told == REPEATED) | differ & (long_told != ALONE)
    first = np.zeros(len(s.long), bool)
    first[np.unique(at_long, return_index=True)[1]] = True
    return whole, differ & ((long_told == ALONE) | (long_told == SPOKEN) & first)


def repeated_bytes(s: Suffixes, replies, buckets: int) -> np.ndarray:
    """Whether each byte of the pack is covered by a repeated string."""
    edge = np.zeros(s.n + 1, np.int64)
    whole, own = heard(s, replies, buckets)
    a, b = s.spans()
    np.add.at(edge, a[whole], 1)
    np.add.at(edge, b[whole], -1)
    start, digest, check = s.windows(np.flatnonzero(own))
    if len(start):
        entries = batch_of(digest, check)
        start = start[told(replies, WINDOW, entries[0], buckets)[places(entries, digest, check)] != ALONE]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + LENGTH, -1)
    return np.cumsum(edge[:-1]) > 0


def with_replies(packs: DataFrame, replies: DataFrame) -> DataFrame:
    listed = replies.groupBy("pack").agg(F.collect_list(F.struct("kind", "bucket", "flags")).alias("replies"))
    return packs.join(listed, "pack", "left").select("pack", "ids", "sizes", "texts", "replies")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept binary, starts, ends): the remaining bytes of every document, and the maximal removed runs."""
    spark = docs.sparkSession
    docs = texts_of(docs, id_col, text_col)
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    packs = make_packs(docs, n_bytes)
    buckets = max(4 * partitions(spark), -(-n_bytes // BUCKET))

    def ask(batches):
        def rows():
            for r in row_at_a_time(batches):
                s = opened(r)
                for kind, entries in enumerate(contexts(s)):
                    yield from requests(r["pack"], kind, entries, buckets)

        yield from batches_of(rows(), REQUEST_SCHEMA)

    def ask_windows(batches):
        def rows():
            for r in row_at_a_time(batches):
                if any(x["kind"] == SHORT and SPOKEN in x["flags"] for x in r["replies"] or ()):
                    s = opened(r)
                    _, own = heard(s, r["replies"], buckets)
                    yield from requests(r["pack"], WINDOW, batch_of(*s.windows(np.flatnonzero(own))[1:]), buckets)

        yield from batches_of(rows(), REQUEST_SCHEMA)

    def finish(batches):
        for r in row_at_a_time(batches):
            raw = zstandard.ZstdDecompressor().decompress(r["texts"])
            gone = repeated_bytes(opened(r), r["replies"], buckets) if r["replies"] else np.zeros(len(raw), bool)
            data, end, out = np.frombuffer(raw, np.uint8), 0, []
            for i, n in zip(r["ids"], r["sizes"]):
                start, end = end, end + n
                flag = np.concatenate(([0], gone[start:end].view(np.int8), [0]))
                turn = np.diff(flag)
                out.append((i, n, data[start:end][~gone[start:end]].tobytes(), np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)))
            columns = zip(*out)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "kept", "starts", "ends"])

    replies = stored(answered(packs.mapInArrow(tidy(ask), REQUEST)), "replies")
    more = stored(answered(with_replies(packs, replies).mapInArrow(tidy(ask_windows), REQUEST)), "replies")
    return with_replies(packs, replies.unionByName(more)).mapInArrow(tidy(finish), "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of what is left of every document."""
    rows = repeats(docs, id_col, text_col)
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))




#: The same for DuckDB: every window by its digest.  For small tables only, as it writes each byte 200 times.
DEDUPLICATED_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), place AS (
  SELECT rid, h, unnest(range(length(h) // 2 - {LENGTH - 1})) AS s FROM doc WHERE length(h) >= {2 * LENGTH}
), window_ AS (
  SELECT rid, s, md5_number(substr(h, 2 * s + 1, {2 * LENGTH})) AS k FROM place
), many AS (
  SELECT k FROM window_ GROUP BY k HAVING count(*) > 1
), again AS (
  SELECT rid, s, s - lag(s) OVER (PARTITION BY rid ORDER BY s) AS step FROM window_ JOIN many USING (k)
), island AS (
  SELECT rid, s, sum(CASE WHEN step <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS number FROM again
), run AS (
  SELECT rid, number, min(s) AS a, max(s) + {LENGTH} AS b FROM island GROUP BY rid, number
), gap AS (
  SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM run
), kept AS (
  SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM gap JOIN doc USING (rid) GROUP BY rid
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
"""
