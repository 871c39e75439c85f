"""SimHash near-duplicates by a generalised pigeonhole search.

Two fingerprints that differ in at most ``most`` bits, cut into m partitions, differ in
at most T_i bits in some partition i whenever the thresholds T_i add up to
``most - m + 1`` (a threshold of -1 leaves a partition out).  Correlated bits go into
the same partition; a dynamic programme picks the thresholds with the least estimated
work.  Each distinct fingerprint is written under the variants of its partitions;
those that meet under a variant are compared on all bits, so no pair is missed.

Variants under which more than SPREAD rows meet are refined before the exchange, up to LEVELS
times while one has more: of the other bits, cut into ``most + 1`` pieces, one at least must
be equal, and each piece becomes a key of its own.  Large keys are cut in the same way
within their task.  What stays together gathers in balls around leaders; only those that
could link two balls, by the triangle inequality, are compared further, and of the links a
spanning forest is kept, so dense groups of copies cost about as much as they have members.

Defined results: a null or empty text, or one of white space, has fingerprint zero,
linked like any other; equal ids are rows of their own that link like any others; a
null id takes part but is never a component's id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, stored, texts, tidy
from .components import components, forest

BITS = 64
ONE = np.uint64(1)
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Rows of a key that may go to one task (16 bytes each); keys with more are refined.
SPREAD = 1 << 20
#: Rows of a key that are compared all with all; more are cut by further bits, or gather in balls.
SMALL = 512
#: Cells of the sketch of how many rows each key has, at least and at most, and the most times that keys are refined.
CELLS, MOST_CELLS, LEVELS = 1 << 18, 1 << 24, 3
#: A cell of the sketch holds a SPARE-th of SPREAD rows on average, so that it is full by a large key and not by many small ones.
SPARE = 16
#: Estimated seconds to write one variant and to compare one pair.
ROW_COST, PAIR_COST = 2e-6, 1e-8


def fingerprint(text: str | None, words: int = 3, distinct: bool = False) -> bytes:
    """The fingerprint of a text, highest bit first."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return bytes(8)
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if words > 1 else found
    if distinct:
        shingles = set(shingles)
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        votes += np.unpackbits(hashes[i : i + (1 << 14)], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint(t.as_py(), words, distinct) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bits (as masks) and threshold of each partition, the allowed distance in all, and how many rows all fingerprints are written as."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    most: int
    rows: int = 0

    @property
    def cells(self) -> int:
        """Cells of the sketch: with the rows, and a power of two."""
        return min(MOST_CELLS, max(CELLS, 1 << (SPARE * self.rows // SPREAD).bit_length()))


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often each two bits are both set."""

    def run(batches):
        n, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            raw = b.column(0).to_numpy(zero_copy_only=False).astype(">i8")
            bits = np.unpackbits(raw.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64)
            n += len(bits)
            both += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([both.ravel().tolist()], pa.list_(pa.float64()))], ["n", "both"])

    rows = fps.select("fp").mapInArrow(tidy(run), "n long, both array<double>")
    sums = rows.select("n", F.posexplode("both").alias("cell", "x")).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()
    both = np.zeros(BITS * BITS)
    both[sums.column("cell").to_numpy()] = sums.column("x").to_numpy()
    return (sums.column("n")[0].as_py() if sums.num_rows else 0), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m groups of about equal size; each takes the free bits that correlate most with what it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        first = max(free, key=lambda i: (max((corr[i, j] for j in free if j != i), default=0), -i))
        group = [first]
        free.discard(first)
        while len(group) < size:
            best = max(free, key=lambda i: (corr[i, group].sum(), -i))
            group.append(best)
            free.discard(best)
        groups.append(group)
    return groups


def variants(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(radius + 1)) if radius >= 0 else 0


def allocate(n: int, both: np.ndarray, groups: list[list[int]], most: int, same: float = 1.0) -> tuple[float, tuple[int, ...]]:
    """Least estimated work and its thresholds, by a dynamic programme over the partitions; ``same`` is the share of pairs that may meet at all."""
    p = np.diag(both) / max(n, 1)
    m = len(groups)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}  # sum of (threshold + 1) so far
    for group in groups:
        near = np.zeros(len(group) + 1)  # chance of each distance within the partition, bits taken as independent
        near[0] = 1
        for i in group:
            differ = 2 * p[i] * (1 - p[i])
            near[1:] = near[1:] * (1 - differ) + near[:-1] * differ
            near[0] *= 1 - differ
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(most, 6, len(group)) + 1):
                pairs = same * n * n / 2 * near[: t + 1].sum() * (variants(len(group), t // 2) if t > 0 else t == 0)
                work = cost + ROW_COST * n * variants(len(group), (t + 1) // 2 if t >= 0 else -1) + PAIR_COST * pairs
                key = used + t + 1
                if key <= most + 1 and (key not in step or work < step[key][0]):
                    step[key] = (work, (*chosen, t))
        best = step
    return best.get(most + 1, (math.inf, (0,) * m))


def make_plan(fps: DataFrame, most: int, classes: str | None = None) -> Plan:
    n, both = bit_statistics(fps)
    same = 1.0
    if classes and n:
        same = float((fps.groupBy(classes).count().toPandas()["count"].astype(float) ** 2).sum()) / n**2
    found = []
    for m in range(1, min(most, 7) + 2):
        groups = group_bits(n, both, m)
        cost, thresholds = allocate(n, both, groups, most, same)
        found.append((cost, m, groups, thresholds))
    _, _, groups, thresholds = min(found, key=lambda x: x[:2])
    written = n * sum(variants(len(g), (t + 1) // 2) for g, t in zip(groups, thresholds) if t >= 0)
    return Plan(tuple(sum(1 << (63 - i) for i in g) for g in groups), thresholds, most, written)


@lru_cache(64)
def flips(mask: int, radius: int) -> list[np.ndarray]:
    """For each distance up to the radius, the changes of so many bits of the mask."""
    bits = [1 << i for i in range(BITS) if mask >> i & 1]
    return [np.array([sum(c) for c in combinations(bits, r)], np.uint64) for r in range(radius + 1)]


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit key of x; two finalising rounds of multiplication and shift."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(odd)
    return x ^ (x >> np.uint64(29))


def signatures(fp: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, fingerprints and partitions of all variants.

    Under threshold t both sides move up to ceil(t / 2) bits, so two that differ in t bits meet halfway.
    """
    keys, fps, parts = [], [], []
    for i, (mask, t) in enumerate(zip(plan.masks, plan.thresholds)):
        if t < 0:
            continue
        value = fp & np.uint64(mask)
        for change in flips(mask, (t + 1) // 2):
            keys.append(mixed(value[:, None] ^ change[None, :], i + 1).ravel())
            fps.append(np.repeat(fp, len(change)))
            parts.append(np.full(len(keys[-1]), i, np.int32))
    return tuple(np.concatenate(x) if x else np.empty(0, d) for x, d in ((keys, np.uint64), (fps, np.uint64), (parts, np.int32)))


@lru_cache(4096)
def pieces(mask: int, most: int) -> list[int]:
    """The bits outside ``mask`` in most + 1 pieces."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in rest[k :: most + 1]) for k in range(most + 1)]


def refined(key: np.ndarray, fp: np.ndarray, part: np.ndarray, masks: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Finer keys, one row of them for each piece of the bits that a key doesn't fix yet.

    ``part`` tells which of ``masks`` a row's key fixes; the outcome has longer rows and masks.
    """
    keys, fps, parts, masks = [key[:0]], [fp[:0]], [part[:0]], [*masks]
    for p in np.unique(part).tolist():
        at = part == p
        for j, piece in enumerate(pieces(masks[p], most)):
            keys.append(mixed(key[at] ^ mixed(fp[at] & np.uint64(piece), 101 + j), 67))
            fps.append(fp[at])
            parts.append(np.full(len(keys[-1]), len(masks), part.dtype))
            masks.append(masks[p] | piece)
    return np.concatenate(keys), np.concatenate(fps), np.concatenate(parts), masks


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def ball_links(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever chains of ``most`` bits connect among distinct fingerprints.

    Leaders take what is near them.  What lies in no ball of two or more has been compared with
    all by then; for each other ball the rest of the fingerprints that its reach allows,
    and that are not connected to it yet, are compared with its members.
    """
    label, left, balls = np.arange(len(fp)), np.arange(len(fp)), []
    while len(left):
        leader = left[0]
        near = apart(fp[left], fp[leader]) <= most
        if near.sum() > 1:
            balls.append(left[near])
            label[left[near]] = leader
        left = left[~near]
    for members in balls:
        from_leader = apart(fp, fp[members[0]])
        reach = int(from_leader[members].max())
        open_ = np.flatnonzero((from_leader <= most + reach) & (label != label[members[0]]))
        for i in range(0, len(open_), 512):
            part = open_[i : i + 512]
            part = part[label[part] != label[members[0]]]
            hit = np.zeros(len(part), bool)
            for j in range(0, len(members), 4096):
                hit |= (apart(fp[part][:, None], fp[members[j : j + 4096]][None, :]) <= most).any(1)
            for other in np.unique(label[part[hit]]).tolist():
                label[label == other] = label[members[0]]
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def cut_links(fp: np.ndarray, most: int, mask: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``ball_links``, by way of pieces of the bits outside ``mask``, of which one must be equal.

    A piece that tells the rows apart leaves small groups, whatever the number of rows;
    one that doesn't leaves rows that are alike, for which balls are cheap.
    """
    out_a, out_b = [fp[:0]], [fp[:0]]
    for piece in pieces(mask, most):
        value = fp & np.uint64(piece)
        order = np.argsort(value, kind="stable")
        a, b = linked(value[order], fp[order], most, mask | piece, len(fp))
        out_a.append(a), out_b.append(b)
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def linked(key: np.ndarray, fp: np.ndarray, most: int, mask: int = 0, of: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows that share a key; rows are sorted by key.

    Large keys are cut again, unless few bits are left or ``of``, the rows that were cut last, are hardly more.
    """
    if not len(key):
        return fp[:0], fp[:0]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    out_a, out_b = [fp[:0]], [fp[:0]]
    enough = (BITS - mask.bit_count()) // (most + 1) >= 8
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        a, b = cut_links(fp[at : at + n], most, mask) if enough and (not of or 2 * n < of) else ball_links(fp[at : at + n], most)
        out_a.append(a), out_b.append(b)
    small = np.repeat(size <= SMALL, size)
    key, fp = key[small], fp[small]
    at, step = np.arange(len(key)), 1
    while True:
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        if not len(at):
            break
        near = apart(fp[at], fp[at + step]) <= most
        out_a.append(fp[at[near]]), out_b.append(fp[at[near] + step])
        step += 1
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return forest(a[a != b], b[a != b])


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches that are sorted by the first one, cut so that rows of a key stay together."""
    held: list[tuple[np.ndarray, ...]] = []  # a key's rows may go on in the next batch: the last key of a batch waits
    for b in batches:
        new = tuple(c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(new[0]):
            continue
        if not held or new[0][-1] != held[-1][0][-1]:
            cut = int(np.searchsorted(new[0], new[0][-1]))
            ready = [*held, tuple(x[:cut] for x in new)]
            yield tuple(np.concatenate(x) for x in zip(*ready))
            held, new = [], tuple(x[cut:] for x in new)
        held.append(new)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def links(fps: DataFrame, most: int, classes: str | None = None) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp`` that differ in 1 to ``most`` bits; a spanning forest per task.

    With a column of ``classes`` (few whole numbers), only fingerprints that share one are linked; a fingerprint may have several.
    """
    plan = make_plan(fps, most, classes)
    rows = fps.select("fp", (F.col(classes) if classes else F.lit(0)).cast("long").alias("class"))

    def keyed(batches, levels: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for b in batches:
            every = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            own = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            # class by class, as signatures come in another order than their fingerprints
            for c, i in ((c, i) for c in np.unique(own).tolist() for i in range(0, int((own == c).sum()), 4096)):
                key, f, part = signatures(every[own == c][i : i + 4096], plan)
                masks = [*plan.masks]
                if c:
                    key = mixed(key, 1000 + c)
                for cells in levels:
                    hot = cells[(key & np.uint64(len(cells) - 1)).astype(np.int64)] > SPREAD
                    if hot.any():
                        finer = refined(key[hot], f[hot], part[hot], masks, plan.most)
                        key, f, part = (np.concatenate((x[~hot], y)) for x, y in zip((key, f, part), finer))
                        masks = finer[3]
                yield key, f

    def counted(levels: list[np.ndarray]) -> np.ndarray:
        """Rows by key, hashed into cells."""

        def run(batches):
            cells = np.zeros(plan.cells, np.int64)
            for key, _ in keyed(batches, levels):
                np.add.at(cells, (key & np.uint64(len(cells) - 1)).astype(np.int64), 1)
            at = np.flatnonzero(cells)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

        got = rows.mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
        cells = np.zeros(plan.cells, np.int64)
        cells[got.column("cell").to_numpy()] = got.column("n").to_numpy()
        return cells

    def emit(levels: list[np.ndarray]):
        def run(batches):
            for key, f in keyed(batches, levels):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f.view(np.int64))], ["key", "fp"])

        return run

    def compare(batches):
        for key, fp in whole_keys(batches):
            a, c = linked(key, fp.view(np.uint64), plan.most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], ["a", "b"])

    levels: list[np.ndarray] = []
    while len(levels) < LEVELS:
        cells = counted(levels)
        if cells.max(initial=0) <= SPREAD:
            break
        levels.append(cells)
    sigs = rows.mapInArrow(tidy(emit(levels)), "key long, fp long")
    return sigs.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key").mapInArrow(tidy(compare), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2, distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = stored(fingerprints(docs, words, distinct, id_col, text_col), "fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    found = components(links(nodes, most)).withColumnRenamed("node", "fp")
    nodes = nodes.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    lows = stored(nodes.groupBy("label").agg(F.min("low").alias("component_id")), "lows")  # read on its own, so that a join of a very large group can be split
    ids = nodes.join(lows, "label").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def near_duplicates_sql(words: int = 3, most: int = 2, seed: int = 42) -> str:
    """The same for DuckDB: XXH64 step by step on each distinct shingle, then all fingerprints with all.

    A hash is a fold over steps {k, a}: xor with a, add a, times a, rotate left by log2(a), xor with itself shifted right by log2(a).
    """
    p1, p2, p3, p4, p5 = PRIMES
    full = f"{1 << 64}::UHUGEINT"

    def wide(x: str) -> str:
        return f"({x})::UHUGEINT"

    def number(x: int) -> str:
        return f"{x % (1 << 64)}::UBIGINT"

    def times(x: str, by: str) -> str:
        return f"({wide(x)} * {by} % {full})::UBIGINT"

    def turned(x: str, by: str) -> str:
        return f"({wide(x)} * {by} % {full} + {wide(x)} * {by} // {full})::UBIGINT"

    def step(k: int, a: str) -> str:
        return f"{{'k': {k}, 'a': {a}}}"

    def own_round(x: str) -> str:
        return times(turned(times(x, str(p2)), str(1 << 31)), str(p1))

    def fold(first: str, steps: str) -> str:
        after = f"CASE o.k WHEN 0 THEN xor(q.a, o.a) WHEN 1 THEN (({wide('q.a')} + o.a) % {full})::UBIGINT WHEN 2 THEN {times('q.a', 'o.a')} WHEN 3 THEN {turned('q.a', 'o.a')} ELSE xor(q.a, q.a // o.a) END"
        return f"list_reduce(list_prepend({step(0, first)}, {steps}), lambda q, o: {{'k': 0, 'a': {after}}}).a"

    mixed_in = "[" + ", ".join((step(0, "@"), step(2, number(p1)), step(1, number(p4)))) + "]"
    lane = "[" + ", ".join((step(0, own_round("x")), step(3, number(1 << 27)), step(2, number(p1)), step(1, number(p4)))) + "]"
    four = "[" + ", ".join((step(0, times("x", str(p1))), step(3, number(1 << 23)), step(2, number(p2)), step(1, number(p3)))) + "]"
    one = "[" + ", ".join((step(0, times("x", str(p5))), step(3, number(1 << 11)), step(2, number(p1)))) + "]"
    last = "[" + ", ".join((step(4, number(1 << 33)), step(2, number(p2)), step(4, number(1 << 29)), step(2, number(p3)), step(4, number(1 << 32)))) + "]"
    stripe = "[" + ", ".join((step(1, times("lanes[4 * t + @]", str(p2))), step(3, number(1 << 31)), step(2, number(p1)))) + "]"
    begins = (seed + p1 + p2, seed + p2, seed, seed - p1)
    none = "[]::STRUCT(k INTEGER, a UBIGINT)[]"
    little = "('0x' || array_to_string(list_reverse({}), ''))::UBIGINT"
    windows = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) END"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), shingle AS (
  SELECT rid, unnest({windows}) AS s FROM doc
), spelled AS (
  SELECT s, octet_length(encode(s)) AS n, list_transform(range(0, octet_length(encode(s))), lambda i: substr(hex(encode(s)), 2 * i + 1, 2)) AS b FROM (SELECT DISTINCT s FROM shingle)
), laned AS (
  SELECT *, n // 32 AS stripes, list_transform(range(0, n // 8), lambda i: {little.format("b[8 * i + 1 : 8 * i + 8]")}) AS lanes FROM spelled
), striped AS (
  SELECT *, {", ".join(fold(number(v), f"flatten(list_transform(range(0, stripes), lambda t: {stripe.replace("@", str(j + 1))}))") + f" AS v{j}" for j, v in enumerate(begins))} FROM laned
), hashed AS (
  SELECT s, {fold(f"CASE WHEN n < 32 THEN {number(seed + p5)} ELSE (({' + '.join(wide(turned(f'v{j}', str(1 << k))) for j, k in enumerate((1, 7, 12, 18)))}) % {full})::UBIGINT END",
    f"CASE WHEN n < 32 THEN {none} ELSE flatten([{', '.join(mixed_in.replace('@', own_round(f'v{j}')) for j in range(4))}]) END || [{step(1, 'n::UBIGINT')}] || flatten(list_transform(lanes[4 * stripes + 1 :], lambda x: {lane}))"
    f" || CASE WHEN n % 8 < 4 THEN {none} ELSE flatten(list_transform([{little.format('b[n - n % 8 + 1 : n - n % 8 + 4]')}], lambda x: {four})) END"
    f" || flatten(list_transform(list_transform(b[n - n % 4 + 1 :], lambda y: ('0x' || y)::UBIGINT), lambda x: {one})) || {last}")} AS h FROM striped
), counted AS (
  SELECT rid, count(*) AS n, {", ".join(f"count(*) FILTER (h // {1 << k}::UBIGINT % 2 = 1) AS n{k}" for k in range(BITS))} FROM shingle JOIN hashed USING (s) GROUP BY rid
), printed AS (
  SELECT doc_id, coalesce({" + ".join(f"CASE WHEN 2 * n{k} > n THEN {1 << k}::UHUGEINT ELSE 0 END" for k in range(BITS))}, 0)::UBIGINT AS fp FROM doc LEFT JOIN counted USING (rid)
), node AS (
  SELECT fp, min(doc_id) AS low FROM printed GROUP BY fp
), link AS (
  SELECT a.fp AS x, b.fp AS y FROM node a JOIN node b ON bit_count(xor(a.fp, b.fp)) <= {most}
), reach(x, y) AS (
  SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
), label AS (
  SELECT x AS fp, min(low) AS component_id FROM reach JOIN node ON node.fp = reach.y GROUP BY x
)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM printed JOIN label USING (fp)
"""


NEAR_DUPLICATES_SQL = near_duplicates_sql()
