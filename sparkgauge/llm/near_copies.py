"""Near copies: candidates by SimHash and by bands, held to the Jaccard similarity of five-word shingles.

Each distinct set of shingles has a fingerprint of its distinct words, which the generalised
pigeonhole search of ``simhash`` links to those that differ in MOST bits or fewer, and BANDS
keys, each of ROWS minhashes: sets that share a key are candidates too.  Both write a
number of rows a set that does not grow with the number of sets.  What chains of candidates
connect is a cluster.  Within clusters the verdict is that of the whole sets of shingles: two
texts are linked if their similarity is LIKE or more.  Every cluster is gone through pair by
pair, but a pair is measured only while nothing connects it yet, its sizes allow the
similarity, and SKETCH one-bit minhashes do not rule it out (by four standard deviations, so
some 3 in 100,000 links of the least similarity are lost there); links of a task are a forest.

A cluster goes to tasks by blocks of at most BLOCK bytes, or up to SPREAD smaller ones of PART
bytes: one task for each two blocks, so a group of copies of any size is spread, and no task
holds more than two blocks.

A pair of similarity s is a candidate by its bands with probability 1 - (1 - s^ROWS)^BANDS,
that is 0.998 at 0.8 and more above, and a pair without common shingles never is, however many
sets there are; at 0.3 it is one in 70.

Defined results: a null or empty text, or one of white space, has an empty set, and all of
these are copies of each other; a text of fewer than WORDS words is one shingle; rows without
an id stay; of rows with the same id and text one stays, while rows that share an id and
differ in their text are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, remove, small_batches, stored, tidy
from .components import components, forest
from .simhash import LOWER, links, mixed

#: Words of a shingle.
WORDS = 5
#: Links need a similarity of 4/5, that is, of sets of sizes a and b 4/9 of a + b shingles in common.
LIKE = 0.8
#: Bits in which fingerprints of candidates differ at most; so few that chance does not link unlike texts.
MOST = 2
#: Keys of a set, and minhashes in each.
BANDS, ROWS = 20, 6
#: One-bit minhashes of a set, and how many must agree: 0.9 of them do at the least similarity.
SKETCH = 256
AGREE = int(SKETCH * (1 + LIKE) / 2 - 4 * (SKETCH * (1 + LIKE) * (1 - LIKE) / 4) ** 0.5)
#: Bytes of a block of sets, and what a set counts besides its shingles.
BLOCK, EACH = 8_000_000, 2_000
#: Clusters that would need fewer blocks are spread to this many, unless these get smaller than PART.
SPREAD, PART = 10, 256_000
#: Bits of the filter of sets that have a candidate, at most.
FILTER_BITS = 1 << 27
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SALTS = np.random.default_rng(20240301).integers(0, 2**63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(text: str | None) -> np.ndarray:
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, found)), ">u8").astype(np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    if not len(words):
        return words
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = out * FACTOR + words[k : k + n]
    return np.unique(mixed(out, 5))


def fingerprint(words: np.ndarray) -> int:
    """SimHash of the distinct words, as a signed number."""
    distinct = np.unique(words)
    votes = np.zeros(64, np.int64)
    for i in range(0, len(distinct), 1 << 14):
        votes += np.unpackbits(distinct[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(distinct)).tobytes(), "big", signed=True)


def name(found: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())).astype(np.int64))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets is LIKE or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def minhashes(found: np.ndarray) -> np.ndarray:
    """One bit of the smallest hash under each salt, packed."""
    low = np.full(SKETCH, np.uint64(2**64 - 1))
    for i in range(0, len(found), 1024):
        np.minimum(low, (found[i : i + 1024, None] * SALTS).min(0), out=low)
    return np.packbits(mixed(low, 9) >> np.uint64(63) != 0).view(np.uint64)


BAND_SALTS = np.random.default_rng(20240302).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def bands(found: np.ndarray) -> np.ndarray:
    """The keys of a set, as signed numbers; those of different bands differ."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for i in range(0, len(found), 1024):
        np.minimum(low, (found[i : i + 1024, None] * BAND_SALTS).min(0), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        out = mixed(out * FACTOR + column, 11)
    return out.view(np.int64)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(node, low, size, fp, bands): each distinct set of shingles, the row that stands for it, its fingerprint and its keys.

    ``low`` is (doc_id, digest, n): the smallest id, the digest of its text, and how many rows have both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(2):
                words = word_hashes(t.as_py())
                found = shingles(words)
                out.append((name(found), len(found), fingerprint(words), bands(found).astype("<i8").tobytes()))
            node, size, fp, keys = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32()), pa.array(fp, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "digest", "node", "size", "fp", "bands"])

    rows = docs.where("doc_id is not null").mapInArrow(tidy(run), "doc_id long, digest long, node long, size int, fp long, bands binary")
    own = [F.first(c).alias(c) for c in ("size", "fp", "bands")]
    rows = rows.groupBy("node", "doc_id", "digest").agg(F.count("*").alias("n"), *own)
    return rows.groupBy("node").agg(F.min(F.struct("doc_id", "digest", "n")).alias("low"), *own)


def gathered(rows: DataFrame) -> DataFrame:
    """(a, b): from every node of (key, node) to the least that has the same key."""
    lows = rows.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(lows, "key").where("node != b").select(F.col("node").alias("a"), "b")


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b): links that connect all candidates."""
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), k -> cast(conv(hex(reverse(substring(bands, 8 * k + 1, 8))), 16, -10) as long))")
    by_bands = gathered(sets.select(F.explode(keys).alias("key"), "node"))
    prints = stored(sets.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = gathered(sets.select(F.col("fp").alias("key"), "node"))
    near = links(prints.select("fp"), MOST)
    ends = [prints.select(F.col("fp").alias(c), F.col("node").alias(f"_{c}")) for c in "ab"]
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return by_bands.unionByName(same).unionByName(near)


def clusters(sets: DataFrame) -> DataFrame:
    """(node, size, cluster) of the sets that have a candidate."""
    found = components(candidates(sets)).withColumnRenamed("label", "cluster")
    return stored(sets.join(found, "node").select("node", "size", "cluster"), "clusters")


def members_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, members) of at least the given sets; a filter of bits keeps most others from being moved."""
    spark, count = docs.sparkSession, nodes.count()
    bits = min(FILTER_BITS, 1 << max(10, (8 * count).bit_length()))
    words = nodes.select(F.expr(f"(node & {bits - 1}L) >> 6").alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    known = np.zeros(bits // 64, np.int64)
    known[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    known = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for b in batches:
            found: dict[int, bytes] = {}
            for t in b.column(0):
                s = shingles(word_hashes(t.as_py()))
                node = name(s)
                at = node & (bits - 1)
                if int(words[at >> 6]) >> (at & 63) & 1:
                    found[node] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), pa.array([*found.values()], pa.binary())], ["node", "members"])

    return docs.where("doc_id is not null").select("text").mapInArrow(tidy(run), "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))


def block_links(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of LIKE or more connect; of two blocks (``side`` 0 and 1) only those between them."""
    n, one = len(nodes), not side.any()
    label, size = np.arange(n), np.array([len(s) for s in sets], np.int64)
    bits = np.stack([minhashes(s) for s in sets]) if n else np.empty((0, SKETCH // 64), np.uint64)
    out = []
    for i in range(n - 1):
        others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        if not one:
            others = others[side[others] != side[i]]
        others = others[(5 * size[others] >= 4 * size[i]) & (5 * size[i] >= 4 * size[others])]
        agree = SKETCH - np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64)
        for j in others[agree >= AGREE][np.argsort(-agree[agree >= AGREE], kind="stable")].tolist():
            if label[i] != label[j] and alike(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                out.append((nodes[i], nodes[j]))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def verified(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): links among the sets of each cluster."""
    spark = docs.sparkSession
    weights = found.groupBy("cluster").agg(F.sum(F.expr(f"8L * size + {EACH}")).alias("weight"))
    blocks = found.join(weights, "cluster").select("node", "cluster", F.expr(f"cast(greatest(ceil(weight / {BLOCK}), least({SPREAD}, ceil(weight / {PART}))) as int)").alias("blocks"))
    rows = blocks.withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).join(members_of(docs, found.select("node")), "node")
    # a row for each two blocks that its own is one of, once with itself
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.expr("block > other").alias("side"), "node", "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, bool]] = []
        at = None

        def finish() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = block_links(np.array([x[0] for x in held], np.int64), [x[1] for x in held], np.array([x[2] for x in held]))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for b in batches:
            keys = zip(*(b.column(k).to_pylist() for k in range(3)))
            for key, side, node, members in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
                if key != at:
                    yield from finish()
                    at, held = key, []
                held.append((node, np.frombuffer(members.as_py(), np.uint64), side))
        yield from finish()

    dealt = rows.repartition(partitions(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are linked, also over others, to a row with a smaller id."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    sets = stored(distinct_texts(rows), "sets")
    found = clusters(sets)
    labels = components(verified(rows, found))
    lows = sets.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("low").alias("low"))
    kept = stored(lows.select(F.col("low.doc_id").alias("_id"), F.col("low.digest").alias("_digest"), F.col("low.n").alias("_n")), "kept")
    remove(found)

    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_digest"))
    known = whole.where("_id is not null")
    once = known.join(kept.where("_n = 1"), ["_id", "_digest"], "left_semi")
    again = known.join(kept.where("_n > 1"), ["_id", "_digest"], "left_semi").dropDuplicates(["_id", "_digest"])
    return once.unionByName(again).unionByName(whole.where("_id is null")).select("row.*")
