r"""Importance resampling towards a target: hashed word runs, gains by bucket, a seeded draw.

A streaming CRC ring finds the features: one scan of a document keeps the running CRC-32
states of its last ``n`` starts, extends each by a space and the next word, and opens a new
one; every state is the hash of a run of 1 to ``n`` words, and none of the runs is ever
built.  Counts of the buckets in all documents and in all target texts give each bucket a
gain; a document's weight is the sum of the gains of its features, and noise that follows from
seed and id alone makes the draw of the highest scores one without replacement, in
proportion to the weights.

Counts cover all rows and are summed in each task, so that a row for each bucket and task
is exchanged, and a row for each bucket reaches the driver.  Ranks are places in one order
over all tasks: rows are dealt by ranges of it, and only the sizes of the ranges meet.

Defined results: a null or empty text has no features, weight 0, and is never drawn; a null
id counts as empty in the noise and comes first among ties; rows that share an id are
scored each, those that are equal in all this in any order; other input columns are
ignored; an empty target has no counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, remove, stored, texts, tidy

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 1
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Of a hundred documents that can be drawn, so many are.
SHARE = 10
SEED = "2024"
#: Bytes of text whose words are held at once.
SLICE = 8 << 20

#: Letters A-Z become small; digits, small letters and all bytes over 0x7F stay; what else there is parts words.
FOLD = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, those of some megabytes at a time."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if at + SLICE < len(folded) else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class Ring:
    """The hashes of all runs of 1 to ``n`` words, in one scan."""

    def __init__(self, n: int):
        self.kept = n - 1
        self.states: list[int] = []

    def hashes(self, words: list[bytes]) -> list[int]:
        if not self.kept:
            return [crc32(w) for w in words]
        out: list[int] = []
        states = self.states
        for word in words:
            more = b" " + word
            states = [crc32(more, s) for s in states[-self.kept :]]
            states.append(crc32(word))
            out += states
        self.states = states
        return out


def hashed(text: bytes | None, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their features) of each slice of a text."""
    ring = Ring(n)
    for words in slices(text or b""):
        yield len(words), np.array(ring.hashes(words), np.int64) % buckets


def raw_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(docs, id_col, text_col)
    return rows.select("doc_id", F.col("text").cast("binary").alias("text"))


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket comes up in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(1):
                for _, found in hashed(text.as_py(), n, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = raw_texts(docs.select(F.lit(None).alias("id"), F.col(text_col).alias("text")), "id", "text")
    got = rows.mapInArrow(tidy(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, each count raised by one."""
    more = len(raw)
    in_raw, in_target = float(raw.sum() + more), float(target.sum() + more)
    return np.array([math.floor(1000 * math.log((t + 1.0) * in_raw / ((s + 1.0) * in_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_features, n_words, weight) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.zeros((b.num_rows, 3), np.int64)
            for i, text in enumerate(b.column(1)):
                for words, found in hashed(text.as_py(), n, len(gain)):
                    rows[i] += (len(found), words, gain[found].sum())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(3))], ["doc_id", "n_features", "n_words", "weight"])

    return raw_texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_features long, n_words long, weight long")


def noise(seed: str) -> str:
    """Gumbel noise in thousandths, from seed and id."""
    h = f"cast(conv(substring(sha2(concat('{seed}:', coalesce(cast(doc_id as string), '')), 256), 1, 8), 16, 10) as long)"
    return f"cast(floor(-1000 * ln(-ln(({h} + 0.5D) / 4294967296D))) as long)"


def ranked(scored: DataFrame, can: str, share: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... for the ``share`` in a hundred of highest score among the rows where ``can`` holds, else null."""
    spark = scored.sparkSession
    rows = stored(scored.withColumns({"_out": ~F.expr(can), "_row": F.monotonically_increasing_id()}), "scores")
    order = [F.col("_out").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("_row").asc()]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(placed.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "places")
    remove(rows)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.count_if(~F.col("_out")).alias("can")).orderBy("_part").collect()  # a row for each range
    draws = sum(r.can for r in sizes) * share // 100
    begin, before = {}, 0
    for r in sizes:
        begin[r._part] = before
        before += r.n
    starts = F.broadcast(spark.createDataFrame(list(begin.items()), "_part int, _begin long"))
    place = F.col("_begin") + F.col("_place") + 1
    return placed.join(starts, "_part").withColumn("rank", F.when(place <= draws, place)).drop("_part", "_begin", "_place", "_row", "_out")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, n: int = RUN, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; what is not drawn has no rank."""
    gain = gains(bucket_counts(docs, text_col, n, buckets), bucket_counts(target, target_col, n, buckets))
    scored = weighed(docs, gain, n, id_col, text_col).withColumn("score", F.expr(f"weight + {noise(seed)}"))
    return ranked(scored, f"n_words >= {least_words}", share).select("doc_id", "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, whole; ids are taken to be unique."""
    ids = resampled(docs, target, id_col=id_col, **how).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, docs[id_col].cast("long") == F.col("_drawn"), "left_semi")


#: The words of ``text`` in DuckDB.
WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def resampled_sql(crc_table: list[int]) -> str:
    """The same for DuckDB, with runs of one word; distinct words are hashed byte by byte."""
    return f"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS_SQL} AS w FROM documents
), word AS (
  SELECT rid, unnest(w) AS word FROM doc
), item AS (
  SELECT unnest({WORDS_SQL}) AS word FROM benchmark
), known AS (
  SELECT word FROM word UNION SELECT word FROM item
), coded AS (
  SELECT word, list_transform(range(0, length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes FROM known
), hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, {crc_table}[(xor(c, b) & 255) + 1]))) % {BUCKETS} AS bucket FROM coded
), raw AS (
  SELECT bucket, count(*) AS s FROM word JOIN hashed USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM item JOIN hashed USING (word) GROUP BY bucket
), total AS (
  SELECT (SELECT count(*) FROM word)::DOUBLE AS S_all, (SELECT count(*) FROM item)::DOUBLE AS T_all
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (S_all + {BUCKETS}) / ((s + 1)::DOUBLE * (T_all + {BUCKETS}))))::BIGINT AS gain FROM raw LEFT JOIN target USING (bucket), total
), weight AS (
  SELECT rid, count(*) AS n, sum(gain)::BIGINT AS weight FROM word JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY rid
), scored AS (
  SELECT doc.rid, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM doc LEFT JOIN weight USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS can FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= can * {SHARE} // 100 THEN place END AS rank FROM placed
"""
