"""Quality classifier: a factorisation machine over hashed words and structure.

A text's features are its words, hashed, with weights that follow their counts, and the
bins of a few structure statistics, its length among them.  The score is the logistic of
w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2), which takes time
linear in the features.  The model is fitted on at most SAMPLE labelled rows outside the
held-out fold; every row is scored.

Defined results: a null or empty text has structure features only and gets a score; rows
that share an id are scored each; a null id is not held out; labels that disagree on an
id count as their smallest; without labelled rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy

#: Labelled rows that the fit takes, those of the smallest hashed ids, and their letters: a row that would go beyond these is left out with all after it, and one longer than all of them is passed over.
SAMPLE, LETTERS = 20_000, 150_000_000
FOLDS = 5
WORDS = 1 << 15
BINS = 12
STATISTICS = 10
FACTORS = 8
THRESHOLD = 0.3
KNOWN_WORDS = 300_000


def structure(text: str, words: list[str], counts: Counter) -> list[int]:
    """Bins of the statistics: sizes on a logarithmic scale, shares on a linear one."""
    n, chars = len(words), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    shares = (
        sum(w.isupper() for w in words) / max(1, n),
        sum(w[-1] in "!#$%&*|" for w in words) / max(1, n),
        sum(not any(map(str.isalpha, w[:3])) for w in words) / max(1, n),
        len(counts) / max(1, n),
        sum(a == b for a, b in zip(words, words[1:])) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        text.count("!") / chars * 5,
    )
    sizes = (math.log2(1 + n) / 20, math.log2(1 + letters / max(1, n)) / 8, math.log2(1 + n / max(1, len(lines))) / 16)
    return [min(BINS - 1, int(x * BINS)) for x in (*shares, *sizes)]


class Features:
    """Feature numbers and values of texts; all of a text's values have length one, save the structure's."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        counts = Counter(words)
        known = self.known
        for w in [w for w in counts if w not in known]:
            known[w] = zlib.crc32(w.encode("utf-8", "replace")) % WORDS
        ids = np.fromiter(map(known.__getitem__, counts), np.int32, len(counts))
        if len(known) > KNOWN_WORDS:
            known.clear()
        values = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
        values /= max(1e-6, float(np.sqrt((values * values).sum())))
        bins = np.array([WORDS + k * BINS + b for k, b in enumerate(structure(text or "", words, counts))], np.int32)
        return np.concatenate((ids, bins)), np.concatenate((values, np.full(len(bins), 0.5, np.float32)))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self, ids, values, starts):
        """Score before the logistic, and the sums that its slope needs."""
        linear = np.add.reduceat(self.weights[ids] * values, starts)
        weighted = self.factors[ids] * values[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat((weighted * weighted).sum(1), starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums

    def scores(self, ids, values, starts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.parts(ids, values, starts)[0].astype(np.float64), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adaptive gradient steps on small batches of the log loss."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATISTICS * BINS
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    if not len(rows) or labels.min() == labels.max():
        return Machine(0.0 if not len(rows) else (3.0 if labels[0] else -3.0), m.weights, m.factors * 0)
    seen_w, seen_v, seen_b = np.full(size, 1e-4, np.float32), np.full((size, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(rows), 64):
            pick = order[i : i + 64]
            ids = np.concatenate([rows[k][0] for k in pick])
            values = np.concatenate([rows[k][1] for k in pick])
            lengths = np.array([len(rows[k][0]) for k in pick])
            raw, sums = m.parts(ids, values, np.cumsum(lengths) - lengths)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)
            each = np.repeat(slope, lengths).astype(np.float32) * values
            used, at = np.unique(ids, return_inverse=True)
            grad = np.bincount(at, each, len(used)).astype(np.float32) + decay * m.weights[used]
            toward = np.repeat(sums, lengths, axis=0) - m.factors[ids] * values[:, None]
            turn = np.stack([np.bincount(at, each * toward[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32) + decay * m.factors[used]
            seen_w[used] += grad * grad
            seen_v[used] += turn * turn
            m.weights[used] -= rate * grad / np.sqrt(seen_w[used])
            m.factors[used] -= 0.3 * rate * turn / np.sqrt(seen_v[used])
            seen_b += float(slope.sum()) ** 2
            m.bias -= rate * float(slope.sum()) / math.sqrt(seen_b)
    return m


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on the labelled rows outside the held-out fold, ``sample`` of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            rows = [make.of(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "quality", "ids", "vals"])

    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where(marks.doc_id.isNotNull() & marks.quality.isNotNull() & ~held_out(marks.doc_id))
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "quality")  # at most ``sample`` rows of two numbers
    sizes = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"), F.xxhash64("doc_id").alias("h")).toPandas()  # and so are these
    sizes = sizes.sort_values(["h", "doc_id"])
    if sizes["n"].sum() > LETTERS:
        sizes = sizes[sizes["n"].fillna(0) <= LETTERS]  # one that is too long by itself is passed over
        few = sizes["doc_id"][sizes["n"].fillna(0).cumsum() <= LETTERS].tolist()
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in few], "doc_id long")), "doc_id", "left_semi")
    got = rows.mapInArrow(tidy(run), "doc_id long, quality int, ids array<int>, vals array<float>").toArrow()
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    ids, vals = got.column("ids").combine_chunks(), got.column("vals").combine_chunks()
    return fit([(ids[int(k)].values.to_numpy(), vals[int(k)].values.to_numpy()) for k in order], got.column("quality").to_numpy()[order].astype(np.float32))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    rows = texts(docs, id_col, text_col)
    machine = train(rows, labels)

    def run(batches):
        make = Features()
        for b in batches:
            scores = []
            for i in range(0, b.num_rows, 256):
                got = [make.of(t.as_py()) for t in b.column(1)[i : i + 256]]
                lengths = np.array([len(g[0]) for g in got])
                scores.append(machine.scores(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.cumsum(lengths) - lengths))
            score = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.withColumn("held_out", held_out(rows.doc_id)).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
