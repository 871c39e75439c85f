r"""Language identification by unigrams over a fixed vocabulary, summed over all segmentations.

A word, its begin marked, can be cut into pieces of a public vocabulary in many ways.  Each
language has a probability for each piece; a forward algorithm sums the products over all
ways to cut a word, and a text's likelihood is the product over its words.  A character that
no piece holds is cut into the vocabulary's bytes.

The probabilities are learned in one pass over the learning documents: each word's expected
pieces, if all ways to cut it were weighed by a uniform model, counted for the word's
language.  Expectations are whole numbers of 1 / UNIT, so sums do not depend on the dealing
of rows.  A task remembers a bounded number of words, counts of a language and piece meet in
an exchange, and the model, languages times pieces, goes to the executors; its size is
checked.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every
text if there is nothing to learn from; a null id is never held out; rows that share an id
are judged each; ties go to the first language by name; languages, null ones left out, are
values as they stand; other input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, tidy

FOLDS, HELD_OUT = 4, 2
#: Languages of a model; more would not fit beside a task, and raise an error.
LANGUAGES = 1000
#: What a piece that a language never shows counts, in expected pieces.
SMOOTH = 0.05
#: Expected pieces are counted in parts of 1 / UNIT.
UNIT = 1 << 16
#: Words that a task remembers; beyond it the table starts anew.
KNOWN_WORDS = 600_000
#: Cells of word, place and length that are worked on at once.
CELLS = 1 << 21
#: Words of a text that are held at once, and characters of one whose words are found at once.
SLICE = 1 << 17
UNKNOWN = "und"

RUNS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Iterator[list[str]]:
    """The words of a text in small letters, some at a time."""
    if len(text) <= SLICE:
        yield RUNS.findall(text.lower())
        return
    found = RUNS.finditer(text.lower())
    while words := [m[0] for m in islice(found, SLICE)]:
        yield words


def lettered(word: str) -> bool:
    return any(map(str.isalpha, word))


class Pieces:
    """The pieces of a vocabulary, and all ways to find them in words."""

    #: Of the polynomial that finds beginnings of pieces; what it finds is compared.
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if re.fullmatch("<0x[0-9A-F]{2}>", p)}
        self.ids = {p: i for i, p in enumerate(pieces) if not re.fullmatch("<.*>", p)}
        self.longest = max(map(len, self.ids), default=1)
        begins: list[dict[str, int]] = [{} for _ in range(self.longest + 1)]  # of pieces, by length, with the piece's number or -1
        for piece in self.ids:
            for k in range(1, len(piece)):
                begins[k].setdefault(piece[:k], -1)
            begins[len(piece)][piece] = self.ids[piece]
        self.begins = [self.sorted(k, found) for k, found in enumerate(begins)]

    def sorted(self, k: int, found: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, with numbers and characters."""
        codes = np.array([*found], f"U{max(1, k)}").view(np.uint32).reshape(len(found), max(1, k))
        hashes = np.zeros(len(found), np.uint64)
        for i in range(k):
            hashes = hashes * self.BASE + codes[:, i]
        order = np.argsort(hashes)
        return hashes[order], np.array([*found.values()], np.int32)[order], codes[order]

    @staticmethod
    @lru_cache(2)
    def of(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return Pieces([model.id_to_piece(i) for i in range(model.get_piece_size())])

    def cells(self, words: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """For words of one length: the number of the piece that begins at each place with each length, or -1; numbers from ``size`` on are characters that are cut into bytes, listed with them."""
        n = len(words[0])
        codes = np.array(words, f"U{n}").view(np.uint32).reshape(len(words), n)
        flat, width = codes.ravel(), min(n, self.longest)
        out = np.full((len(words) * n, width), -1, np.int32)
        at, place = np.arange(len(flat)), np.tile(np.arange(n), len(words))  # where pieces may begin that are longer than those found
        h = np.zeros(len(flat), np.uint64)
        for k in range(1, width + 1):
            room = place + k <= n
            at, place, h = at[room], place[room], h[room]
            h = h * self.BASE + flat[at + k - 1]
            hashes, numbers, begins = self.begins[k]
            if not len(hashes) or not len(at):
                break
            row = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[row] == h
            at, place, h, row = at[same], place[same], h[same], row[same]
            same = (flat[at[:, None] + np.arange(k)] == begins[row]).all(1)
            at, place, h, row = at[same], place[same], h[same], row[same]
            out[at, k - 1] = numbers[row]
        unknown = np.flatnonzero(out[:, 0] < 0)
        chars, which = np.unique(flat[unknown], return_inverse=True)
        out[unknown, 0] = self.size + which
        return out.reshape(len(words), n, width), [[self.bytes[b] for b in chr(c).encode() if b in self.bytes] for c in chars]

    def batches(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray, list[list[int]]]]:
        """(places in ``words``, cells, spelled) of words of one length each; the begin of a word is marked."""
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for n, places in by_length.items():
            most = max(1, CELLS // (n * min(n, self.longest)))
            for i in range(0, len(places), most):
                part = places[i : i + most]
                yield part, *self.cells(["▁" + words[k] for k in part])


def with_spelled(logs: np.ndarray, spelled: list[list[int]]) -> np.ndarray:
    """Logarithms by language and piece, with those of the spelled characters, and of no piece at the end."""
    more = [logs[:, ids].sum(1) for ids in spelled]
    return np.column_stack([logs, *more, np.full(len(logs), -np.inf)])


def forward(cells: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Logarithms of the sums over all ways to cut the first places of each word, by language, place and word."""
    count, n, width = cells.shape
    out = np.zeros((len(logs), n + 1, count))
    with np.errstate(divide="ignore"):
        for j in range(1, n + 1):
            total = np.zeros((len(logs), count))
            for length in range(1, min(j, width) + 1):
                total += np.exp(logs[:, cells[:, j - length, length - 1]] + (out[:, j - length] - out[:, j - 1]))
            out[:, j] = out[:, j - 1] + np.log(total)
    return out


def expected(cells: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """How often each cell is a piece of its word, over all ways to cut it, under one model."""
    count, n, width = cells.shape
    ahead = forward(cells, logs)[0]
    share = np.zeros((n + 1, count))
    share[n] = 1
    out = np.zeros(cells.shape)
    for i in range(n - 1, -1, -1):
        for length in range(1, min(n - i, width) + 1):
            part = np.exp(logs[0, cells[:, i, length - 1]] + ahead[i] - ahead[i + length]) * share[i + length]
            out[:, i, length - 1] = part
            share[i] += part
    return out


class Counts:
    """Expected pieces by language, from words that are gathered first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.words: dict[str, Counter] = {}
        self.held = 0
        self.totals: dict[str, np.ndarray] = {}

    def add(self, lang: str, words: list[str]) -> None:
        own = self.words.setdefault(lang, Counter())
        before = len(own)
        own.update(words)
        self.held += len(own) - before
        if self.held > KNOWN_WORDS:
            self.settle()

    def settle(self) -> None:
        """Turn the gathered words into pieces."""
        words = [w for w in set().union(*self.words.values()) if lettered(w)]
        langs = list(self.words)
        times = {lang: np.array([own[w] for w in words], np.float64) for lang, own in self.words.items()}
        uniform = np.full((1, self.pieces.size), -np.log(max(1, self.pieces.size)))
        for places, cells, spelled in self.pieces.batches(words):
            parts = np.rint(expected(cells, with_spelled(uniform, spelled)) * UNIT)
            k, i, length = np.nonzero(parts)
            piece, part = cells[k, i, length], parts[k, i, length]
            for lang in langs:
                n = np.bincount(piece, part * times[lang][places][k], self.pieces.size + len(spelled))
                for extra, ids in enumerate(spelled, self.pieces.size):
                    np.add.at(n, ids, n[extra])
                own = self.totals.setdefault(lang, np.zeros(self.pieces.size, np.int64))
                own += n[: self.pieces.size].astype(np.int64)
        self.words, self.held = {}, 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


class Model:
    """Languages with the logarithm of each one's share and of each of its pieces."""

    def __init__(self, languages: list[str], priors: np.ndarray, logs: np.ndarray):
        self.languages, self.priors, self.logs = languages, priors, logs


def train(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all documents that are not held out and have a language; a row for each language and piece reaches the driver."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    many = rows.groupBy("lang").count().limit(LANGUAGES + 1).toPandas().sort_values("lang")
    if len(many) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(Pieces.of(path))
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for words in words_of(text.as_py() or ""):
                    counts.add(lang, words)
        counts.settle()
        for lang, n in counts.totals.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(n[used])], ["lang", "piece", "n"])

    found = rows.mapInArrow(tidy(run), "lang string, piece long, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
    languages = many["lang"].tolist()
    n = np.full((len(languages), Pieces.of(path).size), SMOOTH)
    place = {lang: i for i, lang in enumerate(languages)}
    np.add.at(n, ([place[x] for x in found.column("lang").to_pylist()], found.column("piece").to_numpy()), found.column("n").to_numpy() / UNIT)
    priors = many["count"].to_numpy(np.float64)
    return Model(languages, np.log(priors / max(1.0, priors.sum())), np.log(n / n.sum(1, keepdims=True)))


class Scorer:
    """Posteriors of texts; words that a task has met are not worked out again."""

    def __init__(self, model: Model, pieces: Pieces):
        self.model, self.pieces = model, pieces
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(self.model.languages) + 1))

    def learn(self, words: list[str]) -> None:
        """Logarithms of the words by language, and whether they hold a letter; one without counts for none."""
        real = [w for w in words if lettered(w)]
        new = np.zeros((len(words), len(self.model.languages) + 1))
        order = {w: k for k, w in enumerate(words)}
        for places, cells, spelled in self.pieces.batches(real):
            rows = [order[real[k]] for k in places]
            new[rows, :-1] = forward(cells, with_spelled(self.model.logs, spelled))[:, -1].T
            new[rows, -1] = 1
        base = len(self.known)
        self.known.update((w, base + k) for k, w in enumerate(words))
        self.values = np.concatenate([self.values, new])

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """By text: the logarithms of its likelihoods, and how many words it has."""
        out = np.zeros((len(texts), len(self.model.languages) + 1))
        found = ((k, words) for k, text in enumerate(texts) for words in words_of(text or ""))
        while held := list(islice(found, 512)):
            wanted = set().union(*(words for _, words in held))
            if len(self.known) + len(wanted) > KNOWN_WORDS:
                self.forget()
            self.learn([w for w in wanted if w not in self.known])
            for k, words in held:
                out[k] += self.values[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(0)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums = self.sums(texts)
        if not self.model.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        logs = sums[:, :-1] + self.model.priors
        best = logs.argmax(1)
        score = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        some = sums[:, -1] > 0
        return [self.model.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, score, 0.0)


def predicted(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = texts(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, path, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, Pieces.of(path))
        for b in batches:
            langs, scores = scorer.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.withColumn("held_out", held_out(rows.doc_id)).mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")
