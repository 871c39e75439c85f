"""Token ids in files of rANS blocks.

The rows are put in ascending order of their id by a range exchange, encoded by the
tokenizers library, counted, and written as blocks that share one frequency table
(``rans``).  One row of the written Parquet files is one block with the ids and
lengths of its documents and the position of its first token, so that any block can
be read alone; Spark's writer commits whole files, and a lost task is done again.

The library encodes each distinct word once in a while: normalisation and splitting
never look across white space, so a text's ids are those of its words in a row.
Texts where lower-casing or composing could depend on context, or that hold special
strings, go to the library whole.

Defined results: a null or empty text has the end id only; equal document ids are
ordered by a hash of their text, null ids come first; an empty table gives an empty
result.
"""

from __future__ import annotations

import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import new_path, partitions, remove, stored, tidy
from .common import texts as texts_of
from .ragged import gather, starts_of, text_groups

#: Ids of a block, but a document is never cut.
BLOCK = 1 << 20
#: Words, and bytes of them, that a Python worker remembers from task to task; beyond either the table starts anew.
KNOWN_WORDS, KNOWN_BYTES = 1_500_000, 32_000_000
#: New words that the library sees at once; what it returns takes some hundred bytes a token.
AT_ONCE = 20_000
#: Characters that are encoded at once, and so the bytes of an Arrow batch: the more, the fewer words are looked up twice.
GROUP = 8_000_000
#: Tasks that add up the counts of ids.
SUMMING = 8
#: What needs the library's view of the whole text: separators that only some take for white space, special strings, letters whose lower case depends on their place.
WHOLE = ("\u03a3", "\u0130")
WHOLE_ASCII = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Characters of which a run is one piece, wherever it stands; behind letters it ends their piece.
STOPS = string.punctuation

PACKS = "part int, seq int, before long, n long, doc_ids array<long>, counts array<int>, ids binary, totals binary"


class WordCoder:
    """Ids of texts as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Known words are an Arrow array, some 12 bytes each; a word's place in it is its place in
    the arrays of where its ids start and how many they are.
    """

    kept: dict[str, WordCoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordCoder:
        """The coder of this Python worker, with the words that earlier tasks met."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids, self.n_ids = np.empty(1 << 16, np.uint16 if len(self.ends) <= 1 << 16 else np.uint32), 0
        self.starts, self.counts = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    def add(self, words: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        at, n = len(self.words), len(self.words) + len(words)
        self.words = pa.concat_arrays([self.words, words])
        self.ids, self.starts, self.counts = room(self.ids, self.n_ids + len(ids)), room(self.starts, n), room(self.counts, n)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[at:n] = starts_of(counts)[:-1] + self.n_ids
        self.counts[at:n] = counts
        self.n_ids += len(ids)

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, flat, and the number of each, from the library."""
        ids, counts = [], []
        for i in range(0, len(words), 2000):
            got = self.library.encode(words[i : i + 2000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(got.ids, np.int64))
            counts.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(words[i : i + 2000])))
        return np.concatenate(ids), np.concatenate(counts)

    def look_up_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters only, which are one piece each: a token that ends a piece ends a word."""
        parts = []
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            parts.append((ids, np.diff(last, prepend=-1)) if len(last) == len(some) else self.look_up(some))
        return tuple(map(np.concatenate, zip(*parts)))

    def learn(self, words: pa.Array) -> None:
        """Add distinct words that are not known."""
        # a word of letters and a run of stops are two pieces: each is looked up alone
        stems = pc.utf8_rtrim(words, characters=STOPS)
        letters = pc.utf8_is_alpha(stems)
        whole = pc.equal(stems, words)
        cut = pc.and_(letters, pc.invert(whole))
        cuts, stems = words.filter(cut), stems.filter(cut)
        ends = pa.array([w[len(s) :] for w, s in zip(cuts.to_pylist(), stems.to_pylist())], pa.string())
        parts = pc.unique(pa.concat_arrays([stems, ends]))
        known = found(parts, self.words)
        fresh = parts.filter(pa.array(known < 0))
        is_stem = pc.utf8_is_alpha(fresh)
        begin, new = len(self.words), []
        for mine, look in ((pa.concat_arrays([words.filter(pc.and_(letters, whole)), fresh.filter(is_stem)]), self.look_up_letters), (pa.concat_arrays([words.filter(pc.invert(letters)), fresh.filter(pc.invert(is_stem))]), self.look_up)):
            mine = pc.unique(mine)
            new.append(mine)
            if len(mine):
                self.add(mine, *look(mine.to_pylist()))
        if len(cuts):
            late = found(parts, pa.concat_arrays(new))
            place = np.where(known < 0, late + begin, known)
            halves = np.column_stack([place[found(x, parts)] for x in (stems, ends)])
            n = self.counts[halves]
            self.add(cuts, gather(self.ids, self.starts[halves].ravel(), n.ravel()), n.sum(1))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the distinct words stand in the table; unknown ones are learned, if need be in the place of all known ones."""
        at = found(words, self.words)
        missing = words.filter(pa.array(at < 0))
        if not len(missing):
            return at
        if len(self.words) + 2 * len(missing) > KNOWN_WORDS or self.words.nbytes > KNOWN_BYTES:
            self.forget()
            missing = words
        if len(missing) == len(words):
            at[:] = -1
        begin = len(self.words)  # what is learned stands behind this
        self.learn(missing)
        at[at < 0] = found(missing, self.words.slice(begin)) + begin
        return at

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [t.isascii() or not any(c in t for c in WHOLE) and unicodedata.is_normalized("NFC", t) and unicodedata.is_normalized("NFC", t.lower()) for t in texts]
        plain = [p and not any(c in t for c in WHOLE_ASCII) for p, t in zip(plain, texts)]
        split = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())))
        words = split.flatten().dictionary_encode()
        n_words = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        at = self.places(words.dictionary.cast(pa.string()))[words.indices.to_numpy()] if len(words) else np.empty(0, np.int64)
        n = self.counts[at]
        flat, ends = gather(self.ids, self.starts[at], n), starts_of(n)
        bounds = ends[starts_of(n_words)].tolist()
        out, k = [], 0
        for t, p in zip(texts, plain):
            if p:
                out.append(flat[bounds[k] : bounds[k + 1]])
                k += 1
            else:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.int64))
        return out


def found(words: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word in an array of distinct ones, or -1."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy(zero_copy_only=False).copy()


def room(x: np.ndarray, n: int) -> np.ndarray:
    """The array, or a longer copy that holds n entries."""
    if n > len(x):
        x = np.concatenate((x, np.empty(max(n, 2 * len(x)) - len(x), x.dtype)))
    return x


def squeeze(ids: np.ndarray) -> bytes:
    """The ids as 16-bit or 32-bit numbers, their bytes by place value, compressed."""
    wide = 2 if ids.max(initial=0) < 1 << 16 else 4
    planes = np.ascontiguousarray(ids.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide).T)
    return bytes([wide]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    wide = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel().astype(np.int64)


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Packs of about BLOCK ids in ascending order of the document id."""
    rows = texts_of(docs, id_col, text_col, GROUP)
    ascending = F.col("doc_id").asc_nulls_first()
    order = (ascending, F.xxhash64("text"))  # the second splits rows that share an id, or have none
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, before, size = WordCoder.of(path), TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[int | None, np.ndarray]] = []
        totals = np.zeros(max(end_id + 1, len(coder.ends)), np.int64)  # of each id in the partition

        def pack(last: bool = False):
            counts = np.array([len(x) for _, x in held], np.int32)
            ids = np.concatenate([x for _, x in held])
            totals[:] += np.bincount(ids, minlength=len(totals))
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "before": before, "n": len(ids), "doc_ids": [i for i, _ in held], "counts": counts, "ids": squeeze(ids), "totals": zstandard.ZstdCompressor(1).compress(totals.tobytes()) if last else None}], SCHEMA)

        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
            for piece in text_groups(sizes, GROUP):
                texts = [t or "" for t in b.column(1)[piece.start : piece.stop].to_pylist()]
                for i, ids in zip(b.column(0)[piece.start : piece.stop].to_pylist(), coder.encode(texts)):
                    if size >= BLOCK:  # not before the next document: the last pack also carries the totals
                        yield pack()
                        seq, before, size, held = seq + 1, before + size, 0, []
                    held.append((i, np.append(ids, ids.dtype.type(end_id))))
                    size += len(ids) + 1
        if held:
            yield pack(True)

    return rows.mapInArrow(tidy(run), PACKS)


SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("ids", pa.binary()), ("totals", pa.binary())])


def histogram(packs: DataFrame) -> rans.Table:
    """The shared table from the counts of all ids; as large as the vocabulary, whatever the corpus."""

    def run(batches):
        n = np.zeros(0, np.int64)
        for b in batches:
            for blob in b.column(0):
                more = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob.as_py()), np.int64)
                n = np.pad(n, (0, len(more) - len(n))) + more if len(more) > len(n) else n + np.pad(more, (0, len(n) - len(more)))
        symbol = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int64()), pa.array(n[symbol], pa.int64())], ["symbol", "n"])

    # one row for each partition of the corpus, so a few tasks are enough
    got = packs.where("totals is not null").select("totals").coalesce(SUMMING).mapInArrow(tidy(run), "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).toArrow()
    return rans.Table(got.column("symbol").to_numpy(), got.column("n").to_numpy())


def write_ids(docs: DataFrame, path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``out/blocks`` and ``out/table``."""
    spark = docs.sparkSession
    packs = stored(tokenised(docs, path, end_id, id_col, text_col), "packs")
    table = histogram(packs)
    spark.createDataFrame([(int(s), int(f)) for s, f in zip(table.symbols, table.freq)], "symbol long, freq long").coalesce(1).write.parquet(f"{out}/table")
    totals = dict(packs.groupBy("part").agg(F.sum("n")).toArrow().to_pandas().itertuples(index=False))  # a row for each partition
    begin = dict(zip(sorted(totals), starts_of(np.array([totals[p] for p in sorted(totals)], np.int64))[:-1].tolist()))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                block = rans.encode(table, unsqueeze(r["ids"]))
                yield pa.RecordBatch.from_pylist([{**{k: r[k] for k in ("part", "seq", "doc_ids", "counts")}, "start": begin[r["part"]] + r["before"], "block": block}], BLOCK_SCHEMA)

    packs.mapInArrow(tidy(run), BLOCKS).write.option("compression", "zstd").parquet(f"{out}/blocks")
    remove(packs)


BLOCKS = "part int, seq int, doc_ids array<long>, counts array<int>, start long, block binary"
BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("start", pa.int64()), ("block", pa.binary())])


def documents_of(spark: SparkSession, out: str, columns: str, of) -> DataFrame:
    """Rows of all documents in the files; ``of`` makes the columns after (doc_id, start) from the bytes of a block's ids and where each document's begin and end."""
    rows = spark.read.parquet(f"{out}/table").toArrow()
    table = rans.Table(rows.column("symbol").to_numpy(), rows.column("freq").to_numpy())
    names = ["doc_id", "start", *(c.split()[0] for c in columns.split(", "))]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                raw = rans.decode(table, r["block"]).astype("<u4").tobytes()
                ends = starts_of(np.array(r["counts"], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(ends[:-1] + r["start"]), *of(raw, (4 * ends).tolist())], names)

    return spark.read.parquet(f"{out}/blocks").select("doc_ids", "counts", "start", "block").mapInArrow(tidy(run), f"doc_id long, start long, {columns}")


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, ids as little-endian u32) of every document in the files."""
    return documents_of(spark, out, "ids binary", lambda raw, ends: [pa.array([raw[a:e] for a, e in zip(ends, ends[1:])], pa.binary())])


def read_range(spark: SparkSession, out: str, first: int, last: int) -> DataFrame:
    """(place, id): the ids at places ``first`` to ``last`` - 1 of the whole sequence; of their blocks only the segments that hold them are decoded."""
    rows = spark.read.parquet(f"{out}/table").toArrow()
    table = rans.Table(rows.column("symbol").to_numpy(), rows.column("freq").to_numpy())

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                a, e = max(0, first - r["start"]), min(r["n"], last - r["start"])
                while a < e:
                    segment, begin = rans.segment_of(r["block"], a)
                    ids = rans.decode(table, r["block"], segment)[a - begin : e - begin]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(ids)) + r["start"]), pa.array(ids)], ["place", "id"])
                    a += len(ids)

    blocks = spark.read.parquet(f"{out}/blocks").withColumn("n", F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))
    return blocks.where((F.col("start") < last) & (F.col("start") + F.col("n") > first)).select("start", "n", "block").mapInArrow(tidy(run), "place long, id long")


def digests(spark: SparkSession, out: str) -> DataFrame:
    """What the files hold of each document: where its ids begin, how many they are, and their CRC-32."""

    def of(raw, ends):
        view = memoryview(raw)
        return [pa.array(np.diff(ends) // 4), pa.array([zlib.crc32(view[a:e]) for a, e in zip(ends, ends[1:])], pa.int64())]

    return documents_of(spark, out, "n_tokens long, ids_crc32 long", of)


def file_round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    out = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, out, end_id)
    return digests(docs.sparkSession, out)


