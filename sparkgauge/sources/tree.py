"""Source files as a data source of Spark: ``spark.read.format("sparkgauge_tree")``.

The driver looks at the first levels of the trees only, until there are folders enough for
all tasks; each task walks its own folders and reads their files as a stream of batches, so
neither names nor texts are ever gathered.  Names that begin with a dot or an underscore
count like any others.  Excluded paths are dropped before they are read.  A file that cannot
be read fails the job, or with ``mode`` ``tolerant`` is a row with an ``error`` and no text.

Paths are names in a file system that driver and executors share; for stores with a scheme
there is ``files.scan``.
"""

from __future__ import annotations

import codecs
import logging
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import SUFFIX, InvalidPathError, ReadError, SourceError, expressions, resolve

log = logging.getLogger("sparkgauge")

SCHEMA = "file_path string, code string, error string"
ARROW = pa.schema([("file_path", pa.string()), ("code", pa.string()), ("error", pa.string())])
#: Folders that the driver looks for, unless the reader is told otherwise, and folders or files that it looks at on the way at most.
SPLITS, LOOKED_AT = 64, 10_000
#: Bytes of a batch; a longer file is a batch of its own.
BATCH = 4 << 20
#: Bytes that are read and decoded at a time.
PIECE = 1 << 20


@dataclass
class Part(InputPartition):
    """Folders to walk, or to list without their subfolders, and single files."""

    walked: tuple[str, ...] = ()
    listed: tuple[str, ...] = ()
    files: tuple[str, ...] = ()


def entries(folder: str) -> list[os.DirEntry]:
    """What a folder holds; one that cannot be listed holds nothing, with a warning."""
    try:
        with os.scandir(folder) as found:
            return sorted(found, key=lambda e: e.name)
    except OSError as e:
        log.warning("cannot list %s: %s", folder, e)
        return []


def own_files(folder: str, suffix: str) -> Iterator[str]:
    return (e.path for e in entries(folder) if os.path.splitext(e.name)[1] == suffix and e.is_file())


def subfolders(folder: str) -> Iterator[str]:
    return (e.path for e in entries(folder) if e.is_dir(follow_symlinks=False))


def text_of(path: str) -> str:
    """The text of a file, decoded piece by piece, so that of a file that is no text nothing is read behind the piece that shows it."""
    decoder, pieces, read = codecs.getincrementaldecoder("utf-8")(), [], 0
    with open(path, "rb", buffering=0) as f:
        while True:
            piece = f.read(PIECE)
            begun = read - len(decoder.getstate()[0])  # the first bytes of a letter wait for the others
            try:
                pieces.append(decoder.decode(piece, final=not piece))
            except UnicodeDecodeError as e:
                first, last = begun + e.start, begun + e.end - 1
                what = f"byte 0x{e.object[e.start]:02x} in position {first}" if first == last else f"bytes in position {first}-{last}"
                raise ReadError(f"'{e.encoding}' codec can't decode {what}: {e.reason}") from e
            if not piece:
                return "".join(pieces)
            read += len(piece)


def files_of(part: Part, suffix: str) -> Iterator[str]:
    yield from part.files
    for folder in part.listed:
        yield from own_files(folder, suffix)
    left = list(reversed(part.walked))
    while left:
        folder = left.pop()
        yield from own_files(folder, suffix)
        left.extend(reversed([*subfolders(folder)]))


def parts_of(paths: Sequence[str], recursive: bool, splits: int, suffix: str = SUFFIX) -> list[Part]:
    """Parts of the trees; a path that is there twice, or below another one, counts once."""
    folders = [p for p in dict.fromkeys(paths) if os.path.isdir(p)]
    below = lambda p: any(p.startswith(f.rstrip("/") + "/") for f in folders)
    covered = (lambda p: below(p)) if recursive else (lambda p: os.path.dirname(p) in {f.rstrip("/") for f in folders})
    files = tuple(p for p in dict.fromkeys(paths) if not os.path.isdir(p) and p.endswith(suffix) and not covered(p))
    if not recursive:
        return [Part(files=files), *(Part(listed=(f,)) for f in folders)]
    walked, listed, looked = [f for f in folders if not below(f)], [], 0
    while walked and len(walked) < splits and looked < LOOKED_AT:
        deeper = [(f, [*subfolders(f)]) for f in walked]
        looked += sum(1 + len(s) for _, s in deeper)
        listed += [f for f, _ in deeper]  # its own files; what is below it goes on
        walked = [s for _, found in deeper for s in found]
    return [Part(files=files), *(Part(listed=(f,)) for f in listed), *(Part(walked=(f,)) for f in walked)]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.splits = int(options.get("splits", SPLITS))
        self.suffix = options.get("suffix", SUFFIX)
        self.tolerant = {"strict": False, "tolerant": True}[options.get("mode", "strict")]
        self.excluded = [re.compile(p) for p in options.get("exclude", "").split("\n") if p]

    def partitions(self) -> Sequence[InputPartition]:
        return parts_of(self.paths, self.recursive, self.splits, self.suffix)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, str | None, str | None]] = []
        size = 0
        for path in files_of(part, self.suffix):
            if any(p.search(path) for p in self.excluded):
                continue
            try:
                rows.append((path, text_of(path), None))
            except (OSError, ReadError) as e:
                if not self.tolerant:
                    raise ReadError(f"cannot read {path}: {e}") from e
                rows.append((path, None, str(e)))
            size += len(rows[-1][1] or "")
            if size >= BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sparkgauge_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, paths: Iterable[str], recursive: bool = False, exclude: Iterable[str] = (), exclude_globs: Iterable[str] = (), tolerant: bool = False, suffix: str = SUFFIX) -> DataFrame:
    """(file_path, code, error) of the source files of local paths, each once."""
    found = [resolve(p) for p in paths]
    if not found:
        raise SourceError("at least one path is needed")
    for p in found:
        if not os.path.exists(p):
            raise InvalidPathError(f"no such path: {p}")
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("sparkgauge_tree").option("paths", "\n".join(found)).option("recursive", str(recursive).lower())
    reader = reader.option("exclude", "\n".join(expressions(exclude, exclude_globs))).option("mode", "tolerant" if tolerant else "strict").option("suffix", suffix)
    return reader.option("splits", max(SPLITS, 2 * spark.sparkContext.defaultParallelism)).load()
