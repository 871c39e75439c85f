"""From sources to metrics: what a caller asks for, and the tables that come of it."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohesion, metrics, summaries, thresholds
from ..sources import files as source_files
from ..sources.files import Rules, SourceError
from ..sources.syntax import NOT_TEXT, UNPARSED, UNREADABLE, syntax
from ..sources.tree import read_tree

log = logging.getLogger("sparkgauge")


@dataclass(frozen=True)
class Analysis:
    """Tables by file: ``files``, ``functions`` and, if cohesion was asked for, ``cohesions``."""

    files: DataFrame
    functions: DataFrame
    cohesions: DataFrame | None = None
    #: Syntax rows that stay on the executors for all tables of the analysis, until ``release``.
    held: DataFrame | None = None

    @property
    def counts(self) -> DataFrame:
        """One row with the files, functions, types and members of the run, and its failures by kind: counted where the syntax rows are kept, not by reading sources again."""
        kinds = {"files": "row = 'file'", "functions": "row = 'function'", "types": "row = 'type'", "members": "row = 'member'"}
        kinds |= {kind: f"row = 'failed' and kind = '{kind}'" for kind in (NOT_TEXT, UNREADABLE, UNPARSED)}
        return self.held.agg(*(F.count_if(F.expr(test)).alias(name) for name, test in kinds.items()))

    @property
    def failures(self) -> DataFrame:
        """The files that a tolerant run left out, and why."""
        return self.held.where("row = 'failed'").select("file_path", "kind", F.col("name").alias("reason"))

    def check(self) -> dict[str, int]:
        """The counts, also in the log; an error if there was no source file at all."""
        out = self.counts.first().asDict()
        log.info("%s", ", ".join(f"{name}: {n}" for name, n in out.items()))
        if not out["files"] + out[NOT_TEXT] + out[UNREADABLE] + out[UNPARSED]:
            raise source_files.NoSourceFilesError("no source files found")
        return out

    def release(self) -> None:
        """Let go of what the executors keep; the tables can still be read, by parsing again."""
        if self.held is not None:
            self.held.unpersist()

    def __enter__(self) -> Analysis:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @property
    def summary(self) -> DataFrame:
        return summaries.file_summary(self.files, self.functions)

    @property
    def cohesion_summary(self) -> DataFrame | None:
        return None if self.cohesions is None else summaries.cohesion_summary(self.cohesions)

    def with_thresholds(self, rules: Rules | None, threshold: int | None) -> DataFrame:
        """Functions with the threshold that holds for each."""
        spark = self.functions.sparkSession
        frame = rules.frame(spark) if rules and rules.rules else None
        return thresholds.with_threshold(self.functions, frame, threshold, rules.default if rules else None)

    def exceeded(self, rules: Rules | None = None, threshold: int | None = None) -> bool:
        """Whether any function reaches its threshold; what an exit status of 1 stands for."""
        if not rules and threshold is None:
            return False
        return thresholds.any_exceeded(self.with_thresholds(rules, threshold)).first().exceeded

    def filtered(self, rules: Rules | None = None, threshold: int | None = None, keep_all_cohesions: bool = False) -> Analysis:
        """Only exceeding functions, types of low cohesion (or all types of files that keep a function) and the files that still have either; summaries follow from what is left."""
        if not rules and threshold is None:
            return self
        functions = thresholds.exceeding(self.with_thresholds(rules, threshold)).drop("threshold")
        left, cohesions = functions.select("file_path"), self.cohesions
        if cohesions is not None:
            cohesions = cohesions if keep_all_cohesions else cohesions.where("lcom4 >= 3")
            left = left.unionByName(cohesions.select("file_path"))
        kept = self.files.join(left.distinct(), "file_path", "left_semi")
        return replace(self, files=kept, functions=functions, cohesions=cohesions)


def analyze_sources(
    sources: DataFrame,
    cohesion_from: str | None = None,
    symbols: DataFrame | None = None,
    occurrences: DataFrame | None = None,
    fold_operators: bool = False,
    tolerant: bool = False,
) -> Analysis:
    """Metrics of (file_path, code).  ``cohesion_from`` is None, ``syntax`` or ``index``; the latter needs the index's tables.  A ``tolerant`` run counts what it cannot parse, and any row with an ``error``, as ``failures``."""
    if cohesion_from not in (None, "syntax", "index"):
        raise SourceError(f"cohesion comes from 'syntax' or 'index', not {cohesion_from!r}")
    if cohesion_from == "index" and (symbols is None or occurrences is None):
        raise SourceError("cohesion from an index needs its symbols and occurrences")
    rows = syntax(sources, cohesion_from is not None, tolerant).persist(StorageLevel.MEMORY_AND_DISK)
    listed = rows.where("row = 'file'").select("file_path").withColumn("has_types", F.lit(False))
    if cohesion_from:
        has = rows.where("row = 'type'").select("file_path").distinct().withColumn("any", F.lit(True))
        listed = listed.drop("has_types").join(has, "file_path", "left").select("file_path", F.coalesce("any", F.lit(False)).alias("has_types"))
    found = None
    if cohesion_from:
        found = cohesion.cohesions(rows, *((symbols, occurrences) if cohesion_from == "index" else (None, None)))
    return Analysis(listed, metrics.function_metrics(rows, fold_operators), found, rows)


def analyze(
    spark: SparkSession,
    paths: Iterable[str],
    recursive: bool = False,
    exclude: Iterable[str] = (),
    exclude_globs: Iterable[str] = (),
    cohesion_from: str | None = None,
    symbols: DataFrame | None = None,
    occurrences: DataFrame | None = None,
    tolerant: bool = False,
) -> Analysis:
    """Metrics of the source files of the paths; those with a scheme are listed and read by Spark.

    A ``tolerant`` analysis lists local files that cannot be read, and files that cannot be parsed, as ``failures``,
    and starts no job for the guard against an empty input: ``check`` has it.
    """
    paths = list(paths)
    remote = [p for p in paths if source_files.is_remote(p)]
    local = [p for p in paths if not source_files.is_remote(p)]
    parts = []
    if remote:
        parts.append(source_files.scan(spark, remote, exclude, exclude_globs, recursive))
    if local or not remote:
        parts.append(read_tree(spark, local, recursive, exclude, exclude_globs, tolerant))
    sources = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    if not tolerant and sources.isEmpty():
        raise source_files.NoSourceFilesError("no source files found")
    return analyze_sources(sources, cohesion_from, symbols, occurrences, tolerant=tolerant)


def analyze_code(spark: SparkSession, code: str, file_path: str = "<stdin>") -> Analysis:
    """Metrics of one text."""
    return analyze_sources(source_files.strings(spark, {file_path: code}))


def batch_analyze(spark: SparkSession, sources: Mapping[str, str] | Iterable[tuple[str, str]]) -> Analysis:
    """Metrics of several texts by their names."""
    return analyze_sources(source_files.strings(spark, sources))


def rules_for(config: str | Mapping | Rules | None, folder: str | None = None) -> Rules | None:
    """Rules from a file, a mapping, or the file that a folder holds."""
    if isinstance(config, Rules):
        return config
    if isinstance(config, Mapping):
        return source_files.rules_of(config)
    if config is not None:
        return source_files.load_rules(source_files.resolve(config))
    return source_files.discover_rules(folder) if folder is not None and os.path.isdir(folder) else None
