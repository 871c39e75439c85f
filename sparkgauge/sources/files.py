"""Files of source text, result files, and rule files.

Local paths are listed and read by the tasks of ``tree``, as names that begin with a dot or an
underscore count too and Spark's own file source leaves them out.  Paths with a scheme
(``s3://``, ``hdfs://`` and the like) are listed and read by Spark alone.
"""

from __future__ import annotations

import fnmatch
import logging
import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("sparkgauge")

SUFFIX = ".swift"
#: Names of the rule file that a folder may hold, the first that is there counts.
CONFIG_NAMES = (".sparkgauge.yml", ".sparkgauge.yaml")
#: The environment variable that sets the threshold where a caller gives none.
THRESHOLD_VARIABLE = "SPARKGAUGE_THRESHOLD"
SOURCES = "file_path string, code string"
RULES = "prefix string, suffix string, threshold int"


class SourceError(ValueError):
    """Something about the given paths, files or arguments is wrong."""


class InvalidPathError(SourceError):
    pass


class NoSourceFilesError(SourceError):
    pass


class ReadError(SourceError):
    pass


class ParseError(SourceError):
    pass


class RuleFileError(SourceError):
    pass


def resolve(path: str) -> str:
    """Absolute paths stay; others stand below the working directory, unnormalised."""
    return path if path.startswith("/") else os.path.join(os.getcwd(), path)


def is_source(path: str) -> bool:
    return path.endswith(SUFFIX)


def list_directory(folder: str, recursive: bool) -> list[str]:
    found: list[str] = []
    for top, folders, names in os.walk(folder, onerror=lambda e: log.warning("cannot list %s: %s", e.filename, e)):
        found += [os.path.join(top, n) for n in names if os.path.splitext(n)[1] == SUFFIX and os.path.isfile(os.path.join(top, n))]
        if not recursive:
            folders.clear()
    return found


def find_files(path: str, recursive: bool) -> list[str]:
    path = resolve(path)
    if not os.path.exists(path):
        raise InvalidPathError(f"no such path: {path}")
    if os.path.isdir(path):
        return list_directory(path, recursive)
    return [path] if is_source(path) else []


def expressions(patterns: Iterable[str], globs: Iterable[str] = ()) -> list[str]:
    """The expressions of which one must match somewhere in a path; invalid ones match nothing and are left out."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error as e:
            log.warning("exclude pattern %r is not a regular expression (%s) and matches nothing", p, e)
        else:
            out.append(p)
    return out + [fnmatch.translate(g) for g in globs]


def excluded(column: Column, patterns: Iterable[str], globs: Iterable[str] = ()) -> Column:
    """Whether any expression matches somewhere in the path; invalid ones match nothing."""
    out = F.lit(False)
    for p in expressions(patterns, globs):
        out = out | column.rlike(p.replace(r"\Z", r"\z"))
    return out


def chosen(paths: DataFrame, exclude: Iterable[str] = (), exclude_globs: Iterable[str] = ()) -> DataFrame:
    """The paths that are not excluded, each once, in order."""
    return paths.distinct().where(~excluded(F.col("file_path"), exclude, exclude_globs)).orderBy("file_path")


def is_remote(path: str) -> bool:
    return "://" in path


def collect_files(spark: SparkSession, paths: Iterable[str], recursive: bool = False, exclude: Iterable[str] = (), exclude_globs: Iterable[str] = ()) -> list[str]:
    """The source files of all paths, without the excluded ones, each once, in order."""
    paths = list(paths)
    if not paths:
        raise SourceError("at least one path is needed")
    every = [(f,) for p in paths for f in find_files(p, recursive)]
    files = [r.file_path for r in chosen(spark.createDataFrame(every, "file_path string"), exclude, exclude_globs).collect()]
    if not files:
        raise NoSourceFilesError("no source files found")
    return files


def scan(spark: SparkSession, folders: str | list[str], exclude: Iterable[str] = (), exclude_globs: Iterable[str] = (), recursive: bool = True) -> DataFrame:
    """(file_path, code) of trees or files in any store Spark reads, listed and read by the executors; hidden files are left out.

    A folder that is there twice, or below another one, counts once.
    """
    folders = list(dict.fromkeys([folders] if isinstance(folders, str) else folders))
    inside = (lambda f, g: f.startswith(g + "/")) if recursive else (lambda f, g: f.rpartition("/")[0] == g)
    folders = [f for f in folders if not any(inside(f, g.rstrip("/")) for g in folders)]
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", str(recursive).lower()).load(folders)
    rows = rows.where(~excluded(F.col("path"), exclude, exclude_globs))
    return rows.select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("code"))


def strings(spark: SparkSession, sources: Mapping[str, str] | Iterable[tuple[str, str]]) -> DataFrame:
    """(file_path, code) of texts in memory."""
    return spark.createDataFrame(list(sources.items() if isinstance(sources, Mapping) else sources), SOURCES)


# ---- rules


@dataclass(frozen=True)
class Rules:
    """Threshold rules by type name, and the threshold where none matches."""

    rules: tuple[tuple[str | None, str | None, int], ...] = ()
    default: int | None = None

    def __bool__(self) -> bool:
        """Whether there is anything to hold functions against; rules without entries and default filter nothing."""
        return bool(self.rules) or self.default is not None

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rules), RULES)


def rules_of(content: Any) -> Rules:
    if not isinstance(content, Mapping) or not isinstance(content.get("rules"), list):
        raise RuleFileError("a rule file is a mapping with a list of rules")
    found = []
    for r in content["rules"]:
        if not isinstance(r, Mapping) or not whole(r.get("threshold")) or any(not isinstance(r.get(k), (str, type(None))) for k in ("prefix", "suffix")):
            raise RuleFileError(f"not a rule: {r!r}")
        found.append((r.get("prefix"), r.get("suffix"), r["threshold"]))
    default = content.get("defaultThreshold")
    if default is not None and not whole(default):
        raise RuleFileError(f"not a threshold: {default!r}")
    return Rules(tuple(found), default)


def whole(x: Any) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def load_rules(path: str) -> Rules:
    import yaml

    if not os.path.exists(path):
        raise RuleFileError(f"no such file: {path}")
    try:
        with open(path, encoding="utf-8") as f:
            return rules_of(yaml.safe_load(f))
    except yaml.YAMLError as e:
        raise RuleFileError(f"cannot read {path}: {e}") from e


def discover_rules(folder: str, names: Iterable[str] = CONFIG_NAMES) -> Rules | None:
    """The rule file of a folder, if it has one under these names, the first that is there."""
    for name in names:
        if os.path.exists(path := os.path.join(folder, name)):
            return load_rules(path)
    return None


def env_threshold(default: int = 10, variable: str = THRESHOLD_VARIABLE) -> int:
    """The threshold that the environment asks for."""
    asked = os.environ.get(variable)
    try:
        return default if asked is None else int(asked)
    except ValueError:
        log.warning("%s is not a number", variable)
        return default
