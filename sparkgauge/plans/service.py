"""Requests as mappings, answers as texts: what a tool server or a web service hands on.

No server is here; each function takes the decoded arguments and gives the payload.  Wrong
types count as absent, and what goes wrong is an answer of its own, never an exception.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import InvalidPathError, Rules, SourceError, whole
from .analysis import Analysis, analyze, analyze_code, batch_analyze, rules_for
from .reports import FORMATS, format_results, render

log = logging.getLogger("sparkgauge")


@dataclass(frozen=True)
class Answer:
    """The payload of a tool, and whether it tells of an error."""

    text: str
    is_error: bool = False


# ---- arguments: a value of another type is no value


def text_of(arguments: Mapping[str, Any], name: str, default: str | None = None) -> str | None:
    found = arguments.get(name)
    return found if isinstance(found, str) else default


def texts_of(arguments: Mapping[str, Any], name: str) -> list[str] | None:
    """Items that are no texts are dropped."""
    found = arguments.get(name)
    return [x for x in found if isinstance(x, str)] if isinstance(found, (list, tuple)) else None


def flag_of(arguments: Mapping[str, Any], name: str) -> bool:
    return arguments.get(name) is True


def number_of(arguments: Mapping[str, Any], name: str) -> int | None:
    found = arguments.get(name)
    return found if whole(found) else None


def metrics_of(arguments: Mapping[str, Any], cyclomatic: str, cognitive: str) -> str:
    """One metric if only that is asked for."""
    if flag_of(arguments, cyclomatic) and flag_of(arguments, cognitive):
        raise SourceError(f"{cyclomatic} and {cognitive} exclude each other")
    return "cyclomatic" if flag_of(arguments, cyclomatic) else "cognitive" if flag_of(arguments, cognitive) else "both"


# ---- tools


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tables ``symbols`` and ``occurrences`` of an index that was written to a folder as Parquet."""
    try:
        return spark.read.parquet(f"{path}/symbols"), spark.read.parquet(f"{path}/occurrences")
    except Exception as e:
        raise InvalidPathError(f"no symbol index at {path}") from e


def analyze_paths(spark: SparkSession, arguments: Mapping[str, Any]) -> str:
    """Files on disk: ``paths``, ``recursive``, ``exclude``, ``threshold``, ``config_path``, ``format`` (json or text), one metric only, ``lcom4`` with ``index_store_path``."""
    paths = texts_of(arguments, "paths")
    if not paths:
        raise SourceError("'paths' is needed and must not be empty")
    metrics = metrics_of(arguments, "cyclomatic_only", "cognitive_only")
    store = text_of(arguments, "index_store_path")
    lcom4 = flag_of(arguments, "lcom4")
    if lcom4 and store is None:
        raise SourceError("'lcom4' needs 'index_store_path'")
    rules: Rules | None = rules_for(text_of(arguments, "config_path"))
    threshold = number_of(arguments, "threshold")
    index = open_index(spark, store) if lcom4 else (None, None)
    with analyze(spark, paths, flag_of(arguments, "recursive"), texts_of(arguments, "exclude") or (), cohesion_from="index" if lcom4 else None, symbols=index[0], occurrences=index[1]) as result:
        left = result.filtered(rules, threshold, keep_all_cohesions=True)
        return render(left, "text" if text_of(arguments, "format") == "text" else "json", rules, threshold, metrics)


def analyze_text(spark: SparkSession, arguments: Mapping[str, Any]) -> str:
    """One text: ``code``, ``file_name``."""
    code = text_of(arguments, "code")
    if code is None:
        raise SourceError("'code' is needed")
    with analyze_code(spark, code, text_of(arguments, "file_name", "<stdin>")) as result:
        return render(result, "json")


# The names by which tools are called.
TOOLS: dict[str, Callable[[SparkSession, Mapping[str, Any]], str]] = {"analyze_complexity": analyze_paths, "analyze_code_string": analyze_text}


def call_tool(spark: SparkSession, name: str, arguments: Mapping[str, Any] | None = None) -> Answer:
    if name not in TOOLS:
        return Answer(f"Error: there is no tool {name}", True)
    try:
        return Answer(TOOLS[name](spark, arguments or {}))
    except Exception as e:  # whatever it is, the caller hears of it
        log.warning("%s failed: %s", name, e)
        return Answer(f"Error: {e}", True)


# ---- web requests


def records(result: Analysis) -> list[dict]:
    return json.loads(render(result, "json"))["files"]


def formatted(spark: SparkSession, found: list[dict], request: Mapping[str, Any]) -> dict:
    fmt = text_of(request, "format")
    if fmt not in FORMATS:
        raise SourceError(f"formats are {', '.join(FORMATS)}")
    return {"formatted": format_results(spark, json.dumps({"files": found}), fmt, number_of(request, "threshold"), metrics_of(request, "showCyclomaticOnly", "showCognitiveOnly"))}


def analyze_response(spark: SparkSession, request: Mapping[str, Any]) -> dict:
    """``code`` and ``fileName``: the raw result, or the report where a ``format`` is given."""
    code, name = text_of(request, "code"), text_of(request, "fileName")
    if code is None or name is None:
        raise SourceError("'code' and 'fileName' are needed")
    with analyze_code(spark, code, name) as result:
        found = records(result)
    return {"result": found[0]} if request.get("format") is None else formatted(spark, found, request)


def batch_response(spark: SparkSession, request: Mapping[str, Any]) -> dict:
    """``files`` with ``code`` and ``path``: the raw results, by path."""
    files = [(text_of(f, "path"), text_of(f, "code")) for f in request.get("files") or () if isinstance(f, Mapping)]
    if any(None in f for f in files):
        raise SourceError("each file needs 'code' and 'path'")
    if not files:
        return {"results": []}
    with batch_analyze(spark, files) as result:
        return {"results": records(result)}


def format_response(spark: SparkSession, request: Mapping[str, Any]) -> dict:
    """``results``, as they were given, in another ``format``."""
    found = request.get("results")
    if not isinstance(found, list):
        raise SourceError("'results' is needed")
    return formatted(spark, found, request)
