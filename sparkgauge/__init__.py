"""Code metrics on Spark: parse once, then plain DataFrame plans."""

from .plans.analysis import Analysis, analyze, analyze_code, analyze_sources, batch_analyze, rules_for
from .plans.reports import format_results, read_results, render, report_rows
from .sources.files import InvalidPathError, NoSourceFilesError, ReadError, RuleFileError, Rules, SourceError

__all__ = [
    "Analysis",
    "InvalidPathError",
    "NoSourceFilesError",
    "ReadError",
    "RuleFileError",
    "Rules",
    "SourceError",
    "analyze",
    "analyze_code",
    "analyze_sources",
    "batch_analyze",
    "format_results",
    "read_results",
    "render",
    "report_rows",
    "rules_for",
]
