"""Text and number formatting, and the bands of the metrics, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space and line ends, as trimming takes them off.
SPACES = " \t\n\r\v\f\x85\xa0  "


def trimmed(c: Column, chars: str = SPACES) -> Column:
    return F.btrim(c, F.lit(chars))


def fixed(c: Column, places: int) -> Column:
    """The number with so many places, rounded as C does."""
    return F.regexp_replace(F.format_number(c.cast("double"), places), ",", "")


def padded(c: Column, width: int) -> Column:
    """Cut or filled with blanks to the width."""
    return F.rpad(c.cast("string"), width, " ")


def xml_escaped(c: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def severity(cyclomatic: Column, cognitive: Column, threshold: Column) -> Column:
    return F.when(F.greatest(cyclomatic, cognitive) > 2 * threshold, "error").otherwise("warning")


def cohesion_severity(lcom4: Column) -> Column:
    return F.when(lcom4 >= 5, "error").otherwise("warning")


def ui_band(value: Column) -> Column:
    return F.when(value > 10, "red").when(value > 5, "yellow").otherwise("green")


def risk_band(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 10, "low").when(cyclomatic <= 20, "moderate").when(cyclomatic <= 50, "high").otherwise("very high")


def cognitive_band(cognitive: Column) -> Column:
    return F.when(cognitive <= 5, "low").when(cognitive <= 10, "moderate").when(cognitive <= 15, "high").when(cognitive <= 25, "very high").otherwise("extreme")


def location_text(line: Column, column: Column) -> Column:
    return F.concat_ws(":", line.cast("string"), column.cast("string"))


def function_text(name: Column, cyclomatic: Column, cognitive: Column, line: Column, column: Column) -> Column:
    numbers = F.concat(F.lit(" - Cyclomatic: "), cyclomatic.cast("string"), F.lit(", Cognitive: "), cognitive.cast("string"))
    return F.concat(name, numbers, F.lit(" at "), location_text(line, column))


def cohesion_text(name: Column, kind: Column, lcom4: Column, level: Column) -> Column:
    return F.concat(name, F.lit(" ("), kind, F.lit("): LCOM4="), lcom4.cast("string"), F.lit(", cohesion="), level)


def cohesion_summary_text(classes: Column, average: Column, most: Column, low: Column) -> Column:
    parts = (F.lit("Cohesion Summary:"), *(F.concat(F.lit(f"  {label}: "), value) for label, value in (("Total classes", classes.cast("string")), ("Average LCOM4", fixed(average, 2)), ("Max LCOM4", most.cast("string")), ("Low cohesion classes", low.cast("string")))))
    return F.concat_ws("\n", *parts)
