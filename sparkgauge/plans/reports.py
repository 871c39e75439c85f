"""Reports: text, JSON, XML and diagnostics, built row by row and joined per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cohesion_severity, cohesion_summary_text, cohesion_text, fixed, function_text, padded, severity, xml_escaped
from ..sources.files import Rules, SourceError, env_threshold
from .analysis import Analysis

# Titles, widths, element names and messages of the formats below are what readers of the reports expect.
FORMATS = ("text", "json", "xml", "xcode")
METRICS = {"both": ("cyclomatic", "cognitive"), "cyclomatic": ("cyclomatic",), "cognitive": ("cognitive",)}
TITLES = {"cyclomatic": "Cyclomatic", "cognitive": "Cognitive "}
FALLBACK_THRESHOLD = 10


def joined(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """(file_path, name): the lines of a file in source order."""
    lines = rows.select("file_path", F.struct("pos", text.alias("line")).alias("item"))
    return lines.groupBy("file_path").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("item")), lambda x: x["line"])).alias(name))


def text_row(metrics: str) -> Column:
    """A function's row of the table."""
    cells = [padded(F.col("name"), 20), *(padded(F.col(m), 10) for m in METRICS[metrics])]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |\n"))


def text_summary(metrics: str) -> Column:
    parts = [F.concat(F.lit("Total: "), F.col("total_functions").cast("string"), F.lit(" functions"))]
    parts += [F.concat(F.lit(f"Average {TITLES[m].strip()}: "), fixed(F.col(f"avg_{m}"), 1)) for m in METRICS[metrics]]
    return F.concat(F.concat_ws(", ", *parts), F.lit("\n"))


def text_frame(metrics: str) -> tuple[str, str]:
    """The heading of a file's table of functions, and the line below and above its rows."""
    columns = METRICS[metrics]
    head = "| " + " | ".join([f"{'Function/Method':<20}", *(TITLES[m] for m in columns)]) + " |\n"
    return head, "+" + "-" * 22 + "+" + ("-" * 12 + "+") * len(columns) + "\n"


WIDTHS = (("name", 25), ("type", 6), ("lcom4", 5), ("method_count", 7), ("property_count", 10), ("cohesion_level", 10))
CLASS_TITLES = ("Class/Struct", "Type", "LCOM4", "Methods", "Properties", "Cohesion")
CLASS_HEAD = "Class Cohesion (LCOM4):\n| " + " | ".join(f"{t:<{w}}" for t, (_, w) in zip(CLASS_TITLES, WIDTHS)) + " |\n"
CLASS_LINE = "+" + "".join("-" * (w + 2) + "+" for _, w in WIDTHS) + "\n"


def class_row() -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(padded(F.col(c), w) for c, w in WIDTHS)), F.lit(" |\n"))


def class_total() -> Column:
    return F.concat(F.lit("Total: "), F.coalesce("total_classes", F.lit(0)).cast("string"), F.lit(" classes, Average LCOM4: "), fixed(F.coalesce("avg_lcom4", F.lit(0.0)), 2), F.lit(", Low cohesion: "), F.coalesce("low_classes", F.lit(0)).cast("string"), F.lit("\n"))


def metrics_named(metrics: str) -> str:
    if metrics not in METRICS:
        raise SourceError(f"metrics are one of {', '.join(METRICS)}")
    return metrics


def text_report(result: Analysis, metrics: str = "both") -> DataFrame:
    """(file_path, report) of every file with functions or types."""
    head, rule = text_frame(metrics_named(metrics))
    rows = joined(result.functions, text_row(metrics), "rows")
    out = result.files.join(rows, "file_path", "left").join(result.summary, "file_path")
    functions = F.when(F.col("rows").isNotNull(), F.concat(F.lit(head + rule), F.col("rows"), F.lit(rule), text_summary(metrics)))
    sections = [F.concat(F.lit("File: "), F.col("file_path")), functions]
    present = F.col("rows").isNotNull()
    if result.cohesions is not None:
        out = out.join(joined(result.cohesions, class_row(), "classes"), "file_path", "left").join(result.cohesion_summary, "file_path", "left")
        sections.append(F.when(F.col("has_types"), F.concat(F.lit(CLASS_HEAD + CLASS_LINE), F.coalesce("classes", F.lit("")), F.lit(CLASS_LINE), class_total())))
        present = present | F.col("has_types")
    return out.where(present).select("file_path", F.concat_ws("\n", *sections).alias("report"))


def place() -> Column:
    return F.struct("line", "column").alias("location")


def function_value() -> Column:
    return F.struct("name", "signature", F.col("cyclomatic").alias("cyclomaticComplexity"), F.col("cognitive").alias("cognitiveComplexity"), place(), F.col("enclosing_type").alias("enclosingTypeName"))


def type_value() -> Column:
    return F.struct("name", "type", "lcom4", F.col("method_count").alias("methodCount"), F.col("property_count").alias("propertyCount"), place())


def summary_value() -> Column:
    return F.struct(
        F.col("total_functions").alias("totalFunctions"),
        F.col("avg_cyclomatic").alias("averageCyclomaticComplexity"),
        F.col("avg_cognitive").alias("averageCognitiveComplexity"),
        F.col("max_cyclomatic").alias("maxCyclomaticComplexity"),
        F.col("max_cognitive").alias("maxCognitiveComplexity"),
        F.col("total_cyclomatic").alias("totalCyclomaticComplexity"),
        F.col("total_cognitive").alias("totalCognitiveComplexity"),
    )


def cohesion_value() -> Column:
    return F.struct(F.coalesce("total_classes", F.lit(0)).alias("totalClasses"), F.coalesce("avg_lcom4", F.lit(0.0)).alias("averageLCOM4"), F.coalesce("max_lcom4", F.lit(0)).alias("maxLCOM4"), F.coalesce("low_classes", F.lit(0)).alias("classesWithLowCohesion"))


def listed(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(file_path, name): the values of a file in source order."""
    item = F.struct("pos", value.alias("value"))
    return rows.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["value"]).alias(name))


def json_report(result: Analysis) -> DataFrame:
    """(file_path, report): each file as an object; what is null is left out."""
    out = result.files.join(listed(result.functions, function_value(), "functions"), "file_path", "left").join(result.summary, "file_path")
    fields = [F.col("file_path").alias("filePath"), F.coalesce("functions", F.array()).alias("functions"), summary_value().alias("summary")]
    if result.cohesions is not None:
        out = out.join(listed(result.cohesions, type_value(), "types"), "file_path", "left").join(result.cohesion_summary, "file_path", "left")
        fields += [F.when(F.col("has_types"), F.coalesce("types", F.array())).alias("classCohesions"), F.when(F.col("has_types"), cohesion_value()).alias("cohesionSummary")]
    return out.select("file_path", F.to_json(F.struct(*fields)).alias("report"))


def element(indent: int, name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{' ' * indent}<{name}>"), value.cast("string"), F.lit(f"</{name}>\n"))


def opening(indent: int, name: str, *attributes: tuple[str, Column], optional: tuple[str, ...] = ()) -> Column:
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f'{n}="'), v.cast("string"), F.lit('"'))) for n, v in attributes]
    return F.concat(F.lit(f"{' ' * indent}<{name} "), F.concat_ws(" ", *parts), F.lit(">\n"))


def function_element() -> Column:
    return F.concat(
        opening(4, "function", ("name", xml_escaped(F.col("name"))), ("signature", xml_escaped(F.col("signature"))), ("enclosing-type", xml_escaped(F.col("enclosing_type"))), ("line", F.col("line")), ("column", F.col("column"))),
        element(6, "cyclomatic-complexity", F.col("cyclomatic")),
        element(6, "cognitive-complexity", F.col("cognitive")),
        F.lit("    </function>\n"),
    )


def summary_element() -> Column:
    names = (("total-functions", "total_functions"), ("average-cyclomatic-complexity", "avg_cyclomatic"), ("average-cognitive-complexity", "avg_cognitive"), ("max-cyclomatic-complexity", "max_cyclomatic"), ("max-cognitive-complexity", "max_cognitive"))
    return F.concat(F.lit("    <summary>\n"), *(element(6, n, F.col(c)) for n, c in names), F.lit("    </summary>\n"))


def type_element() -> Column:
    return F.concat(
        opening(4, "class", ("name", xml_escaped(F.col("name"))), ("type", F.col("type")), ("line", F.col("line")), ("column", F.col("column"))),
        *(element(6, n, F.col(c)) for n, c in (("lcom4", "lcom4"), ("method-count", "method_count"), ("property-count", "property_count"), ("cohesion-level", "cohesion_level"))),
        F.lit("    </class>\n"),
    )


def cohesion_element() -> Column:
    totals = (("total-classes", F.coalesce("total_classes", F.lit(0))), ("average-lcom4", F.coalesce("avg_lcom4", F.lit(0.0))), ("max-lcom4", F.coalesce("max_lcom4", F.lit(0))), ("low-cohesion-classes", F.coalesce("low_classes", F.lit(0))))
    return F.concat(F.lit("    <cohesion-summary>\n"), *(element(6, n, c) for n, c in totals), F.lit("    </cohesion-summary>\n"))


def file_element() -> Column:
    return F.concat(F.lit('  <file path="'), xml_escaped(F.col("file_path")), F.lit('">\n'))


def xml_report(result: Analysis) -> DataFrame:
    """(file_path, report): each file as an element."""
    out = result.files.join(joined(result.functions, function_element(), "rows"), "file_path", "left").join(result.summary, "file_path")
    parts = [file_element(), F.when(F.col("rows").isNotNull(), F.concat("rows", summary_element()))]
    if result.cohesions is not None:
        out = out.join(joined(result.cohesions, type_element(), "classes"), "file_path", "left").join(result.cohesion_summary, "file_path", "left")
        parts.append(F.when(F.col("has_types"), F.concat(F.coalesce("classes", F.lit("")), cohesion_element())))
    return out.select("file_path", F.concat_ws("", *parts, F.lit("  </file>\n")).alias("report"))


def function_diagnostic() -> Column:
    """A line for a function above its threshold."""
    c, g, t = F.col("cyclomatic"), F.col("cognitive"), F.col("threshold")
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"), F.col("column").cast("string"))
    text = F.format_string("Function '%s' has high complexity (Cyclomatic: %d, Cognitive: %d, Threshold: %d)", F.col("name"), c, g, t)
    return F.concat_ws(": ", place, severity(c, g, t), text)


def type_diagnostic() -> Column:
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"), F.col("column").cast("string"))
    text = F.format_string("%s '%s' has low cohesion (LCOM4: %d, Level: %s)", F.initcap("type"), F.col("name"), F.col("lcom4"), F.col("cohesion_level"))
    return F.concat_ws(": ", place, cohesion_severity(F.col("lcom4")), text)


def diagnostics(result: Analysis, rules: Rules | None = None, threshold: int | None = None) -> DataFrame:
    """(section, file_path, pos, message): functions strictly above their threshold, then types of low cohesion.

    Where neither rules nor ``threshold`` give one, the environment's counts, or FALLBACK_THRESHOLD.
    """
    functions = result.with_thresholds(rules, threshold).withColumn("threshold", F.coalesce("threshold", F.lit(env_threshold(FALLBACK_THRESHOLD))))
    out = functions.where("greatest(cyclomatic, cognitive) > threshold").select(F.lit(0).alias("section"), "file_path", "pos", function_diagnostic().alias("message"))
    if result.cohesions is not None:
        out = out.unionByName(result.cohesions.where("cohesion_level = 'low'").select(F.lit(1).alias("section"), "file_path", "pos", type_diagnostic().alias("message")))
    return out


def described(result: Analysis) -> DataFrame:
    """(section, file_path, pos, text): a line for each function, then for each type, then a summary of the types of each file."""
    out = result.functions.select(F.lit(0).alias("section"), "file_path", F.col("pos").cast("long").alias("pos"), function_text(F.col("name"), F.col("cyclomatic"), F.col("cognitive"), F.col("line"), F.col("column")).alias("text"))
    if result.cohesions is None:
        return out
    types = result.cohesions.select(F.lit(1).alias("section"), "file_path", F.col("pos").cast("long").alias("pos"), cohesion_text(F.col("name"), F.col("type"), F.col("lcom4"), F.col("cohesion_level")).alias("text"))
    totals = result.cohesion_summary.select(F.lit(2).alias("section"), "file_path", F.lit(0).cast("long").alias("pos"), cohesion_summary_text(F.col("total_classes"), F.col("avg_lcom4"), F.col("max_lcom4"), F.col("low_classes")).alias("text"))
    return out.unionByName(types).unionByName(totals)


def report_rows(result: Analysis, fmt: str = "text", rules: Rules | None = None, threshold: int | None = None, metrics: str = "both") -> DataFrame:
    """The report as rows that stand in any order, a row for each file."""
    if fmt not in FORMATS:
        raise SourceError(f"formats are {', '.join(FORMATS)}, not {fmt!r}")
    if fmt == "xcode":
        return diagnostics(result, rules, threshold)
    return {"text": lambda: text_report(result, metrics), "json": lambda: json_report(result), "xml": lambda: xml_report(result)}[fmt]()


def render(result: Analysis, fmt: str = "text", rules: Rules | None = None, threshold: int | None = None, metrics: str = "both") -> str:
    """The whole report as one text, files in order; for as much as a person reads, while ``report_sink`` writes any number of rows."""
    rows = report_rows(result, fmt, rules, threshold, metrics)
    if fmt == "xcode":
        lines = [r.message for r in rows.orderBy("section", "file_path", "pos").toLocalIterator()]
        return "\n".join(lines) + "\n" if lines else ""
    parts = [r.report for r in rows.orderBy("file_path").toLocalIterator()]
    if fmt == "json":
        return '{"files":[' + ",".join(parts) + "]}"
    if fmt == "xml":
        return '<?xml version="1.0" encoding="UTF-8"?>\n<complexity-report>\n' + "".join(parts) + "</complexity-report>\n"
    return "\n\n".join(parts).strip()


RESULTS = (
    "files array<struct<filePath: string, functions: array<struct<name: string, signature: string, cyclomaticComplexity: int, cognitiveComplexity: int, location: struct<line: int, column: int>, enclosingTypeName: string>>,"
    " classCohesions: array<struct<name: string, type: string, lcom4: int, methodCount: int, propertyCount: int, location: struct<line: int, column: int>>>>>"
)


def read_results(spark: SparkSession, texts: DataFrame, column: str = "value") -> Analysis:
    """Results from JSON reports, to be reported again."""
    from ..operators.cohesion import cohesion_level

    found = texts.select(F.explode(F.from_json(F.col(column), RESULTS)["files"]).alias("f")).select("f.*")
    files = found.select(F.col("filePath").alias("file_path"), F.col("classCohesions").isNotNull().alias("has_types"))
    place = (F.col("x.location.line").alias("line"), F.col("x.location.column").alias("column"))
    functions = found.select(F.col("filePath").alias("file_path"), F.posexplode("functions").alias("pos", "x")).select("file_path", "pos", "x.name", "x.signature", F.col("x.cyclomaticComplexity").alias("cyclomatic"), F.col("x.cognitiveComplexity").alias("cognitive"), *place, F.col("x.enclosingTypeName").alias("enclosing_type"))
    types = found.select(F.col("filePath").alias("file_path"), F.posexplode("classCohesions").alias("pos", "x")).select("file_path", "pos", "x.name", "x.type", "x.lcom4", F.col("x.methodCount").alias("method_count"), F.col("x.propertyCount").alias("property_count"), *place)
    return Analysis(files, functions, types.withColumn("cohesion_level", cohesion_level(F.col("lcom4"))))


def format_results(spark: SparkSession, text: str, fmt: str = "text", threshold: int | None = None, metrics: str = "both") -> str:
    """A JSON report in another format; a threshold is for diagnostics only."""
    return render(read_results(spark, spark.createDataFrame([(text,)], "value string")), fmt, threshold=threshold, metrics=metrics)
