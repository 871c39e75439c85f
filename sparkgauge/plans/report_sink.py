"""Reports of any size as files: rows in order, written by all tasks, that follow each other as one document.

A report is a table of lines, each with its place: the file, the section within it, and the
position within that.  Lines are dealt by ranges of their places and sorted, so the part files
of the output, in the order of their names, are the whole report; no file's lines are ever
gathered, however many functions it has.  Spark's own writer commits the parts: a task that
is lost or tried again leaves nothing behind, and the report is there as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import Rules, SourceError
from ..sources.storage import partitions, stored
from . import reports
from .analysis import Analysis

# How reports begin and end.
HEADS = {"json": '{"files":[', "xml": '<?xml version="1.0" encoding="UTF-8"?>\n<complexity-report>'}
TAILS = {"json": "]}", "xml": "</complexity-report>"}
#: Sections of a file: its own line, what comes before, at and behind its functions, the same for its types, and its end.
FILE, FUNCTIONS, FUNCTION, SUMMARY, TYPES, TYPE, TOTAL, END = range(8)


def line(rows: DataFrame, section: int, pos: Column, text: Column) -> DataFrame:
    """(file_path, section, pos, text); the newline at the end of a text is the writer's."""
    return rows.select("file_path", F.lit(section).alias("section"), pos.cast("long").alias("pos"), F.regexp_replace(text, r"\n\z", "").alias("text"))


def with_first(rows: DataFrame) -> DataFrame:
    """Rows with ``first``: whether each is the first of its file."""
    firsts = rows.groupBy("file_path").agg(F.min("pos").alias("_first"))
    return rows.join(firsts, "file_path").withColumn("first", F.col("pos") == F.col("_first"))


def comma(first: Column, text: Column) -> Column:
    return F.concat(F.when(first, "").otherwise(","), text)


def opened(value: Column) -> Column:
    """A JSON object without its closing brace."""
    return F.regexp_replace(F.to_json(value), r"\}\z", "")


def report_lines(result: Analysis, fmt: str = "text", metrics: str = "both") -> DataFrame:
    """(file_path, section, pos, text): a report's lines; those of the first file know that they are."""
    files = result.files.join(result.summary, "file_path")
    types = result.cohesions
    if types is None:
        files = files.withColumn("has_types", F.lit(False))
    else:
        files = files.join(result.cohesion_summary, "file_path", "left")
    has_functions, has_types, zero = F.col("total_functions") > 0, F.col("has_types"), F.lit(0)
    if fmt == "text":
        files = files.where(has_functions | has_types)
    first = files.agg(F.min("file_path")).first()[0]
    is_first = F.col("file_path") == F.lit(first)
    if fmt == "text":
        head, rule = reports.text_frame(reports.metrics_named(metrics))
        of_types = files.where(has_types)
        out = [
            line(files, FILE, zero, F.concat(F.when(is_first, "").otherwise("\n\n"), F.lit("File: "), F.col("file_path"))),
            line(files.where(has_functions), FUNCTIONS, zero, F.lit(head + rule)),
            line(result.functions, FUNCTION, F.col("pos"), reports.text_row(metrics)),
            line(files.where(has_functions), SUMMARY, zero, F.concat(F.lit(rule), reports.text_summary(metrics))),
        ]
        if types is not None:
            out += [
                line(of_types, TYPES, zero, F.concat(F.when(has_functions, "\n").otherwise(""), F.lit(reports.CLASS_HEAD + reports.CLASS_LINE))),
                line(types.join(of_types.select("file_path"), "file_path", "left_semi"), TYPE, F.col("pos"), reports.class_row()),
                line(of_types, TOTAL, zero, F.concat(F.lit(reports.CLASS_LINE), reports.class_total())),
            ]
    elif fmt == "json":
        out = [
            line(files, FILE, zero, comma(is_first, F.concat(opened(F.struct(F.col("file_path").alias("filePath"))), F.lit(',"functions":[')))),
            line(with_first(result.functions), FUNCTION, F.col("pos"), comma(F.col("first"), F.to_json(reports.function_value()))),
            line(files, SUMMARY, zero, F.concat(F.lit('],"summary":'), F.to_json(reports.summary_value()), F.when(has_types, ',"classCohesions":[').otherwise("}"))),
        ]
        if types is not None:
            of_types = files.where(has_types)
            own = types.join(of_types.select("file_path"), "file_path", "left_semi")
            out += [line(with_first(own), TYPE, F.col("pos"), comma(F.col("first"), F.to_json(reports.type_value()))), line(of_types, TOTAL, zero, F.concat(F.lit('],"cohesionSummary":'), F.to_json(reports.cohesion_value()), F.lit("}")))]
    elif fmt == "xml":
        out = [
            line(files, FILE, zero, reports.file_element()),
            line(result.functions, FUNCTION, F.col("pos"), reports.function_element()),
            line(files.where(has_functions), SUMMARY, zero, reports.summary_element()),
            line(files, END, zero, F.lit("  </file>\n")),
        ]
        if types is not None:
            of_types = files.where(has_types)
            out += [line(types.join(of_types.select("file_path"), "file_path", "left_semi"), TYPE, F.col("pos"), reports.type_element()), line(of_types, TOTAL, zero, reports.cohesion_element())]
    else:
        raise SourceError(f"formats are {', '.join(reports.FORMATS)}, not {fmt!r}")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def ordered_lines(result: Analysis, fmt: str = "text", rules: Rules | None = None, threshold: int | None = None, metrics: str = "both") -> DataFrame:
    """(part, file_path, section, pos, text) in the report's order, ``part`` before all others: 0 head, 1 lines, 2 tail."""
    if fmt == "xcode":
        found = reports.diagnostics(result, rules, threshold)
        return found.select((F.col("section") + 1).alias("part"), "file_path", F.lit(0).alias("section"), F.col("pos").cast("long").alias("pos"), F.col("message").alias("text"))
    rows = report_lines(result, fmt, metrics).select(F.lit(1).alias("part"), "file_path", "section", "pos", "text")
    ends = [(part, "", 0, 0, texts[fmt]) for part, texts in ((0, HEADS), (2, TAILS)) if fmt in texts]
    return rows.unionByName(rows.sparkSession.createDataFrame(ends, "part int, file_path string, section int, pos long, text string")) if ends else rows


ORDER = ["part", "file_path", "section", "pos"]


def write_report(result: Analysis, path: str, fmt: str = "text", rules: Rules | None = None, threshold: int | None = None, metrics: str = "both") -> None:
    """Write the report to a folder in any store; its part files in order of their names are one document."""
    rows = stored(ordered_lines(result, fmt, rules, threshold, metrics), "report")  # ranges are sampled, which would make the lines twice
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    dealt.select("text").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(place, line): the lines of a written report by their places, from 1."""
    block = ["name", "start"]
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*block).orderBy("id")))  # a block is read in order
    sizes = rows.groupBy(*block).count().orderBy(*block).collect()  # a row for each block of a file
    begin, before = [], 0
    for r in sizes:
        begin.append((r.name, r.start, before))
        before += r["count"]
    starts = F.broadcast(spark.createDataFrame(begin, "name string, start long, begin long"))
    return rows.join(starts, block).select((F.col("begin") + F.col("at")).alias("place"), "line")
