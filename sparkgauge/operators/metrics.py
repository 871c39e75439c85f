"""Cyclomatic and cognitive complexity of every function, as joins and sums over syntax rows.

Each row brings its depth and its run for every function around it, so nothing is joined:
functions and their nodes come from one reading of the rows, meet as points in one exchange, and
window and sums run where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BRANCHES = ("if", "guard", "while", "for", "repeat", "case", "catch")
NESTING = ("while", "for", "repeat", "switch", "catch")
LOGICAL = ("&&", "||")


def is_logical() -> Column:
    return (F.col("kind") == "binop") & F.col("name").isin(*LOGICAL)


def cyclomatic_points(fold_operators: bool = False) -> Column:
    """Whether a node is a decision.  Conditional operators count only where operators are folded, which by default they are not."""
    extra = (F.col("kind") == "ternary") | (F.col("kind") == "binop") & (F.col("name") == "??")
    points = F.col("kind").isin(*BRANCHES) | is_logical()
    return F.coalesce(points | extra if fold_operators else points, F.lit(False))


def cognitive_points(depth: Column, fold_operators: bool = False) -> Column:
    """Structural increments of a node at ``depth`` within its function."""
    kind = F.col("kind")
    out = F.when((kind == "if") & F.col("is_else_if"), 1).when(kind == "if", 1 + depth)
    out = out.when(kind.isin("else", "guard"), 1).when(kind.isin(*NESTING), 1 + depth)
    if fold_operators:
        out = out.when(kind == "ternary", 1 + depth)
    return out.otherwise(0)


def continued(partition: list[str | Column], order: list[str | Column], logical: Column) -> Column:
    """1 where a logical operator follows another one without a different operator between them."""
    return F.when(logical & F.lag(logical, 1, False).over(Window.partitionBy(*partition).orderBy(*order)), 1).otherwise(0)


def function_metrics(syntax: DataFrame, fold_operators: bool = False) -> DataFrame:
    """(file_path, pos, name, signature, cyclomatic, cognitive, line, column, enclosing_type) of every function.

    A node counts for every function whose body contains it.  Cognitive complexity never
    sees what stands in the condition of an ``if`` within the function.
    """
    is_function = F.col("row") == "function"
    own = F.array(F.struct(F.col("pos").alias("fns"), F.lit(0).alias("depths"), F.lit(0).alias("runs")))  # a function is among its own nodes
    rows = syntax.where("row = 'function' or row = 'node' and kind not in ('ident', 'call')")
    rows = rows.withColumn("f", F.explode(F.when(is_function, own).otherwise(F.arrays_zip("fns", "depths", "runs"))))
    is_node, depth = ~is_function, F.col("f.depths")
    seen = is_node & (depth >= 0)
    in_run = F.coalesce(seen & (F.col("kind") == "binop"), F.lit(False))  # only operators that are seen take part in runs; the rest gets a run of its own
    points = rows.select(
        "file_path",
        F.col("f.fns").alias("fn_pos"),
        F.when(is_function, F.struct("name", "signature", "line", "column", F.col("enclosing").alias("enclosing_type"))).alias("info"),
        F.when(is_node, cyclomatic_points(fold_operators)).otherwise(False).cast("int").alias("cyclomatic"),
        F.when(seen, cognitive_points(depth, fold_operators)).otherwise(0).alias("cognitive"),
        in_run.alias("in_run"),
        F.when(in_run, F.col("f.runs")).alias("scope"),
        F.when(in_run, F.col("pos")).alias("pos"),
        (in_run & F.coalesce(is_logical(), F.lit(False))).alias("logical"),
    ).repartition("file_path", "fn_pos")
    run = F.when(F.col("in_run"), continued(["file_path", "fn_pos", "in_run", "scope"], ["pos"], F.col("logical"))).otherwise(0)
    points = points.withColumn("run", run)
    sums = points.groupBy("file_path", "fn_pos").agg(F.max("info").alias("info"), F.sum("cyclomatic").alias("cyclomatic"), F.sum(F.col("cognitive") + F.col("run")).alias("cognitive"))
    return sums.select(
        "file_path",
        F.col("fn_pos").alias("pos"),
        "info.name",
        "info.signature",
        (1 + F.col("cyclomatic")).cast("int").alias("cyclomatic"),
        F.col("cognitive").cast("int").alias("cognitive"),
        "info.line",
        "info.column",
        "info.enclosing_type",
    )
