"""Bracket matching over sequences of any length: depth, partner and run of every token.

A token opens a scope, closes the innermost open one, or is an operator of the scope around
it.  A sequence is cut into chunks by position and each chunk is matched by itself: in a
chunk, brackets of one level alternate, so partners are neighbours within a level.  What a
chunk leaves open folds to one row for each level: its first and last operator before any
bracket of the level, its unmatched closing, its unmatched opening and the last operator
behind that.  A prefix scan over the chunks' sums places their levels, and the folded rows of
a sequence and level, in order of their chunks, carry scopes and runs from chunk to chunk.

So no group is larger than a chunk, or has more than a row for each chunk.  Tokens are
exchanged by sequence and chunk, and again by level to meet the folded rows.  Their number, which
is counted first, decides how many tasks share them, so that what one task sorts does not
grow with the input.

* ``depth``: how many open scopes hold the token, a bracket not in its own;
* ``partner``: position of the other bracket, null if there is none;
* ``scope``: of operators, the position of the opening of the innermost open scope, null outside;
* ``continued``: a logical operator whose predecessor in the same scope is one too; scopes
  within it do not count, as its run is restored where they end.

A closing without an opening closes nothing and leaves the depth as it is.  ``at`` orders the
tokens of a sequence and is unique there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import partitions

#: Positions of a chunk.
CHUNK = 100_000
#: Tokens of a task.
TASK = 250_000
OPEN, CLOSE, LOGICAL, OTHER = "open", "close", "logical", "other"


def folded(cells: DataFrame, cell: list[str], at: str) -> DataFrame:
    """What is left open in each chunk, a row for each level."""
    is_open, is_close, outer, last = F.col("kind") == OPEN, F.col("kind") == CLOSE, F.col("_before").isNull(), F.col("_after").isNull()
    is_op = ~is_open & ~is_close
    first_op, last_op = (f(F.when(is_op & outer, F.col("_logical")), F.when(is_op & outer, F.col(at))) for f in (F.min_by, F.max_by))
    tail = is_op & ~outer & last
    rows = cells.groupBy(*cell, "_level").agg(
        first_op.alias("head_first"),
        last_op.alias("head_last"),
        F.min(F.when(is_close & outer, F.col(at))).alias("close_at"),
        F.max(F.when(is_open & last, F.col(at))).alias("open_at"),
        F.max_by(F.when(tail, F.col("_logical")), F.when(tail, F.col(at))).alias("tail_last"),
    )
    return rows.where("head_first is not null or close_at is not null or open_at is not null")


def carried(rows: DataFrame, sequence: list[str], tasks: int) -> DataFrame:
    """Folded rows with what comes to them from other chunks: the scope, its last operator, and the next closing."""
    order = [*sequence, "_absolute"]
    rows = rows.repartition(tasks, *order)
    earlier = Window.partitionBy(*order).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*order).orderBy(F.col("_chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    opened, closed = F.col("open_at").isNotNull(), F.col("close_at").isNotNull()

    nothing = lambda kind: F.struct(F.lit(None).cast(kind).alias("x"))
    scope = F.when(opened, F.struct(F.col("open_at").alias("x"))).when(closed, nothing("long"))
    run = F.when(opened, F.struct(F.col("tail_last").alias("x"))).when(closed, nothing("boolean")).when(F.col("head_last").isNotNull(), F.struct(F.col("head_last").alias("x")))
    return rows.withColumns(
        {
            "in_scope": F.last(scope, True).over(earlier).getField("x"),
            "in_run": F.last(run, True).over(earlier).getField("x"),
            "next_close": F.last("close_at", True).over(later),
        }
    )


def matched(tokens: DataFrame, sequence: list[str], at: str = "at", chunk: int = CHUNK) -> DataFrame:
    """``tokens`` (sequence, at, kind) with ``depth``, ``partner``, ``scope`` and ``continued``."""
    cell = [*sequence, "_chunk"]
    tasks = max(partitions(tokens.sparkSession), -(-tokens.count() // TASK))
    up = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    rows = tokens.withColumns({"_chunk": F.floor(F.col(at) / chunk), "_up": up, "_logical": F.col("kind") == LOGICAL}).repartition(tasks, *cell)
    so_far = Window.partitionBy(*cell).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_sum", F.sum("_up").over(so_far)).withColumn("_low", F.min("_sum").over(so_far))
    rows = rows.withColumn("_level", F.col("_sum") + (F.col("kind") == CLOSE).cast("int"))

    ahead = Window.partitionBy(*cell, "_level").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    bracket = F.when(F.col("_up") != 0, F.col(at))
    operator = F.when(F.col("_up") == 0, F.struct(at, "_logical"))
    by = ", ".join(f"`{c}`" for c in [*cell, "_level"])
    after = F.expr(f"lead(_bracket) IGNORE NULLS OVER (PARTITION BY {by} ORDER BY `{at}`)")  # in the order of the others, so nothing is sorted again
    cells = rows.withColumn("_bracket", bracket).withColumns({"_before": F.last("_bracket", True).over(ahead), "_operator": F.last(operator, True).over(ahead), "_after": after}).drop("_bracket")

    scan = Window.partitionBy(*sequence).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*cell).agg(F.sum("_up").alias("_net"), F.min("_sum").alias("_least")).repartition(tasks, *sequence)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_net").over(scan), F.lit(0)))
    sums = sums.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_least")).over(scan), F.lit(0)))).select(*cell, "_base", "_floor")

    left = folded(cells, cell, at).join(sums, cell).withColumn("_absolute", F.col("_base") + F.col("_level"))
    links = carried(left, sequence, tasks).select(*cell, "_level", "open_at", "in_scope", "in_run", "next_close")
    dealt = lambda rows: rows.repartition(tasks, *cell, "_level")
    out = dealt(cells.join(sums, cell)).join(dealt(links), [*cell, "_level"], "left")

    is_open, is_close = F.col("kind") == OPEN, F.col("kind") == CLOSE
    outer = F.col("_before").isNull()
    own_scope = F.when(outer, F.col("in_scope")).otherwise(F.col("_before"))
    in_own = F.col("_operator").isNotNull() & (outer | (F.col(f"_operator.{at}") > F.col("_before")))
    before = F.when(in_own, F.col("_operator._logical")).when(outer, F.col("in_run"))
    lowest = F.least(F.col("_floor"), F.col("_base") + F.col("_low"))
    return out.select(
        *[F.col(f"`{c}`") for c in tokens.columns],
        (F.col("_base") + F.col("_sum") - is_open.cast("int") - lowest).cast("long").alias("depth"),
        F.when(is_open, F.when(F.col("_after").isNotNull(), F.col("_after")).otherwise(F.col("next_close"))).when(is_close, own_scope).alias("partner"),
        F.when(~is_open & ~is_close, own_scope).alias("scope"),
        (F.col("_logical") & F.coalesce(before, F.lit(False))).alias("continued"),
    )
