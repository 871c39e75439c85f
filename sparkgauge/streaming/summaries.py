"""Summaries that follow their files: a new version replaces the old one's sums, a deletion removes them.

The stream holds functions, each with its file and the file's version, in any order and in
any batches.  A file's state is its latest version and that version's sums, which take more
functions of it as they come; functions of older versions change nothing, and a newer version
starts anew.  A deletion is a version without functions, and wins over functions of the same
version.  So the state after all batches is that of one pass over all rows, whatever
their order.

Each batch writes the files that have changed; a batch that is repeated after a restart
replaces its own output, and the state is the checkpoint's.  State lives in RocksDB, so
files that do not change cost no memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

#: Columns of the stream after ``file_path``; a deletion has no metrics.
FUNCTIONS = "version long, cyclomatic long, cognitive long, deleted boolean"
STATE = "version long, deleted boolean, total_functions long, total_cyclomatic long, total_cognitive long, max_cyclomatic long, max_cognitive long"
SUMMARY = f"file_path string, {STATE}"
NAMES = [c.split()[0] for c in STATE.split(", ")]
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def added(state: tuple | None, rows: pd.DataFrame) -> tuple | None:
    """The state with more functions; None if nothing changes."""
    latest = rows["version"].max()
    if state is not None and latest < state[0]:
        return None
    new = rows[rows["version"] == latest]
    before = state if state is not None and state[0] == latest else (int(latest), False, 0, 0, 0, 0, 0)
    deleted = bool(before[1] or new["deleted"].any())
    if deleted:
        return int(latest), True, 0, 0, 0, 0, 0
    return (
        int(latest),
        False,
        before[2] + len(new),
        *(int(before[k] + new[c].sum()) for k, c in ((3, "cyclomatic"), (4, "cognitive"))),
        *(int(max(before[k], new[c].max())) for k, c in ((5, "cyclomatic"), (6, "cognitive"))),
    )


class LatestVersion(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:
        before = state = tuple(self.latest.get()) if self.latest.exists() else None
        for part in rows:
            state = added(state, part) or state
        if state != before:
            self.latest.update(state)
            yield pd.DataFrame([(key[0], *state)], columns=["file_path", *NAMES])

    def close(self) -> None:
        pass


def summary_changes(functions: DataFrame) -> DataFrame:
    """(file_path, version, deleted, sums) of the files that a batch changes, from a stream of (file_path, version, cyclomatic, cognitive, deleted)."""
    own = functions.select("file_path", *(c.split()[0] for c in FUNCTIONS.split(", ")))
    return own.groupBy("file_path").transformWithStateInPandas(LatestVersion(), StructType.fromDDL(SUMMARY), outputMode="Update", timeMode="None")


def follow(functions: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the changes of each batch to a folder of its own."""
    functions.sparkSession.conf.set(*PROVIDER)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = summary_changes(functions).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def summaries(spark: SparkSession, out: str) -> DataFrame:
    """The summary of every file that is there, after all batches so far."""
    rows = spark.read.schema(f"{SUMMARY}, batch long").parquet(out)
    last = rows.groupBy("file_path").agg(F.max_by(F.struct(*NAMES), "batch").alias("last")).select("file_path", "last.*").where("not deleted")
    average = {f"avg_{m}": F.col(f"total_{m}") / F.col("total_functions") for m in ("cyclomatic", "cognitive")}
    return last.withColumns(average).drop("deleted")


def summaries_at_once(functions: DataFrame) -> DataFrame:
    """The same of a table, in one pass."""
    latest = functions.groupBy("file_path").agg(F.max("version").alias("version"))
    rows = functions.join(latest, ["file_path", "version"])
    sums = [f(c).alias(f"{n}_{c}") for n, f in (("total", F.sum), ("max", F.max), ("avg", F.avg)) for c in ("cyclomatic", "cognitive")]
    return rows.groupBy("file_path", "version").agg(F.bool_or("deleted").alias("deleted"), F.count("*").alias("total_functions"), *sums).where("not deleted").drop("deleted")
