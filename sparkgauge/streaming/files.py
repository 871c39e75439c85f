"""Source files as a stream: each new file is parsed and measured once.

Cyclomatic complexity is stateless by file, so the stream joins nothing across batches;
``foreachBatch`` runs the batch plans on what has arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import function_metrics
from ..sources.files import SUFFIX
from ..sources.syntax import syntax


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, code) of files as they appear."""
    rows = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", f"*{SUFFIX}").option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("code"))


def measure_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes the functions of new files to ``out`` as Parquet, a folder for each batch so that a repeated batch replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        function_metrics(syntax(rows, idents=False)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = source_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
