"""A stored symbol index: tables in buckets, appended by batch, joined where they lie.

Symbols lie in buckets of their parent, types also in buckets of name and kind, and
occurrences in buckets of the symbol that contains them: the keys by which cohesion asks for
them, so that neither table is exchanged.  A batch adds files to the buckets that its rows fall
into and touches no others.  It counts once the manifest names it, which is written
last: what a lost append has left is never seen.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cohesion import index_lcom4
from ..sources.files import InvalidPathError
from ..sources.storage import hadoop

BUCKETS = 64
#: Batches whose names go to all tasks (some 10 MB); with more of them the planner decides.
BROADCAST_BATCHES = 100_000
#: Columns and bucket keys of each table.
TABLES = {
    "symbols": ("usr string, name string, kind string, parent_usr string", ["parent_usr"]),
    "types": ("usr string, name string, kind string", ["name", "kind"]),
    "occurrences": ("usr string, role string, container_usr string", ["container_usr"]),
}
MANIFEST = "batch string, buckets int"


@dataclass(frozen=True)
class SymbolIndex:
    """An index in a folder of any store; ``names`` are its tables in the session's catalog."""

    spark: SparkSession
    folder: str
    buckets: int
    names: dict[str, str]

    @staticmethod
    def open(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> SymbolIndex:
        """The index in the folder; a new one with so many buckets where there is none yet."""
        manifest, fs = hadoop(spark, f"{folder}/manifest")
        if fs.exists(manifest):
            buckets = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.max("buckets")).first()[0]
        else:
            top, _ = hadoop(spark, folder)
            if fs.exists(top) and len(fs.listStatus(top)):
                raise InvalidPathError(f"no symbol index at {folder}")
            spark.createDataFrame([], MANIFEST).write.parquet(f"{folder}/manifest")
        names = {}
        for table, (columns, keys) in TABLES.items():
            names[table] = f"index_{table}_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {names[table]} ({columns}, batch string) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{folder}/{table}'")
        return SymbolIndex(spark, folder, buckets, names)

    def append(self, symbols: DataFrame, occurrences: DataFrame, batch: str | None = None) -> None:
        """Add a batch; one whose name is there already is left as it is."""
        batch = batch or uuid.uuid4().hex
        if self.batches().where(F.col("batch") == batch).count():
            return
        attempt = f"{batch}/{uuid.uuid4().hex}"
        types = symbols.where("kind in ('class', 'struct')")
        for table, rows in (("symbols", symbols), ("types", types), ("occurrences", occurrences)):
            columns, keys = TABLES[table]
            own = rows.select(*(c.split()[0] for c in columns.split(", "))).withColumn("batch", F.lit(attempt))
            writer = own.repartition(self.buckets, *keys).write.mode("append").format("parquet")  # a task for each bucket, so a file for each
            writer.bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(self.names[table])
        self.spark.createDataFrame([(attempt, self.buckets)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def batches(self) -> DataFrame:
        """(batch, attempt) of what counts."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        return rows.select(F.substring_index("batch", "/", 1).alias("batch"), F.col("batch").alias("attempt"))

    def table(self, name: str) -> DataFrame:
        """The rows of the batches that count."""
        whole = self.batches().select(F.col("attempt").alias("batch"))
        if whole.limit(BROADCAST_BATCHES + 1).count() <= BROADCAST_BATCHES:
            whole = F.broadcast(whole)
        return self.spark.table(self.names[name]).join(whole, "batch", "left_semi").drop("batch")

    def lcom4(self, types: DataFrame) -> DataFrame:
        """(file_path, type_pos, lcom4) of the types that the index knows, without an exchange of its tables."""
        return index_lcom4(types, self.table("symbols"), self.table("occurrences"), self.table("types"))

    def close(self) -> None:
        """Forget the tables; their files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
