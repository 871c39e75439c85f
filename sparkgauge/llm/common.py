"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch; a longer text is a batch of its own.  Ten thousand rows, Spark's other bound, may be any number of bytes.
BATCH = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """From now on the session's Arrow batches hold so many bytes at most, on both sides of the pipe to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """(doc_id, text) of every row, for Python to read in small batches."""
    small_batches(docs.sparkSession, batch)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same task, which gives free memory back at its end: its Python worker lives on, idle beside the work of other stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    A local master has one machine only, so there a temporary folder stands in
    where the setting is absent; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sparkgauge-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, tag: str) -> str:
    """A folder of its own in the shared one; it goes when the driver ends."""
    out = f"{shared_dir(spark)}/sparkgauge/{tag}-{uuid.uuid4().hex}"
    path, fs = hadoop(spark, out)
    fs.deleteOnExit(path)
    return out


def hadoop(spark: SparkSession, name: str):
    """A path and its file system, whatever store it is in."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: when an executor is lost, what it has written stays.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)  # unlike snappy, its writers keep no buffers outside the heap until a collection
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing reads any more."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/sparkgauge/" in parent:
            path, fs = hadoop(spark, parent)
            fs.delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
