"""Durable intermediate tables.

Intermediate results are cut from their lineage by writing Parquet to the
folder that the cluster names in ``spark.checkpoint.dir``, which all executors
share, so a lost executor costs a re-read and never a wrong or failed job.

A table lives until discard() or sweep() removes it.  Loops discard a round's
tables when the next round is written; a caller that has written an operator's
result sweeps the rest, as corpus_pipeline.run does after each stage.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a local one only where none is named (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = getattr(spark, "_tallow_dir", None)
    if folder is None:
        folder = spark._tallow_dir = "file://" + tempfile.mkdtemp(prefix="tallow-")
    return folder


def _written(spark: SparkSession) -> list[str]:
    """Paths of the session's tables that are still there, in the order of writing."""
    if not hasattr(spark, "_tallow_tables"):
        spark._tallow_tables = []
    return spark._tallow_tables


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallow_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _written(spark).remove(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialise() that no later step reads."""
    for table in tables:
        _delete(table.sparkSession, table._tallow_path)


def mark(spark: SparkSession) -> set[str]:
    """The tables that are there now, to be given to sweep()."""
    return set(_written(spark))


def sweep(spark: SparkSession, keep: set[str], *tables: DataFrame) -> None:
    """Remove the session's tables but those in ``keep`` and ``tables``, and have Spark clean up; for callers that have written their result."""
    keep = keep | {t._tallow_path for t in tables}
    for path in [p for p in _written(spark) if p not in keep]:
        _delete(spark, path)
    gc.collect()  # plans that Python still refers to keep their shuffle files
    spark._jvm.System.gc()  # Spark removes shuffle files when the driver's collector finds their plans gone


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow() that gives its memory back when it ends.

    Spark keeps Python workers for later stages, and both allocators keep what
    was freed, so the idle workers of one stage would count against the next.
    """

    def freeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return freeing
