"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters that are none of the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where none is named and all runs in one
    process, as in tests, a temporary one is made and set; on a cluster that is an error."""
    name = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not name and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(name or tempfile.mkdtemp(prefix="runlore-checkpoint-"))
    return name or context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder, with their lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash128(column: Column) -> Column:
    """Two independently seeded 64-bit hashes of a string, as one struct to compare by."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(7919), column).alias("b"))


def few_parts(df: DataFrame, rows: int, each: int = 250_000) -> DataFrame:
    """df in no more partitions than its number of rows is worth. What fits into one needs no shuffles later on."""
    return df.coalesce(max(1, -(-rows // each)))


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most this many rows; reads no more than that of them."""
    return df.limit(most + 1).count() <= most


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have few rows and a bounded number of bytes, as texts can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def let_go() -> None:
    """Gives memory that a worker has freed back to the system, as idle workers stay beside their executor: that of Arrow's
    pool, and, where the C library can, that of the heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
