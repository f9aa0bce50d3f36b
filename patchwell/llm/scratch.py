"""Shared intermediate tables and small reductions used by the operators.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and never a restart.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_owned: dict[tuple, object] = {}


def owned(key: tuple, make: Callable[[], object]):
    """An object that a Python worker keeps between tasks. It keeps one: a worker lives on from operator to operator, and their caches would add up."""
    if key not in _owned:
        _owned.clear()
        _owned[key] = make()
    return _owned[key]


def tidy() -> None:
    """Give memory that is free back to the system: a Python worker lives on, and what it once took would stay with it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def release() -> None:
    """Drop what the worker keeps, where a task needs the memory."""
    _owned.clear()
    tidy()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where it is unset and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Texts and sets are long rows: an Arrow batch of 500 keeps a worker's memory low. A setting of one's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


@contextlib.contextmanager
def single_rows(spark: SparkSession):
    """For what runs within, an Arrow batch is one row: where rows are many MB each, a batch of those of a whole file would be held twice by the task."""
    small_batches(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: later uses do not recompute what made it."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove a stored table that no later step reads."""
    spark = df.sparkSession
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt_in_order(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Rows dealt by ranges of ``order`` and sorted in each task, so tasks follow each other in that order.

    Rows that are equal in ``order`` may lie in several tasks: the place in the
    input breaks ties, as one key may hold a third of all rows. ``parts``: as many
    ranges as the session's shuffle partitions, unless given.
    """
    keys = [*order, F.col("_place")]
    return df.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys).drop("_place")


def crc(col: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def squeezed(a: np.ndarray) -> bytes:
    """An array's bytes, compressed plane by plane: counts are mostly small, so their upper bytes are alike."""
    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())


def unsqueezed(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(dtype).ravel()


def tree_sum(blobs: DataFrame, dtype: str, fan_in: int = 16) -> np.ndarray | None:
    """Sum equal-shaped arrays, ``(slot int, blob binary)`` rows of ``squeezed`` arrays, one a partition; a slot is a partition's number.

    Levels of at most ``fan_in`` arrays a group run until ``fan_in`` are left;
    only those reach the driver, so its memory depends on the array alone.
    """

    def add(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = unsqueezed(pdf["blob"].iloc[0], dtype)
        for b in pdf["blob"].iloc[1:]:
            total += unsqueezed(b, dtype)
        return pd.DataFrame({"slot": [key[0]], "blob": [squeezed(total)]})

    n = (blobs.agg(F.max("slot")).head()[0] or 0) + 1
    while n > fan_in:
        blobs = blobs.groupBy((F.col("slot") / fan_in).cast("int").alias("g")).applyInPandas(add, "slot int, blob binary")
        n = -(-n // fan_in)
    total = None
    for row in blobs.toLocalIterator():
        x = unsqueezed(row["blob"], dtype)
        total = x if total is None else total + x
    return total


def split_batches(batches: Iterator[pd.DataFrame], column: str = "text", limit: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Cut Arrow batches into runs of rows whose text adds up to about ``limit`` characters."""
    for pdf in batches:
        if len(pdf) == 0:
            continue
        run = np.cumsum([len(t) if isinstance(t, (str, bytes)) else 0 for t in pdf[column]])
        part = run // limit
        for k in np.unique(part):
            yield pdf[part == k].reset_index(drop=True)


def mapped(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, column: str = "text", limit: int = 2_000_000) -> DataFrame:
    """``fn`` over bounded runs of rows, in the partitions as they are."""

    def run(batches):
        for pdf in split_batches(batches, column, limit):
            yield fn(pdf)
        tidy()

    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)
