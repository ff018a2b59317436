"""Shared folder, written tables and Arrow/NumPy helpers of the subpackage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else what the context has, else, where driver and executors
    are one process, a temporary one."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not set_to:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="lumenact-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def release() -> None:
    """Drop the tables written so far, once the results that read them are no longer needed; they go with the driver anyway."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session has ended already
            return


atexit.register(release)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back.

    The files survive the loss of any executor; they go with ``release`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenact-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "8m"):
    """Arrow batches of at most so many bytes for what is computed inside: long texts make large batches of few rows."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def kept(df: DataFrame) -> DataFrame:
    """Small intermediate rows of a short lineage, kept on the executors' disks; what is lost with one is made again."""
    return df.persist(StorageLevel.DISK_ONLY)


def vectors(column: pa.Array | pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix; nulls inside are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0), dtype)
    flat = column.flatten()
    if flat.null_count:
        flat = flat.fill_null(0.0)
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


def lists(matrix: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """The rows of a matrix as an Arrow list column."""
    n, d = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(matrix).reshape(-1), kind))


def summed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of ``value`` by ``keys``: partial sums in the map tasks, then one small shuffle."""
    return df.groupBy(*keys).agg(F.sum("value").alias("value"))
