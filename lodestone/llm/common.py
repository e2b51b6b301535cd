"""What the corpus operators share: materialised tables, Arrow batches and hashing."""

from __future__ import annotations

import atexit
import contextlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..shared import shared_dir

#: Rows and bytes of one Arrow batch: a Python worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes, so that long texts can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_made: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    """Delete what is left in the shared folder when the driver ends: lazy results may read stored
    tables until then."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: the lineage ends
    there, and a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for df in frames:
        delete(df.sparkSession, df._stored_at)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from numpy arrays, without a Python object per item."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype(), copy=False), kind))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits, in place: every input bit reaches every output bit."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
