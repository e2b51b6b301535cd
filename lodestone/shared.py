"""Tables in the folder that the driver and all executors see: ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder is made and set if
    all runs on this machine; on a cluster that is an error, since no other machine would see it."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="lodestone-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


_made: dict[str, SparkSession] = {}


@atexit.register
def _sweep() -> None:
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _made.pop(path, None)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, kept until the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder until the driver ends, and read back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def cut(df: DataFrame, *done: DataFrame) -> DataFrame:
    """``df`` computed once, written and read back; then the cut tables ``done`` are deleted.

    Neither lineage nor the optimiser's size estimate goes on: ``checkpoint()`` keeps the estimate, which
    doubles in bits with every self-join of a loop until it overflows. What is left when the driver ends
    is deleted then."""
    out = shared_table(df, "cut")
    for old in done:
        delete(old.sparkSession, old._cut_at)
    return out
