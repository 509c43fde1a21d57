"""Derived tables that several steps read, written once to the folder that driver and executors share.

A table is written under the session's checkpoint folder and read back; its name is the step's name
and the input files it was made from, so other inputs make another table. Without a shared folder (a
cluster on which spark.checkpoint.dir is not set) the plan is returned as it is.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple, tuple] = {}


def shared_folder(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not sc.master.startswith("local"):
            return None
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="spanwright-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table of its own: what reads it twice does not compute it twice."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, inputs: list[DataFrame], make: Callable[[], DataFrame]) -> DataFrame:
    """The table `name` over these inputs, made at its first use in the session."""
    if shared_folder(spark) is None:
        return make()
    files = sorted(f for df in inputs for f in df.inputFiles())
    key = spark.sparkContext.applicationId, name, hashlib.md5("\n".join(files).encode()).hexdigest()
    if key not in _made:
        df = make()
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        atexit.register(_forget, spark, path)
        _made[key] = path, df.schema
    path, schema = _made[key]
    return spark.read.schema(schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already, and its folder with it or kept by its owner
        pass
