"""Cutting lineage: a DataFrame written to the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="tessella-")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset a folder of this process, which only a local
    master's executors, as in tests, share with the driver."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _is_local(spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/tessella-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes every table this application has written to the shared folder. Call it when no
    DataFrame made by this package is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
