"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where it is set.

    Unset, a local master (tests, one machine) gets a temporary folder, gone with the process; any
    other master a folder in the warehouse, which a cluster shares as well. No setting is changed.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = _local_dir()
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lumenfold").rstrip("/")


@lru_cache(maxsize=1)
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="lumenfold-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor
    costs a file read. Give the folder a lifecycle rule; results may still read the table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
