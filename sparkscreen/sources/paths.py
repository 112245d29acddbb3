"""Places for work files."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="sparkscreen-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. A local session may go without; it gets a
    temporary folder that goes with the process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_dir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to a new path and read back."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_field(df: DataFrame, name: str) -> T.StructType:
    """The schema of df and one more column of whole numbers."""
    return T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())])
