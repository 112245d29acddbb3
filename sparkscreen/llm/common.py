"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of the contracts: a run without space, tab, line feed, vertical tab, form feed or return.
WORD_GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _local_dir() -> str:
    path = tempfile.mkdtemp(prefix="sparkscreen-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all executors share, spark.checkpoint.dir. A local session may go
    without; it gets a temporary folder that goes with the process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/sparkscreen-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_dir()


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more. remove(spark, shared_dir(spark)) clears all of an application's work."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_skewed(rows: DataFrame, facts: DataFrame, key: str, uses: str, how: str = "inner") -> DataFrame:
    """rows joined with facts, a narrow table of one row a key; uses: its column of how many rows have that key.

    Keys of over a thousandth of all uses are broadcast, at most a thousand rows whatever the data, so a key that a
    third of the rows share is tied to no task. The others, none of which is hot, are joined by a shuffle."""
    hot = facts.crossJoin(F.broadcast(facts.agg(F.sum(uses).alias("_all")))).filter(F.col(uses) * 1000 > F.col("_all")).drop("_all")
    at_hot = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return at_hot.unionByName(others.join(facts, key, how))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of text in order; none for a null or blank text. Trimming isn't left to a pattern, which would go through
    each run of blanks once from each of its places."""
    trimmed = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(F.length(F.coalesce(trimmed, F.lit(""))) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP, -1))


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's vocabulary file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def single_threaded() -> None:
    """Keep native libraries from starting their own threads inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
