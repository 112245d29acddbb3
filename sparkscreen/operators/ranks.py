"""Ranks over all rows without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.paths import shared_path, with_field


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with each row's place in the order, from 1, in a column name.

    Rows are dealt into ranges of the order, whose number stays with them; a row's place is its place in its range, and
    how many rows are in the ranges before. The ranges are written once, as their bounds come from a sample that another run
    may draw otherwise. Rows that are equal in the order have any order among themselves."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, "ranges")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.schema(with_field(df, "_range")).parquet(path)
    before, starts = 0, []
    for r in sorted(rows.groupBy("_range").count().collect()):  # one row a range
        starts.append((r["_range"], before))
        before += r["count"]
    at = F.broadcast(spark.createDataFrame(starts, "_range int, _before long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return rows.join(at, "_range").withColumn(name, place.cast("int" if before < 2**31 else "long")).select(*df.columns, name)
