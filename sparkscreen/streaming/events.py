"""Streaming forms of three batch behaviours: bars that are held back until their day is settled, new-wins merging, and
dropping repeated events. State is bounded by the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import merge_history
from ..sources.paths import shared_path as shared_path


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of event files: event_id, ts, user_id, event_type, value, props."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def settled_bars(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Daily bars by user; a day's bars come out once no event of it is awaited any more (append mode)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id")
    bars = w.agg(F.avg("value").alias("price"), F.count("*").alias("volume"), F.sum("value").alias("trading_value"))
    return bars.select(F.lpad(F.col("user_id").cast("string"), 8, "0").alias("code"), F.to_date("w.start").alias("entry_date"), "price", "volume", "trading_value")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of events that repeat an id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process all that is there, exactly once, to Parquet files; returns them as a batch."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}.checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def merge_batches(stored: Callable[[], DataFrame], save: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of bars is merged into the stored history, new rows winning; save writes a snapshot
    under the batch's number, so a repeated batch writes the same snapshot again."""

    def merge(batch: DataFrame, number: int) -> None:
        save(merge_history(stored(), batch), number)

    return merge
