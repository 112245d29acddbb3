"""Liquidity of codes over the market's newest days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def liquidity(bars: DataFrame, target_date: str | None = None, least_fill: float = 60.0) -> DataFrame:
    """code, avg_trading_value_20d, zero_volume_days_5d, latest_trade_date, is_recent_trade.

    The newest day is skipped if, of at least 100 rows over at least two days, less than least_fill percent of its rows
    were traded. Dates are ranked among distinct dates, never among bars; bars of older days than the 20 newest
    don't go on to the aggregate by code. A
    target_date that the market has makes the days end there."""
    value = F.coalesce(F.col("trading_value"), F.col("volume") * F.col("price"), F.lit(0.0))
    rows = bars.select("code", "entry_date", "volume", value.alias("yen"))
    days = rows.groupBy("entry_date").agg(F.count("*").alias("n"), F.count_if(F.col("yen") > 0).alias("traded"))
    by_date = Window.orderBy(F.desc("entry_date"))
    market = Window.partitionBy(F.lit(0))
    ranked = days.select("*", F.row_number().over(by_date).alias("rank"), F.sum("n").over(market).alias("rows"), F.count("*").over(market).alias("n_days"))
    thin = F.max(F.when((F.col("rank") == 1) & (F.col("rows") >= 100) & (F.col("n_days") >= 2) & (F.col("traded") * 100.0 / F.col("n") < least_fill), 1).otherwise(0)).over(market)
    skip = thin
    if target_date is not None:
        at = F.max(F.when(F.col("entry_date") == F.lit(target_date).cast("date"), F.col("rank"))).over(market)
        skip = F.coalesce(at - 1, thin)
    ranked = ranked.select("entry_date", "rank", (F.col("rank") - skip).alias("place"))
    joined = rows.join(F.broadcast(ranked.filter("place <= 20")), "entry_date")  # a few days of the market
    late = F.col("place").between(1, 20)
    last = F.col("place").between(1, 5)
    zero = (F.col("yen") <= 0) | (F.col("volume") <= 0) | F.col("volume").isNull()
    out = joined.groupBy("code").agg(
        F.count_if(late).alias("_n"), F.avg(F.when(late, F.col("yen"))).alias("_avg"), F.count_if(last).alias("_n5"), F.count_if(last & zero).alias("_zero"),
        F.max("entry_date").cast("string").alias("latest_trade_date"), (F.min("rank") <= 5).alias("is_recent_trade"),
    ).filter("_n > 0 or _n5 > 0")
    return out.select("code", F.coalesce("_avg", F.lit(0.0)).alias("avg_trading_value_20d"), F.when(F.col("_n5") > 0, F.col("_zero")).otherwise(F.lit(5)).cast("long").alias("zero_volume_days_5d"), "latest_trade_date", "is_recent_trade")
