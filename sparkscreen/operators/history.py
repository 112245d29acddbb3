"""Incremental history: what to load, whether stored prices still fit, and how new ones are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 0.005


def weekdays_after(last: Column, today: Column) -> Column:
    """Weekdays after last up to today."""
    days = F.sequence(F.date_add(last, 1), today)
    return F.when(last < today, F.size(F.filter(days, lambda d: F.weekday(d) < 5))).otherwise(0)


def load_plan(bars: DataFrame, codes: DataFrame, today: str, least_rows: int = 20, force: bool = False) -> DataFrame:
    """Per code the period to load: one year for little or no history, else the smallest that covers the weekdays since."""
    day = F.to_date(F.lit(today))
    own = codes.select("code").join(bars.groupBy("code").agg(F.max("entry_date").alias("last_date"), F.count("*").alias("n")), "code", "left")
    need = weekdays_after(F.col("last_date"), day) + 1
    period = F.when(F.lit(force) | F.col("last_date").isNull() | (F.coalesce("n", F.lit(0)) < least_rows), "1y")
    for d in (2, 5, 10, 21):
        period = period.when(need <= d, f"{d}d")
    return own.select("code", "last_date", F.coalesce("n", F.lit(0)).alias("n_rows"), period.otherwise("1y").alias("period"))


def drop_unsettled(bars: DataFrame, today: str, now: str, settled_at: str = "16:00") -> DataFrame:
    """Today's bar goes while the market's day isn't over."""
    return bars.filter(~((F.col("entry_date") == F.to_date(F.lit(today))) & F.lit(now < settled_at)))


def adjust_mismatch(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Per code with common days the ratio farthest from 1 of stored to new price, and whether it is off by over 0.5 %."""
    a, b = stored.select("code", "entry_date", F.col("price").alias("p")), new.select("code", "entry_date", F.col("price").alias("q"))
    r = a.join(b, ["code", "entry_date"]).filter("p > 0 and q > 0").select("code", (F.col("p") / F.col("q")).alias("r"))
    return r.groupBy("code").agg(F.max_by("r", F.abs(F.col("r") - 1)).alias("ratio")).withColumn("mismatch", F.abs(F.col("ratio") - 1) > TOLERANCE)


def merge_history(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Both by name, missing columns null; of rows of one code and day the new one."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("code", "entry_date").orderBy(F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def route_history(stored: DataFrame, new: DataFrame, refetched: DataFrame, since: str) -> DataFrame:
    """Codes whose stored prices no longer fit take the refetched history, if there is one; the others are merged."""
    flags = adjust_mismatch(stored, new).filter("mismatch").select("code")
    again = refetched.join(flags, "code", "left_semi")
    rest = merge_history(stored, new).join(again.select("code").distinct(), "code", "left_anti")
    return rest.unionByName(again, allowMissingColumns=True).filter(F.col("entry_date") >= F.to_date(F.lit(since)))


def union_diagonal(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def recent(bars: DataFrame, as_of: str, days: int, codes: DataFrame | None = None) -> DataFrame:
    """Bars of the last days before as_of; the filter reaches the scan."""
    out = bars.filter(F.col("entry_date") >= F.date_sub(F.to_date(F.lit(as_of)), days))
    return out if codes is None else out.join(codes.select("code").distinct(), "code", "left_semi")


def warm_up(bars: DataFrame, as_of: str, months: int) -> DataFrame:
    adjusted = F.coalesce(F.col("adj_close") if "adj_close" in bars.columns else F.lit(None).cast("double"), "price")
    return recent(bars, as_of, months * 31).select("code", "entry_date", F.nullif("open", F.lit(0.0)).alias("open"), F.nullif("high", F.lit(0.0)).alias("high"), F.nullif("low", F.lit(0.0)).alias("low"), adjusted.alias("price"), "volume")
