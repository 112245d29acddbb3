"""What the engine loads: price batches, listings, code maps, stored tables and lookups in them."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Headers of a listing file and the names of markets.
LISTING = {"コード": "code", "銘柄名": "name", "33業種区分": "sector", "市場・商品区分": "market"}
MARKETS = {"プライム": "Prime", "スタンダード": "Standard", "グロース": "Growth"}
ACTIONS = ("Dividends", "Stock Splits", "Capital Gains")


def batch_rows(wide: DataFrame, date_col: str = "Date") -> DataFrame:
    """A price batch with a column for each symbol and field ("7203.T|Close") as rows: code, Date, and each field.

    One pass over the batch without a shuffle; rows without any value drop out, and a symbol loses its exchange's suffix."""
    symbols: dict[str, list[str]] = {}
    for c in wide.columns:
        if c != date_col:
            symbol, name = c.rsplit("|", 1)
            symbols.setdefault(symbol, []).append(name)
    fields = sorted({f for names in symbols.values() for f in names})
    value = lambda s, f: (F.col(f"`{s}|{f}`") if f in symbols[s] else F.lit(None)).cast("double").alias(f)
    each = F.array(*[F.struct(F.lit(s.split(".")[0]).alias("code"), *[value(s, f) for f in fields]) for s in symbols])
    rows = wide.select(F.col(date_col).alias("Date"), F.explode(each).alias("r")).select("r.code", "Date", *[F.nanvl(F.col(f"r.`{f}`"), F.lit(None).cast("double")).alias(f) for f in fields])
    return rows.filter(F.coalesce(*[F.col(f"`{f}`") for f in fields]).isNotNull())


def batch_bars(wide: DataFrame, date_col: str = "Date") -> DataFrame:
    """The bars of a batch: rows with a closing price, without the columns of corporate actions."""
    return batch_rows(wide, date_col).filter("Close IS NOT NULL").drop(*ACTIONS)


def batch_events(wide: DataFrame, date_col: str = "Date") -> DataFrame:
    """code, split_date, ratio: the batch's split events of a plausible ratio, also of rows without a closing price."""
    rows = batch_rows(wide, date_col)
    if "Stock Splits" not in rows.columns:
        return rows.limit(0).select("code", F.to_date("Date").alias("split_date"), F.lit(0.0).alias("ratio"))
    return rows.select("code", F.to_date("Date").alias("split_date"), F.col("Stock Splits").alias("ratio")).filter("ratio BETWEEN 0.02 AND 100 AND ratio <> 1")


def listing(raw: DataFrame) -> DataFrame:
    """raw: raw_code, name, sector, market, ordinal. Securities with a sector, the first row of each four-character code."""
    m = F.col("market")
    kind = F.when(m.isNull(), "Unknown")
    for text, name in MARKETS.items():
        kind = kind.when(m.contains(text), name)
    rows = raw.filter("sector <> '-'").select(F.substring("raw_code", 1, 4).alias("code"), "name", "sector", kind.otherwise("Other").alias("market"), "ordinal")
    return rows.groupBy("code").agg(F.min_by(F.struct("name", "sector", "market"), "ordinal").alias("r")).select("code", "r.*")


def listing_csv(spark: SparkSession, path: str) -> DataFrame:
    """A listing file with English or Japanese headers; codes that were written as numbers lose their fraction."""
    df = spark.read.option("header", "true").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    if "コード" in df.columns:
        df = df.withColumnsRenamed(LISTING)
    return df.withColumn("code", F.regexp_replace("code", r"\.0$", "")) if "code" in df.columns else df


def code_map(raw: DataFrame) -> DataFrame:
    """filer, code of filers that have a code; five characters are a code and a check digit."""
    return raw.filter("sec_code IS NOT NULL").select("filer", F.when(F.length("sec_code") == 5, F.substring("sec_code", 1, 4)).otherwise(F.col("sec_code")).alias("code"))


def code_maps(files: DataFrame, filer: str, code: str, encoding: str = "cp932", skip: int = 0) -> DataFrame:
    """files: content, of CSV files in Shift_JIS, which Spark's own reader doesn't take, with so many lines before the header.
    filer, code. Each file is decoded in one task; there are few and small ones."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for content in pdf["content"]:
                rows = pd.read_csv(io.BytesIO(content), encoding=encoding, dtype=str, skiprows=skip)
                yield pd.DataFrame({"filer": rows[filer], "sec_code": rows[code].where(rows[code].notna(), None)})

    return code_map(files.select("content").mapInPandas(read, "filer string, sec_code string"))


def code_map_files(spark: SparkSession, path: str, filer: str, code: str, skip: int = 0) -> DataFrame:
    return code_maps(spark.read.format("binaryFile").load(path), filer, code, skip=skip)


def active(stocks: DataFrame, unknown: bool = True) -> DataFrame:
    """Active securities; unknown: whether one without the flag counts."""
    return stocks.filter(F.coalesce("is_active", F.lit(unknown)))


def fetched_on(bars: DataFrame, day: str) -> DataFrame:
    """The codes that were loaded with success on a day; without a status column, those that have a bar."""
    rows = bars.filter(F.col("entry_date") == F.to_date(F.lit(day)))
    return (rows.filter("fetch_status = 'success'") if "fetch_status" in rows.columns else rows).select("code").distinct()


def codes_by_day(bars: DataFrame) -> DataFrame:
    return bars.groupBy("entry_date").agg(F.countDistinct("code").alias("n_codes"))


def by_code(df: DataFrame, code: str) -> DataFrame:
    """The row of a code; the filter reaches the scan."""
    return df.filter(F.col("code") == code).limit(1)


def exists(df: DataFrame, code: str) -> bool:
    return not by_code(df, code).isEmpty()


def with_presence(codes: DataFrame, df: DataFrame) -> DataFrame:
    """codes with present: whether df has them. Many lookups as one join."""
    return codes.join(df.select("code").distinct().withColumn("present", F.lit(True)), "code", "left").fillna(False, ["present"])


def calendar(bars: DataFrame, since: str, until: str) -> DataFrame:
    """The weekdays within the bars' days and both dates."""
    days = bars.agg(F.min("entry_date").alias("a"), F.max("entry_date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return days.filter((F.weekday("day") < 5) & F.col("day").between(F.to_date(F.lit(since)), F.to_date(F.lit(until))))


def latest_batch(bars: DataFrame, stocks: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """The latest bar of each listed code with its name, sector and fundamentals, which replace columns of the same name."""
    newest = bars.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("entry_date")))).filter("_r = 1").drop("_r")
    own = newest.drop(*[c for c in fundamentals.columns if c != "code"])
    return own.join(stocks.select("code", "name", "sector"), "code").join(fundamentals, "code", "left")
