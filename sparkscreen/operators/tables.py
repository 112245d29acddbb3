"""Stored tables: keyed writes as new snapshots, securities' master, availability, alerts."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Only columns that the source brings are written: an absent column keeps what is stored, a present null erases it.
    A row that is new gets null elsewhere. The last of source rows with the same key must be made unique before."""
    brought = [c for c in source.columns if c in target.columns and c not in keys]
    s = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in brought], F.lit(True).alias("_hit"))
    j = target.join(s, keys, "full")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in brought else F.col(c) for c in target.columns])


def replace_rows(target: DataFrame, source: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace; of several source rows of a key the one with the largest order."""
    both = target.withColumn("_o", F.lit(0)).unionByName(source.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_o"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*target.columns)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.coalesce("processed", F.lit(False)))


def mark_processed(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: alert_id."""
    hit = ids.select("alert_id").distinct().withColumn("_hit", F.lit(True))
    return alerts.join(hit, "alert_id", "left").withColumn("processed", F.coalesce("_hit", "processed", F.lit(False))).select(*alerts.columns)


def master_diff(stocks: DataFrame, live: DataFrame) -> DataFrame:
    """code, change: new, gone, relisted (only what was delisted), inactive or kept."""
    s = stocks.select("code", F.coalesce("is_active", F.lit(True)).alias("_active"), (F.coalesce("status", F.lit("active")) == "delisted").alias("_delisted"), F.lit(True).alias("_s"))
    live = live.select("code", F.lit(True).alias("_l"))
    relisted = ~F.col("_active") & F.col("_delisted")
    change = F.when(F.col("_s").isNull(), "new").when(F.col("_l").isNull(), F.when(F.col("_active"), "gone").otherwise("inactive")).when(relisted, "relisted").otherwise("kept")
    return s.join(live, "code", "full").select("code", change.alias("change"))


#: Why a security is left out.
DELISTED_REASON = "上場廃止 (JPX 上場銘柄一覧に掲載なし)"
NO_DATA_REASON = "市場データ提供なし (Yahoo Finance にデータなし)"


def refresh_due(last: str | None, today: str, force: bool = False, days: int = 30) -> bool:
    """Whether the master is to be synchronised again: never done, at an unreadable date, or so many days ago."""
    try:
        return force or not last or (datetime.date.fromisoformat(today) - datetime.date.fromisoformat(last[:10])).days >= days
    except ValueError:
        return True


def master_sync(stocks: DataFrame, live: DataFrame, least: int = 3000, most_gone: float = 0.10) -> DataFrame:
    """The master after a live list: gone codes become inactive and delisted with the reason, delisted ones that are back
    active without one, new ones come in, and names, sectors and markets are the list's. A code that is paused otherwise
    stays so. If the list is short or too many would go, nothing changes; that guard is one row, joined to every row. Of
    several rows of a code in the list the first by name, sector and market counts."""
    live = live.groupBy("code").agg(F.min(F.struct("name", "sector", "market")).alias("r")).select("code", "r.*")
    diff = master_diff(stocks, live)
    guard = diff.agg((F.count_if(F.col("change").isin("new", "kept", "relisted")) >= least).alias("_long"), (F.count_if(F.col("change") == "gone") <= most_gone * F.count_if(F.col("change") != "new")).alias("_few"))
    l = live.select("code", *[F.col(c).alias(f"_{c}") for c in ("name", "sector", "market")], F.lit(True).alias("_live"))  # noqa: E741
    j = stocks.join(diff, "code", "full").join(l, "code", "left").crossJoin(F.broadcast(guard)).withColumn("_ok", F.col("_long") & F.col("_few"))
    gone, back, new = (F.col("_ok") & (F.col("change") == c) for c in ("gone", "relisted", "new"))
    fresh = lambda c: F.when(F.col("_ok") & F.col("_live"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return j.filter("_ok or change <> 'new'").select(
        "code", fresh("name"), fresh("sector"), fresh("market"),
        F.when(gone, "delisted").when(back | new, "active").otherwise(F.col("status")).alias("status"),
        F.when(gone, False).when(back | new, True).otherwise(F.col("is_active")).alias("is_active"),
        F.when(gone, DELISTED_REASON).when(back, None).otherwise(F.col("exclusion_reason")).alias("exclusion_reason"), "change",
    )


def track_no_data(stocks: DataFrame, asked: DataFrame, got: DataFrame, with_history: DataFrame, today: str, least_rate: float = 0.7, strikes: int = 3, pause: int = 30) -> DataFrame:
    """Codes that were asked for, gave nothing and have no history count a failure, once a day at most; from the third on
    they pause, with the reason. Success resets what was counted. If too few succeeded, the source is at fault and
    nothing changes."""
    flag = lambda df, name: df.select("code").distinct().withColumn(name, F.lit(True))
    j = stocks.join(flag(asked, "_a"), "code", "left").join(flag(got, "_g"), "code", "left").join(flag(with_history, "_h"), "code", "left")
    rate = flag(asked, "_a").join(flag(got, "_g"), "code", "left").agg(((F.count("*") > 0) & (F.count("_g") >= least_rate * F.count("*"))).alias("_ok"))
    j = j.crossJoin(F.broadcast(rate))
    ok, day = F.coalesce("_ok", F.lit(False)), F.lit(today)
    reset = ok & F.col("_a").isNotNull() & F.col("_g").isNotNull() & ((F.coalesce("fail_count", F.lit(0)) > 0) | F.col("excluded_until").isNotNull())
    failed = ok & F.col("_a").isNotNull() & F.col("_g").isNull() & F.col("_h").isNull()
    counted = failed & F.coalesce(F.col("last_fail_date") < day, F.lit(True))
    n = F.when(reset, 0).when(counted, F.coalesce("fail_count", F.lit(0)) + 1).otherwise(F.col("fail_count")).cast("int")
    paused = failed & (n >= strikes)
    until = F.date_format(F.date_add(F.to_date(day), pause), "yyyy-MM-dd")
    why = F.col("exclusion_reason")
    return j.select(
        "code", n.alias("fail_count"), F.when(reset, None).when(counted, day).otherwise(F.col("last_fail_date")).alias("last_fail_date"),
        F.when(reset, None).when(paused, until).otherwise(F.col("excluded_until")).alias("excluded_until"),
        F.when(reset & (why == NO_DATA_REASON), None).when(paused, NO_DATA_REASON).otherwise(why).alias("exclusion_reason"),
    )


def _marked(stocks: DataFrame, codes: DataFrame, changes: dict) -> DataFrame:
    hit = codes.select("code").distinct().withColumn("_hit", F.lit(True))
    return stocks.join(hit, "code", "left").withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in changes.items()}).select(*stocks.columns)


def suspend(stocks: DataFrame, codes: DataFrame, reason: str) -> DataFrame:
    return _marked(stocks, codes, {"is_active": F.lit(False), "status": F.lit("suspended"), "exclusion_reason": F.lit(reason)})


def reset_fail_counts(stocks: DataFrame, codes: DataFrame) -> DataFrame:
    return _marked(stocks, codes, {"fail_count": F.lit(0)})


def increment_fail_counts(stocks: DataFrame, codes: DataFrame) -> DataFrame:
    return _marked(stocks, codes, {"fail_count": F.col("fail_count") + 1})


def select_targets(stocks: DataFrame, today: str) -> DataFrame:
    """Active codes (null counts as active) that aren't paused."""
    return stocks.filter(F.coalesce("is_active", F.lit(True)) & ~F.coalesce(F.col("excluded_until") > F.lit(today), F.lit(False)))


def pending(index: DataFrame, processed: DataFrame, version: int) -> DataFrame:
    done = processed.filter(F.coalesce("parser_version", F.lit(0)) >= version).select("doc_id")
    return index.join(done, "doc_id", "left_anti")


def join_master(stocks: DataFrame, latest: DataFrame) -> DataFrame:
    """Every security, with its latest bar if there is one; the master's columns win."""
    own = [c for c in latest.columns if c == "code" or c not in stocks.columns]
    return stocks.join(latest.select(*own), "code", "left").withColumns({"sector": F.coalesce("sector", F.lit("Other")), "name": F.coalesce("name", F.lit("Unknown"))})


def join_fundamentals(df: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Fundamentals replace columns of the same name."""
    return df.drop(*[c for c in fundamentals.columns if c != "code"]).join(fundamentals, "code", "left")


def scan_window(log: DataFrame, today: str, configured: int, most: int = 365) -> DataFrame:
    """log: run_date, scan_date, ok, a row for each day that a run scanned. mark: the day up to which all is scanned, and
    days: how many to scan today, from the configured number up to the gap since the mark.

    A run without a failed day moves the mark to its date. One with failed days moves it to the day before the first of
    them, and never past where it was; so the mark is the least of the last clean run and of what failed after it."""
    runs = log.groupBy("run_date").agg(F.min(F.when(~F.col("ok"), F.date_sub("scan_date", 1))).alias("back"))
    clean = runs.agg(F.max(F.when(F.col("back").isNull(), F.col("run_date"))).alias("clean"))
    since = runs.crossJoin(F.broadcast(clean)).filter(F.col("clean").isNull() | (F.col("run_date") >= F.col("clean")))
    mark = since.agg(F.least(F.max("clean"), F.min("back")).alias("mark"))
    gap = F.datediff(F.to_date(F.lit(today)), "mark") + 1
    return mark.select("mark", F.least(F.lit(most), F.greatest(F.lit(configured), F.coalesce(gap, F.lit(configured)))).alias("days"))
