"""Stored bars: plans of bucketed reading, snapshots by month, ranks over ranges."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from sparkscreen.operators import history, ranks, tables
from sparkscreen.operators import technicals as tech
from sparkscreen.sources.paths import shared_path
from sparkscreen.sources.stored_bars import MonthlyBars, read_bucketed, store_bucketed

DAY = datetime.date(2020, 1, 15)


def bars(spark, codes=6, days=120, price=100.0):
    return spark.createDataFrame([(f"c{c}", DAY + datetime.timedelta(days=d), price + c + d, d) for c in range(codes) for d in range(days)], "code string, entry_date date, price double, volume long")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bucketed(spark):
    store_bucketed(bars(spark), "bucketed_bars", shared_path(spark, "bucketed"), 4)
    yield "bucketed_bars"
    spark.sql("DROP TABLE bucketed_bars")


def test_windows_and_joins_by_code_move_nothing(spark, bucketed, rows):
    stored = read_bucketed(spark, bucketed)
    indicators = tech.indicators(stored)
    assert "Exchange" not in plan(indicators) and "Window" in plan(indicators)
    assert rows(indicators.select("code", "entry_date", "ma25", "macd", "rsi_14")) == rows(tech.indicators(bars(spark)).select("code", "entry_date", "ma25", "macd", "rsi_14"))
    both = stored.hint("merge").join(read_bucketed(spark, bucketed).withColumnRenamed("price", "again"), "code")
    assert "Exchange" not in plan(both)


def test_days_prune_months(spark, bucketed, rows):
    some = read_bucketed(spark, bucketed, since="2020-03-10", until="2020-03-20")
    told = plan(some)
    assert "month" in told.split("PartitionFilters: [")[1].split("]")[0] and "entry_date" in told.split("PushedFilters: [")[1].split("]")[0]
    assert rows(some) == rows(bars(spark).filter("entry_date between date'2020-03-10' and date'2020-03-20'"))


def folders(store):
    return store.snapshot().months


def test_a_write_renews_the_months_it_touches(spark, rows):
    store = MonthlyBars(spark, shared_path(spark, "monthly"))
    store.write(bars(spark), lambda old, new: new)
    before = folders(store)
    assert sorted(before) == ["2020-01", "2020-02", "2020-03", "2020-04", "2020-05"]
    new = bars(spark, codes=8, price=7.0).filter("entry_date >= date'2020-04-10' and entry_date < date'2020-05-03'")
    store.write(new, history.merge_history)
    after = folders(store)
    assert {m for m in after if after[m] != before[m]} == {"2020-04", "2020-05"} and store.snapshot().version == 2
    assert rows(store.read()) == rows(history.merge_history(bars(spark), new))
    assert rows(store.read(since="2020-04-01", until="2020-04-12")) == rows(history.merge_history(bars(spark), new).filter("entry_date between date'2020-04-01' and date'2020-04-12'"))
    read = {f.rsplit("/", 2)[-2] for f in store.read(since="2020-02-01", until="2020-02-20").inputFiles()}
    assert read == {"_month=2020-02"}
    assert folders(store) == store.write(new.limit(0), history.merge_history).months


def test_a_failed_write_leaves_the_last_snapshot(spark, rows):
    store = MonthlyBars(spark, shared_path(spark, "monthly"))
    store.write(bars(spark), lambda old, new: new)
    want = rows(store.read())
    broken = bars(spark).withColumn("price", F.when(F.col("volume") == 60, F.raise_error(F.lit("no price"))).otherwise(F.col("price")).cast("double"))
    with pytest.raises(Exception, match="no price"):
        store.write(broken, lambda old, new: new)
    with pytest.raises(ValueError, match="weren't read"):
        store.write(bars(spark).filter("volume < 3"), lambda old, new: new.withColumn("entry_date", F.date_add("entry_date", 90)))
    assert store.snapshot().version == 1 and rows(store.read()) == want


def test_one_of_two_writers_wins(spark, rows):
    path = shared_path(spark, "monthly")
    store = MonthlyBars(spark, path)
    store.write(bars(spark, days=20), lambda old, new: new)

    def late(old, new):
        MonthlyBars(spark, path).write(bars(spark, days=20, price=1.0), lambda old, new: new)  # another writer is done first
        return new

    with pytest.raises(Exception, match="(?i)exist"):
        store.write(bars(spark, days=20, price=2.0), late)
    assert store.snapshot().version == 2 and rows(store.read()) == rows(bars(spark, days=20, price=1.0))


def test_keyed_writes_columns_and_old_snapshots(spark, rows):
    store = MonthlyBars(spark, shared_path(spark, "monthly"))
    store.write(bars(spark, codes=2), lambda old, new: new)
    source = bars(spark, codes=3, days=10, price=5.0).select("code", "entry_date", "price")
    key = ["code", "entry_date"]
    store.write(source, lambda old, new: tables.upsert(old, new, key))
    assert rows(store.read()) == rows(tables.upsert(bars(spark, codes=2), source, key))
    wider = bars(spark, codes=1, days=3).withColumn("open", F.lit(1.5))
    store.write(wider, history.merge_history)
    assert store.read().filter("open = 1.5").count() == 3 and store.read(since="2020-03-01").filter("open is not null").count() == 0
    undated = bars(spark, codes=1, days=1).withColumn("entry_date", F.lit(None).cast("date")).withColumn("open", F.lit(None).cast("double"))
    store.write(undated, lambda old, new: new)
    want = rows(store.read())
    assert store.read().filter("entry_date is null").count() == 1 and store.read(since="2020-01-01").filter("entry_date is null").count() == 0
    store.remove_old()
    assert rows(MonthlyBars(spark, store.path).read()) == want and len(store._pointers()) == 1
    with pytest.raises(FileNotFoundError):
        MonthlyBars(spark, shared_path(spark, "monthly")).read()


def test_ranks_are_whole_and_no_task_has_all_rows(spark):
    r = random.Random(1)
    values = [(f"k{i:05d}", r.choice([None, 1.0, 1.0, r.random()])) for i in range(3000)]
    df = spark.createDataFrame(values, "code string, score double")
    got = ranks.numbered(df, F.desc_nulls_last("score"), F.col("code"), partitions=7)
    assert "SinglePartition" not in plan(got) and "SinglePartition" not in plan(got.filter("rank < 9"))
    want = sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert [(x["code"], x["rank"]) for x in sorted(got.collect(), key=lambda x: x["rank"])] == [(c, i + 1) for i, (c, _) in enumerate(want)]
    assert got.columns == ["code", "score", "rank"] and ranks.numbered(df.limit(0), F.col("code")).count() == 0


def test_buckets_grow_with_the_rows():
    """A task's rows are bounded: with four buckets at any size they grew with the table."""
    from sparkscreen.sources.stored_bars import BUCKET_ROWS, buckets_for

    assert buckets_for(0) == buckets_for(600_000) == buckets_for(4 * BUCKET_ROWS) == 4
    assert all(rows / buckets_for(rows) <= BUCKET_ROWS for rows in (5_000_000, 36_000_000, 216_000_000))


def test_the_stored_queries_take_buckets_by_rows(spark, data, monkeypatch):
    from sparkscreen.plans import registry

    monkeypatch.setattr("sparkscreen.sources.stored_bars.BUCKET_ROWS", 500)
    seen = []
    monkeypatch.setattr(registry, "store_bucketed", lambda bars, name, path, buckets: seen.append(buckets))
    registry._bucketed(spark, data)
    assert seen == [-(-spark.read.parquet(f"{data}/lineitem.parquet").count() // 500)]
