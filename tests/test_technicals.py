"""Indicators against pandas and known patterns."""

import datetime as dt
import math

import pandas as pd
import pytest

from sparkscreen.operators import technicals as tech


def bars(spark, code_prices: dict, start=dt.date(2026, 1, 1)):
    rows = [(c, start + dt.timedelta(days=i), None if p is None else float(p), 1000 + i) for c, prices in code_prices.items() for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "code string, entry_date date, price double, volume long")


def wave(n):
    return [1000 + 2 * i + 5 * math.sin(0.1 * i) + (i % 7) * 3 for i in range(n)]


def test_against_pandas(spark):
    prices = wave(120)
    got = tech.add_macd(tech.add_rsi(tech.add_bands(bars(spark, {"1001": prices})))).orderBy("entry_date").toPandas()
    p = pd.Series(prices)
    e12, e26 = p.ewm(span=12, adjust=False).mean(), p.ewm(span=26, adjust=False).mean()
    macd = e12 - e26
    move = p.diff().fillna(0)
    g, lo = move.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-move).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    rsi = 100 - 100 / (1 + g / lo)
    for name, want in (("ma25", p.rolling(25).mean()), ("ma75", p.rolling(75).mean()), ("bb_sigma", p.rolling(25).std()), ("macd", macd), ("macd_signal", macd.ewm(span=9, adjust=False).mean())):
        assert got[name].isna().equals(want.isna()), name
        assert (got[name] - want).abs().max() < 1e-8, name
    assert got["rsi_14"][:29].isna().all()
    assert (got["rsi_14"][29:] - rsi[29:]).abs().max() < 1e-8


def test_long_history_keeps_precision(spark):
    prices = [100 + (i * 37 % 101) for i in range(5000)]
    df = spark.createDataFrame([("1", dt.date(2000, 1, 1) + dt.timedelta(days=i), float(p)) for i, p in enumerate(prices)], "code string, entry_date date, price double")
    got = tech.ewm(df, "price", "y", 0.2).orderBy("entry_date").toPandas()["y"]
    want = pd.Series(prices, dtype=float).ewm(alpha=0.2, adjust=False).mean()
    assert (got - want).abs().max() < 1e-9


@pytest.mark.parametrize(("prices", "want"), [([64] * 45, 50.0), ([30 + 2 * i for i in range(45)], 100.0), ([300 - 3 * i for i in range(45)], 0.0)])
def test_rsi_patterns(spark, prices, want):
    last = tech.latest(tech.add_rsi(bars(spark, {"1": prices}))).first()
    assert last["rsi_14"] == pytest.approx(want, abs=1e-9)
    assert tech.latest(tech.simple_rsi(bars(spark, {"1": prices}))).first()["rsi_sma"] == pytest.approx(want, abs=1e-9)


def test_flat_series_is_neutral(spark):
    assert tech.latest(tech.add_macd(bars(spark, {"1": [73.3] * 70}))).first()["macd_status"] == "Neutral"


def test_glitches_become_null(spark):
    """A long run of far too large prices, one at the start of a history, and single odd days."""
    def nulls(prices):
        return [i for i, r in enumerate(tech.clean_prices(bars(spark, {"1": prices})).orderBy("entry_date").collect()) if r["price"] is None]

    assert nulls([820.0] * 22 + [4.1e10] * 9 + [820.0] * 25) == list(range(22, 31))
    assert set(nulls([4.1e10] * 9 + [820.0] * 150)) >= set(range(9)) and max(nulls([4.1e10] * 9 + [820.0] * 150)) <= 9
    assert nulls([60.0] * 14 + [-3.0, 7000.0] + [60.0] * 20) == [14, 15]


def test_weekend_goes_after_it_counted(spark):
    df = bars(spark, {"1": [100, 110, 120, 130]}, dt.date(2026, 4, 17))
    assert [r["entry_date"].day for r in tech.weekday_guard(df).orderBy("entry_date").collect()] == [17, 20]


def test_normalize_and_conform(spark):
    raw = spark.createDataFrame([("1", "2026-01-05T00:00", 10.0, "7"), ("1", "bad", 11.0, None)], "code string, Date string, Close double, Volume string")
    got = tech.normalize_bars(raw).orderBy("price").collect()
    assert (got[0]["entry_date"], got[0]["price"], got[0]["volume"]) == (dt.date(2026, 1, 5), 10.0, 7)
    assert got[1]["entry_date"] is None and got[1]["volume"] == 0
    assert tech.conform_schema(tech.normalize_bars(raw)).columns == list(tech.SCHEMA)


def test_summary_needs_thirty_bars(spark):
    got = {r["code"]: r for r in tech.summary(bars(spark, {"1": wave(29), "2": wave(40), "3": wave(120)})).collect()}
    assert set(got) == {"2", "3"} and got["2"]["trend_score"] <= 3
    p = pd.Series(wave(120))
    assert got["3"]["bb_p1sig"] == pytest.approx(p[-25:].mean() + p[-25:].std()) and got["3"]["volume_ratio"] == pytest.approx(1119 / (1000 + 107))
    assert got["3"]["real_volatility"] == pytest.approx((p / p.shift(1)).map(math.log, na_action="ignore").std() * 252**0.5 * 100)


def test_both_averages_in_one_pass_are_those_apart(spark):
    df = bars(spark, {"1": wave(90), "2": [100 + (i * 37 % 101) for i in range(80)]})
    columns = ["code", "entry_date", "rsi_14", "macd", "macd_signal", "macd_hist", "macd_status"]
    both, apart = tech.add_rsi_and_macd(df), tech.add_macd(tech.add_rsi(df))
    assert both.columns == apart.columns
    for x, y in zip(both.select(columns).orderBy("code", "entry_date").collect(), apart.select(columns).orderBy("code", "entry_date").collect(), strict=True):
        assert tuple(x)[:2] == tuple(y)[:2] and all(a == b if a is None or isinstance(a, str) else a == pytest.approx(b, rel=1e-12) for a, b in zip(tuple(x)[2:], tuple(y)[2:], strict=True))


def test_the_summary_sorts_bars_twice(spark, data):
    """By date and by block; every further sort of all columns would hold a task's rows once more."""
    from sparkscreen.sources.views import view

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = tech.summary(view(spark, data, "bars"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sorts = [x for x in plan.splitlines() if "Sort [code" in x and "entry_date" in x]
    assert len(sorts) == 3, sorts  # two of the summary, one of the volatility


def test_local_medians_without_an_aggregate_a_row(spark):
    """Glitches against plain medians of 31 rows, also beside NaN and infinity; no percentile slides over the rows."""
    import random
    import statistics

    r, start = random.Random(5), dt.date(2020, 1, 1)
    prices = [r.choice([None, -1.0, 9.0, 21.0, 30.0, 100.0, 101.0, 102.0, 400.0, 520.0]) for _ in range(300)]
    df = spark.createDataFrame([("a", start + dt.timedelta(days=i), p) for i, p in enumerate(prices)], "code string, entry_date date, price double")
    cleaned = tech.clean_prices(df)
    assert cleaned._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1  # a code's own median
    own = [p if p is not None and p > 0 else None for p in prices]
    whole, left = statistics.median([p for p in own if p is not None]), []
    for i, p in enumerate(own):
        near = [x for x in own[max(0, i - 15) : i + 16] if x is not None]
        local = p / statistics.median(near) if p is not None and len(near) >= 5 else 1.0
        left.append(None if p is None or local > 5 or local < 0.2 or p / whole > 20 or p / whole < 0.05 else p)
    want = [None if p is None or i and left[i - 1] is not None and not 0.2 <= p / left[i - 1] <= 5 else p for i, p in enumerate(left)]
    assert [x["price"] for x in cleaned.orderBy("entry_date").collect()] == want and want.count(None) > own.count(None)
    odd = [100.0] * 8 + [float("nan"), 1.0, float("inf")] + [100.0] * 8
    df = spark.createDataFrame([("b", start + dt.timedelta(days=i), p) for i, p in enumerate(odd)], "code string, entry_date date, price double")
    assert [x["price"] for x in tech.clean_prices(df).orderBy("entry_date").collect()] == [100.0] * 8 + [None] * 3 + [100.0] * 8
