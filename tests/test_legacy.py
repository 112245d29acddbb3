"""The earlier scorer on cases worked out by hand from its definition, and hashes of rows."""

import hashlib

import pytest

from sparkscreen.operators import legacy, quality

STRATEGY = legacy.Strategy(
    name="s", base_score=10, points={"roe": 10, "pbr": 5, "dividend_yield": 8}, thresholds={"roe": 10, "pbr": 1, "dividend_yield": 2}, categories={"pbr": "value"}, lower_is_better=frozenset({"pbr"}),
    status_bonuses={"pick": {"1": 10, "0": -5}, "risk": {"true": -50}},
)
KINDS = "code string, sector string, roe double, pbr double, dividend_yield string, payout_ratio double, rsi_14 double, macd_hist double, market_cap double, pick string, risk boolean, cnt long, entry_date string"


def scored(spark, *rows, strategy=STRATEGY):
    """rows: code, and what differs from a plain row."""
    plain = {"sector": "x", "roe": 0.0, "pbr": 3.0, "dividend_yield": "0", "payout_ratio": 40.0, "rsi_14": 40.0, "macd_hist": 0.0, "market_cap": 100.0, "pick": None, "risk": False, "cnt": 1, "entry_date": "2026-01-01"}
    full = [tuple({"code": code, **plain, **more}[k.split()[0]] for k in KINDS.split(", ")) for code, more in rows]
    return {r["code"]: r for r in legacy.legacy_score(spark.createDataFrame(full, KINDS), strategy).collect()}


def norm(fund=0.0, trend=55.0, adj=0.0, size=1.0):
    """A plain row has 10 of 10 + 10 + 5 + 8 + 10 + 0 - (the most of risk is -50) = -7 points, so 1 is the least divisor."""
    most = max(10 + 23 + 10 - 50, 1)
    return min(100.0, max(0.0, (min(100.0, (10 + fund) / most * 100) * 0.7 + min(100.0, trend / 45 * 100) * 0.3 + adj) * size))


def test_a_divisor_of_a_negative_most_is_one(spark):
    got = scored(spark, ("a", {}), ("b", {"risk": True}), ("c", {"pick": "0"}), ("d", {"market_cap": 50.0}), ("e", {"market_cap": None}), ("f", {"risk": True, "rsi_14": 80.0, "macd_hist": -9.0}))
    assert got["a"]["quant_score"] == 100.0 and got["b"]["quant_score"] == norm(adj=-50) == 50.0 and got["c"]["quant_score"] == 95.0
    assert got["d"]["quant_score"] == 80.0 and got["e"]["quant_score"] == 50.0
    assert got["f"]["quant_score"] == pytest.approx(70 + (50 - 15 - 10) / 45 * 30 - 50, abs=0.005)


PLAIN = legacy.Strategy(name="p", base_score=10, points={"roe": 30, "pbr": 20, "dividend_yield": 20, "absent": 20}, thresholds={"roe": 10, "pbr": 1, "dividend_yield": 2, "absent": 1}, lower_is_better=frozenset({"pbr"}))


def test_points_by_metric(spark):
    none = {"rsi_14": 80.0, "macd_hist": -9.0}  # what indicators give is 25 of 45
    cases = {
        "a": ({}, 0), "b": ({"roe": 10.0}, 15), "c": ({"roe": 99.0}, 30), "d": ({"pbr": 1.0}, 20), "e": ({"pbr": None}, 20), "f": ({"dividend_yield": "3%"}, 10), "g": ({"dividend_yield": "4", "payout_ratio": 100.0}, 10),
        "h": ({"dividend_yield": "1.9"}, 0), "i": ({"dividend_yield": "n/a"}, 0), "j": ({"dividend_yield": "1,000"}, 20), "k": ({"dividend_yield": "9", "payout_ratio": None}, 20),
    }
    got = scored(spark, *[(k, none | more) for k, (more, _) in cases.items()], strategy=PLAIN)
    for k, (_, points) in cases.items():
        assert got[k]["quant_score"] == pytest.approx((10 + points) * 0.7 + 25 / 45 * 30, abs=0.006), k
    assert {"quant_score_normalized", "rank", "strategy_name", "entry_date", "roe"} <= set(got["a"].asDict()) and not {"cnt", "fund_norm", "raw_score", "score_final_adj", "raw_with_noise"} & set(got["a"].asDict())


def test_indicators_cap_and_ranks(spark):
    got = scored(spark, ("a", {"rsi_14": 50.05}), ("b", {"rsi_14": 50.2}), ("c", {"rsi_14": None}), ("d", {"sector": None, "macd_hist": 1.0}), ("e", {"sector": None, "macd_hist": -1.0}))
    assert got["a"]["quant_score"] == 50.0 and got["b"]["quant_score"] == 100.0 and got["c"]["quant_score"] == 100.0
    assert {got["d"]["rank"], got["e"]["rank"]} == {1.0, 2.0} and sorted(got[k]["rank"] for k in "abc") in ([1.0, 2.0, 3.0], [1.5, 1.5, 3.0], [1.0, 2.5, 2.5], [2.0, 2.0, 2.0])
    empty = legacy.legacy_score(spark.createDataFrame([("a", 1.0)], "code string, roe double"), None).first()
    assert empty["quant_score"] == 0.0


def test_ties_share_their_mean_rank(spark):
    codes = [f"c{i}" for i in range(40)]
    got = scored(spark, *[(c, {"market_cap": 0.0}) for c in codes])
    noise = {c: ord(hashlib.md5(c.encode()).hexdigest()[0]) % 10 for c in codes}
    for c in codes:
        above, same = sum(noise[x] > noise[c] for x in codes), sum(noise[x] == noise[c] for x in codes)
        assert got[c]["rank"] == above + (same + 1) / 2


def test_candidates_come_by_score(spark):
    rows = [("1", 1500.0, 5000, 45.0, 80.0), ("2", 30.0, 9000, 45.0, 99.0), ("3", 900.0, 10, 45.0, 99.0), ("4", 900.0, 5000, 5.0, 99.0), ("5", None, None, None, None), ("6", 900.0, 2000, 20.0, 95.0)]
    df = spark.createDataFrame(rows, "code string, price double, volume long, equity_ratio double, quant_score double")
    assert [r["code"] for r in legacy.filter_candidates(df).collect()] == ["6", "1", "5"]
    assert [r["code"] for r in legacy.filter_candidates(df, n=1).collect()] == ["6"] and legacy.filter_candidates(df, n=0).count() == 3
    assert {r["code"] for r in legacy.filter_candidates(df.drop("quant_score", "volume")).collect()} == {"1", "3", "5", "6"}


def test_thresholds_in_their_direction(spark):
    df = spark.createDataFrame([("a", 15.0, 0.5, 80.0), ("b", 5.0, 0.5, 70.0), ("c", 12.0, 0.9, 90.0), ("d", 12.0, 2.0, 95.0), ("e", None, 0.5, 99.0)], "code string, roe double, pbr double, quant_score double")
    s = legacy.Strategy(thresholds={"roe": 10, "pbr": 1, "absent": 3}, lower_is_better=frozenset({"pbr"}))
    assert [r["code"] for r in legacy.filter_and_rank(df, s).collect()] == ["c", "a"]
    assert [r["code"] for r in legacy.filter_and_rank(df, s, bypass=True).collect()] == ["e", "d", "c", "a", "b"]


@pytest.mark.parametrize(("y", "cf", "payout", "want"), [(4.0, 1.0, 50.0, 20.0), (1.0, 1.0, 150.0, 0.0), (4.0, 1.0, 150.0, 0.0), (4.0, -1.0, 150.0, 0.0), (None, -1.0, None, 0.0), (4.0, None, None, 20.0)])
def test_dividend_points_never_fall_below_none_given(spark, y, cf, payout, want):
    df = spark.createDataFrame([(y, cf, payout)], "dividend_yield double, operating_cf double, payout_ratio double")
    assert legacy.dividend_quality(df).first()["dividend_points"] == want


def test_row_hash_takes_texts_as_they_are(spark):
    df = spark.createDataFrame([("0050", "abc", 12.0, 0.5, None, float("nan"), 7)], "code string, name string, per double, pbr double, roe double, dividend_yield double, quant_score long")
    want = hashlib.md5(b"0050|abc|12|0.5|NaN|NaN|NaN|NaN|7").hexdigest()
    assert df.select(quality.row_hash(df)).first()[0] == want


def test_headers_and_numbers(spark):
    df = spark.createDataFrame([("1", "12.5", None, "1,000"), ("2", "-", "8", "x")], "`コード` string, `予想PER` string, `PER` string, `平均売買代金` string")
    assert [tuple(r) for r in quality.named(df).collect()] == [("1", 12.5, 1000.0), ("2", 8.0, None)]
