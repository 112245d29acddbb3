"""The filter, the scores and the grades on fifteen securities with known results, and repairs and reports."""

import pytest

from sparkscreen.config import ScreenConfig
from sparkscreen.operators import fundamentals, quality, report, scoring
from sparkscreen.operators.liquidity import liquidity
from sparkscreen.operators.prefilter import prefilter

COLUMNS = "code sector market price net_assets equity_ratio sales operating_income operating_margin operating_cf net_profit per pbr roe dividend_yield rsi_14 ma25_divergence macd_hist macd_status avg zero last recent".split()
#: Golden securities, with the score and grade or the reason and detail that they must get.
KNOWN = """
1001|情報・通信業|Prime|2000|5e10|75|8e10|1e10|12.5|1.2e10|7e9|12|1.1|18|3.5|55|3|0.5|Bullish|5e8|0|2026-03-27|1|71.9 Grade A
1002|サービス業|Growth|3500|2e10|60|3e10|5e9|16.7|4.5e9|3.5e9|35|4.5|28|0.5|68|12|1.2|Bullish|8e8|0|2026-03-27|1|51.6 Grade B
1003|機械|Standard|800|3e10|82|2e10|2e9|10|2.5e9|1.5e9|5.5|0.45|8|4.8|42|-6|0|Neutral|8e7|0|2026-03-27|1|71.5 Grade A
1004|電気・ガス業|Prime|1500|4e10|70|5e10|6e9|12|7e9|4e9|10|0.9|11|5.2|48|-1|0.2|Bullish|2e8|0|2026-03-27|1|70.8 Grade A
2001|不動産業|Standard|600|1e10|40|1.5e10|-5e8|-3.3|1e9|2e9|3.5|0.5|15|2|50|2|0.1|Bullish|5e7|0|2026-03-27|1|54.0 Grade B
2002|化学|Standard|400|8e9|35|1e10|3e8|3|5e8|-5e8|14|0.8|-5|1|40|-5|-0.2|Bearish|6e7|0|2026-03-27|1|30.6 Grade C
3001|小売業|Standard|500|5e9|50|5e9|3e8|6|4e8|2e8|12|1|8|2|52|0|0|Neutral|1.5e7|0|2026-03-27|1|極小流動性トラップ: 20日平均売買代金不足 (1,500万円 < 3,000万円)
3002|卸売業|Standard|42|2e9|30|3e9|1e8|3.3|1.5e8|5e7|20|0.6|5|0|45|-2|-0.1|Bearish|1e8|0|2026-03-27|1|超低位ボロ株: 株価基準未満 (42円 < 50円)
3003|サービス業|Growth|120|-1e9|-2|4e9|-4e8|-10|-3e8|-8e8||||0|30|-15|-0.5|Bearish|4e7|0|2026-03-27|1|構造的破綻 (債務超過): 純資産マイナス (-1,000,000,000円)
3004|輸送用機器|Standard|600|1e10|45|2e10|-1.5e9|-7.5|-4e9|-1.8e9||0.8|-10|0|38|-8|-0.3|Bearish|7e7|0|2026-03-27|1|致命的キャッシュ枯渇: 営業CFマージン大幅赤字 (-20.0% < -10.0%)
3005|銀行業|Prime|1800|8e10|12|1e11|1.5e10|15|-2.5e10|1.1e10|9|0.7|12|4|52|1|0.1|Bullish|3e8|0|2026-03-27|1|59.6 Grade B
3006|金属製品|Standard|700|8e9|55|1e10|8e8|8|9e8|5e8|11|0.9|8.5|2.5|50|0|0|Neutral|4e7|1|2026-03-27|1|商い不成立: 直近5営業日以内に出来高ゼロ日あり (1日)
3007|食料品|Standard|900|1.2e10|65|1.5e10|1e9|6.7|1.2e9|7e8|13|1|9|2.2|49|0|0|Neutral|5e7|0|2026-03-10|0|データ鮮度不足 (取引停止): 最終取引日 (2026-03-10) が直近5営業日範囲外
4001|その他製品|Standard|1000|1e10|70|1.2e10|1e9|8.3|1e9|6e8|10|0.8|10|3|50|0|0|Neutral|1e8|0|2026-03-27|1|45.0 PASS
4002|情報・通信業|Prime|2500|3e10|75|4e10|6e9|15|7e9|4e9|12|1.2|16|3|32|-16|-1.5|Bearish|2.5e8|0|2026-03-27|1|66.7 Grade B
"""
TEXTS = {"code", "sector", "market", "macd_status", "last"}


@pytest.fixture(scope="module")
def known(spark):
    rows, want = [], {}
    for line in KNOWN.strip().splitlines():
        *values, result = line.split("|")
        row = [v if c in TEXTS else int(v) if c == "zero" else bool(int(v)) if c == "recent" else float(v) if v else None for c, v in zip(COLUMNS, values, strict=True)]
        rows.append(tuple(row))
        want[row[0]] = result
    kinds = ", ".join(f"{c} {'string' if c in TEXTS else 'long' if c == 'zero' else 'boolean' if c == 'recent' else 'double'}" for c in COLUMNS)
    df = spark.createDataFrame(rows, kinds)
    liq = df.selectExpr("code", "avg AS avg_trading_value_20d", "zero AS zero_volume_days_5d", "last AS latest_trade_date", "recent AS is_recent_trade")
    return df.drop("avg", "zero", "last", "recent").selectExpr("*", "'active' AS status", "CAST(NULL AS STRING) AS exclusion_reason"), liq, want


def test_known_results(known):
    df, liq, want = known
    got = {r["code"]: r for r in scoring.score(prefilter(df, liq)).collect()}
    for code, result in want.items():
        r = got[code]
        if r["filter_reason"]:
            assert f"{r['filter_reason']}: {r['filter_detail']}" == result
        else:
            assert f"{r['quant_score']:.1f} {r['verdict']}" == result


def test_presets_and_markets(known):
    df, liq, _ = known
    assert scoring.score_by_preset(df).groupBy("code").count().filter("count <> 4").count() == 0
    doubled = scoring.score(df, ScreenConfig(multipliers={k: 2.0 for k in ("profit", "value", "safety", "dividend", "technical")}))
    plain = {r["code"]: r["quant_score"] for r in scoring.score(df).collect()}
    assert all(abs(r["quant_score"] - plain[r["code"]]) <= 0.1 for r in doubled.collect())
    out = prefilter(df, liq, ScreenConfig(target_markets=("Prime",))).filter("code = '1003'").first()
    assert out["filter_reason"] == "対象外市場"


def test_liquidity_skips_a_thin_day(spark):
    rows = [(f"{c:03d}", f"2026-01-{d:02d}", 10.0, 0 if d == 20 and c > 3 else 100, 0.0 if d == 20 and c > 3 else 1000.0) for c in range(10) for d in range(1, 21)]
    df = spark.createDataFrame(rows, "code string, d string, price double, volume long, trading_value double").selectExpr("code", "CAST(d AS DATE) AS entry_date", "price", "volume", "trading_value")
    assert {r["zero_volume_days_5d"] for r in liquidity(df).collect()} == {0}
    at = liquidity(df, target_date="2026-01-20").collect()
    assert sorted({r["zero_volume_days_5d"] for r in at}) == [0, 1]


def test_repairs_keep_bad_divisors_out(spark):
    df = spark.createDataFrame([("a", float("nan"), 10.0, 100.0, 5.0), ("b", 50.0, float("inf"), 0.0, None), ("c", 50.0, 100.0, 100.0, 5.0)], "code string, net_assets double, total_assets double, price double, eps double")
    got = {r["code"]: r for r in fundamentals.repair(df).collect()}
    assert got["a"]["equity_ratio"] is None and got["b"]["equity_ratio"] is None and got["c"]["equity_ratio"] == 50.0
    assert got["b"]["per"] is None and got["c"]["per"] == 20.0


def test_profit_status(spark):
    df = spark.createDataFrame([(-1.0, 2.0), (1.0, -2.0), (-5.0, -2.0), (1.0, 2.0), (0.0, 2.0)], "prev_net_profit double, net_profit double")
    got = [(r["turnaround_status"], r["profit_growth_raw"]) for r in fundamentals.profit_status(df).collect()]
    assert got == [("turnaround_black", 300.0), ("turnaround_white", -300.0), ("loss_shrinking", 60.0), ("normal", 100.0), ("normal", None)]


def test_contract_and_report(known, tmp_path):
    df, liq, _ = known
    s = scoring.score(prefilter(df, liq))
    assert {r["column"]: r["n_bad"] for r in quality.contract_check(s).collect()} == {"code": 0, "price": 0, "verdict": 0}
    full = fundamentals.profit_status(fundamentals.repair_valuation(s)).selectExpr("*", "code AS name", "ma25_divergence AS ma_div_shown")
    report.write_reports(full, str(tmp_path))
    passed = report.read_report(df.sparkSession, f"{tmp_path}/passed")
    assert passed.count() == 9 and tuple(passed.columns) == report.COLUMNS
    (file,) = (tmp_path / "passed").glob("*.csv")
    assert file.read_bytes().startswith("\ufeffRank,Code,".encode())
    rejected = report.read_report(df.sparkSession, f"{tmp_path}/rejected")
    assert rejected.count() == 6 and {"filter_reason", "filter_detail"} <= set(rejected.columns)
    quality.require_contract(s).count()
    with pytest.raises(Exception, match="essential"):
        quality.require_contract(s.selectExpr("code", "price", "CAST(NULL AS STRING) AS verdict")).count()


def test_contract_counts_nan_as_missing(spark):
    rows = [("a", 1.0, "x"), ("b", float("nan"), "x"), ("c", None, None)]
    df = spark.createDataFrame(rows, "code string, price double, verdict string")
    assert {r["column"]: r["n_bad"] for r in quality.contract_check(df, ("code", "price", "verdict", "gone")).collect()} == {"code": 0, "price": 2, "verdict": 1, "gone": 3}
    quality.require_contract(df.filter("code = 'a'")).count()
    with pytest.raises(Exception, match="essential value"):
        quality.require_contract(df.filter("code = 'b'")).count()


def test_a_write_counts_its_contract(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", 1.0, "x"), ("b", float("nan"), "y"), ("c", 2.0, None)], "code string, price double, verdict string")
    got = quality.write_observed(df, f"{tmp_path}/all", counts={"x": F.col("verdict") == "x"}, stop=False)
    assert got == {"n": 3, "missing code": 0, "missing price": 1, "missing verdict": 1, "count x": 1} and spark.read.parquet(f"{tmp_path}/all").count() == 3
    with pytest.raises(quality.ContractError, match="price"):
        quality.write_observed(df, f"{tmp_path}/broken")
    assert not (tmp_path / "broken").exists()
    assert quality.write_observed(df.limit(1), f"{tmp_path}/fine")["n"] == 1
    assert quality.write_observed(df.limit(0), f"{tmp_path}/none", ("code", "absent"))["n"] == 0


def test_details_round_halves_away_from_zero(spark):
    """Also a half that a sum in another order misses by its last bit."""
    row = "'s' AS sector, 'm' AS market, 1e6D AS net_assets, 50D AS equity_ratio, 1e6D AS sales, 1e6D AS operating_cf, 1e9D AS trading_value, 1L AS volume, date'2001-11-30' AS entry_date"
    cases = {"1": (112.5, "113"), "2": (113.5, "114"), "3": (112.49999999999999, "113"), "4": (112.4, "112"), "5": (1012.5, "1,013")}
    df = spark.createDataFrame([(c, p) for c, (p, _) in cases.items()], "code string, price double").selectExpr("*", *row.split(", "))
    got = {r["code"]: r["filter_detail"] for r in prefilter(df, config=ScreenConfig(min_trading_value=0.0, min_price=1100.0)).collect()}
    assert got == {c: f"株価基準未満 ({t}円 < 1,100円)" for c, (_, t) in cases.items()}


def test_market_value_of_a_price_off_by_its_last_bit(spark):
    """20,368,700 as 8,000 shares of a mean price, whose sum may end a bit lower; real fractions are still cut."""
    values = {"1": 20368700.0, "2": 20368699.999999996, "3": 20368699.75, "4": 362909799.9375}
    nothing = "price eps bps dps shares_outstanding per pbr dividend_yield roe".split()
    columns = [f"cast(null AS double) AS {c}" for c in nothing] + ["'n' AS name", "'s' AS sector", "'m' AS market", "'Grade B' AS verdict", "60D AS quant_score", "date'2001-11-02' AS entry_date"]
    df = spark.createDataFrame(list(values.items()), "code string, market_cap double").selectExpr("*", *columns)
    got = {r["Code"]: r["Market_Cap"] for r in report.report_rows(df, now="x").collect()}
    assert got == {"1": "20368700", "2": "20368700", "3": "20368699", "4": "362909799"}
