"""Rejection of codes with the first reason that holds, as one conditional expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CASH_EXEMPT_SECTORS, ScreenConfig
from ..functions.exprs import rounded

LIQUIDITY = ("avg_trading_value_20d", "zero_volume_days_5d", "latest_trade_date", "is_recent_trade")


def attach_liquidity(df: DataFrame, liquidity: DataFrame | None) -> DataFrame:
    """Liquidity columns from the aggregate; without one, from the latest bar itself."""
    df = df.drop(*LIQUIDITY)
    if liquidity is not None:
        return df.join(liquidity.select("code", *LIQUIDITY), "code", "left")
    own = F.when(F.col("trading_value") > 0, F.col("trading_value")).otherwise(F.col("volume") * F.col("price"))
    return df.select("*", own.alias("avg_trading_value_20d"), F.lit(0).cast("long").alias("zero_volume_days_5d"), F.col("entry_date").cast("string").alias("latest_trade_date"), F.lit(True).alias("is_recent_trade"))


def _number(c: Column) -> Column:
    """Whole numbers with thousands separators; halves go away from zero, as everywhere."""
    return F.format_number(rounded(c, 0), 0)


def _percent(c: Column) -> Column:
    return F.format_string("%.1f", rounded(c, 1))


def rejection(config: ScreenConfig, columns: list[str]) -> Column:
    """struct(reason, detail), null for a code that passes. The texts are fixed values, the users' contract."""
    c = lambda name: F.col(name) if name in columns else F.lit(None)
    out = lambda reason, detail: F.struct(F.lit(reason).alias("reason"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))
    stale, illiquid, broke = "データ鮮度不足 (取引停止)", "極小流動性トラップ", "構造的破綻 (債務超過)"
    margin = F.col("operating_cf") / F.when(F.col("sales") > 0, F.col("sales"))
    tv, least = F.col("avg_trading_value_20d"), config.min_trading_value
    rules = [
        (c("status").cast("string") == "delisted", out("上場廃止", "JPX 上場銘柄一覧に掲載がありません (上場廃止・整理等)")),
        (F.col("price").isNull() & F.coalesce(c("exclusion_reason").cast("string").startswith("市場データ提供なし"), F.lit(False)), out("市場データ取得不能", "Yahoo Finance に株価データが提供されていません (PRO Market 等。30日ごとに再確認)")),
        (F.col("price").isNull(), out("市場データ取得不能", "市場価格データ欠損 (OHLCV未取得)")),
        (F.col("latest_trade_date").isNull(), out(stale, "最終取引日データ欠損")),
        (~F.col("is_recent_trade"), out(stale, F.concat(F.lit("最終取引日 ("), "latest_trade_date", F.lit(") が直近5営業日範囲外")))),
        (F.col("zero_volume_days_5d").isNull(), out("商い不成立", "出来高時系列データ欠損")),
        (F.col("zero_volume_days_5d") > 0, out("商い不成立", F.concat(F.lit("直近5営業日以内に出来高ゼロ日あり ("), F.col("zero_volume_days_5d").cast("string"), F.lit("日)")))),
        (tv.isNull(), out(illiquid, "売買代金データ欠損/算出不能")),
        (tv < least, out(illiquid, F.concat(F.lit("20日平均売買代金不足 ("), _number(tv / 10_000.0), F.lit("万円 < "), _number(F.lit(least / 10_000.0)), F.lit("万円)")))),
        (F.col("price") < config.min_price, out("超低位ボロ株", F.concat(F.lit("株価基準未満 ("), _number(F.col("price")), F.lit("円 < "), _number(F.lit(config.min_price)), F.lit("円)")))),
        (F.col("net_assets") <= 0, out(broke, F.concat(F.lit("純資産マイナス ("), _number(F.col("net_assets")), F.lit("円)")))),
        (F.col("equity_ratio") <= config.min_equity_ratio, out(broke, F.concat(F.lit("自己資本比率マイナス/ゼロ ("), _percent(F.col("equity_ratio")), F.lit(f"% <= {config.min_equity_ratio:.1f}%)")))),
        (F.col("equity_ratio").isNull(), out("重要指標未開示/算出不能", "自己資本比率等の財務諸表データ未開示または欠損")),
        (~F.coalesce(F.col("sector").isin(*CASH_EXEMPT_SECTORS), F.lit(False)) & (margin < config.min_cash_margin), out("致命的キャッシュ枯渇", F.concat(F.lit("営業CFマージン大幅赤字 ("), _percent(margin * 100), F.lit(f"% < {config.min_cash_margin * 100:.1f}%)")))),
    ]
    if config.target_markets is not None:
        market = F.coalesce("market", F.lit("None"))
        rules.append((~market.isin(*config.target_markets), out("対象外市場", F.concat(F.lit(f"指定対象市場 ({list(config.target_markets)}) に含まれない市場 ("), market, F.lit(")")))))
    chain = F.when(*rules[0])
    for cond, value in rules[1:]:
        chain = chain.when(cond, value)
    return chain


def prefilter(df: DataFrame, liquidity: DataFrame | None = None, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """df with filter_reason and filter_detail; both are null for what passes."""
    df = attach_liquidity(df, liquidity)
    return df.withColumn("_out", rejection(config, df.columns)).withColumn("filter_reason", F.col("_out.reason")).withColumn("filter_detail", F.col("_out.detail")).drop("_out")
