"""The earlier, configured scorer: candidate filter, points by category, a normed score, ranks by sector.

A strategy is data. All points of a row are one projection; the only shuffle is the rank within a sector.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import numbered

#: Metrics whose points grow linearly from the first value to the second.
LINEAR = {"roe": (5.0, 15.0), "per": (15.0, 10.0), "payout_ratio": (30.0, 100.0), "dividend_yield": (2.0, 4.0), "sales_growth": (5.0, 20.0), "profit_growth": (5.0, 30.0)}
#: The most that indicators can give, and prefixes of columns that a result doesn't show.
MOST_TREND, PURGED = 45.0, ("score_", "fund_norm", "trend_norm", "raw_with_noise", "cnt", "raw_score")
CONTRACT = ("code", "entry_date", "quant_score", "strategy_name", "rank")


@dataclass(frozen=True)
class Strategy:
    name: str = "balanced"
    base_score: float = 50.0
    points: dict = field(default_factory=dict)  # metric -> points
    thresholds: dict = field(default_factory=dict)  # metric -> threshold; a metric without one gives no points
    categories: dict = field(default_factory=dict)  # metric -> base, value, growth, quality, trend or final_adjustment (else quality)
    lower_is_better: frozenset = frozenset()
    directions: dict = field(default_factory=dict)  # metric -> lower or higher, before lower_is_better
    defaults: dict = field(default_factory=dict)  # thresholds of all strategies: metric -> threshold, or group -> {metric: threshold}
    status_bonuses: dict = field(default_factory=dict)  # column -> {value: points}
    fund_weight: float = 0.7
    trend_weight: float = 0.3

    def most_fund(self) -> float:
        bonuses = sum(max(map(float, b.values()), default=0.0) for b in self.status_bonuses.values())
        return self.base_score + sum(float(p) for p in self.points.values() if p > 0) + bonuses

    def lower(self, metric: str) -> bool:
        told = self.directions.get(metric)
        return told == "lower" if told in ("lower", "higher") else metric in self.lower_is_better or metric.endswith("_max")

    def threshold(self, metric: str) -> float | None:
        """The strategy's own, else that of all strategies, else the first group's that has one."""
        groups = [g for g in self.defaults.values() if isinstance(g, dict)]
        for table in (self.thresholds, {k: v for k, v in self.defaults.items() if not isinstance(v, dict)}, *groups):
            if metric in table:
                return float(table[metric])
        return None


#: An example over the columns of a candidate.
STRATEGY = Strategy(
    points={"roe": 10, "per": 8, "pbr": 6, "equity_ratio": 8, "dividend_yield": 10, "payout_ratio": 4, "debt_equity_ratio": -5},
    thresholds={"roe": 8, "per": 15, "pbr": 1, "equity_ratio": 40, "dividend_yield": 3, "payout_ratio": 30, "debt_equity_ratio": 150},
    categories={"roe": "quality", "per": "value", "pbr": "value", "dividend_yield": "value", "equity_ratio": "quality", "payout_ratio": "growth"},
    lower_is_better=frozenset({"per", "pbr"}),
    status_bonuses={"turnaround_status": {"turnaround_black": 6, "turnaround_white": -8}},
)


def filter_candidates(df: DataFrame, min_price: float = 50, min_volume: float = 1000, min_equity: float = 10, n: int | None = None) -> DataFrame:
    """At least the minima, or unknown, where the column is there; by quant_score if there is one, the best first, unknown
    ones last, then by code. n of 0 or less is no limit."""
    for c, least in (("price", min_price), ("volume", min_volume), ("equity_ratio", min_equity)):
        if c in df.columns:
            df = df.filter(F.col(c).isNull() | (F.col(c) >= least))
    if "quant_score" in df.columns:
        df = df.orderBy(F.desc_nulls_last("quant_score"), "code")
    return df if n is None or n <= 0 else df.limit(n)


def _clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def as_numbers(df: DataFrame, strategy: Strategy) -> DataFrame:
    """What is counted as doubles, texts without % and commas; what is missing or no number is 0."""
    targets = {*strategy.points, "macd_hist", "rsi_14", "market_cap", "payout_ratio"}
    value = lambda c, kind: F.regexp_replace(c, "[%,]", "").try_cast("double") if kind == "string" else F.col(c).cast("double")
    return df.withColumns({c: F.coalesce(value(c, kind), F.lit(0.0)) for c, kind in df.dtypes if c in targets})


def metric_points(strategy: Strategy, metric: str, has_payout: bool) -> Column:
    """All points beyond the threshold, or linear ones; a dividend counts beyond its threshold only, and half if all that is
    earned, or more, is paid out."""
    x, most = F.col(metric), float(strategy.points[metric])
    beyond = x <= strategy.threshold(metric) if strategy.lower(metric) else x >= strategy.threshold(metric)
    if metric in LINEAR:
        low, target = LINEAR[metric]
        got = _clip((x - low) / (target - low), 0.0, 1.0) * most
    else:
        got = F.when(beyond, most).otherwise(0.0)
    if metric == "dividend_yield" and has_payout:
        return F.when(beyond & (F.col("payout_ratio") < 100), got).when(beyond, got * 0.5).otherwise(0.0)
    return got


def legacy_score(df: DataFrame, strategy: Strategy | None = STRATEGY) -> DataFrame:
    """df with quant_score (0 to 100), quant_score_normalized (before rounding and cap), rank within the sector (the mean of
    tied ranks) and strategy_name. Columns of intermediate sums don't show. Without a strategy the score is 0.

    Points go to their metric's category: base, value, growth and quality make the fundamental part, trend the part of
    indicators, final_adjustment what is added in the end. A category of another name (a penalty, which no sum takes) doesn't
    count. Scores are set apart for ranking by a hash of the code, of less than a thousandth."""
    if strategy is None:
        return df.withColumns({"quant_score": F.lit(0.0), "strategy_name": F.lit("")})
    d = as_numbers(df, strategy)
    sums: dict[str, list[Column]] = {"base": [], "value": [], "growth": [], "quality": [], "trend": [F.lit(50.0)], "final_adjustment": []}
    for metric in strategy.points:
        cat = strategy.categories.get(metric, "quality")
        if metric in d.columns and strategy.threshold(metric) is not None and cat in sums:
            sums[cat].append(metric_points(strategy, metric, "payout_ratio" in d.columns))
    trend, bonuses = sums["trend"], sums["final_adjustment"]
    if "macd_hist" in d.columns:
        m = F.col("macd_hist")
        trend.append(F.when(m > 0, 5 + _clip(m * 2, 0.0, 5.0)).when(m < 0, -5 + _clip(m * 2, -5.0, 0.0)).otherwise(0.0))
    if "rsi_14" in d.columns:
        trend.append(_clip((50 - F.col("rsi_14")) * 0.5, -15.0, 15.0))
    for c, values in strategy.status_bonuses.items():
        for v, points in values.items() if c in d.columns else ():
            hit = F.coalesce(F.col(c).cast("string").isin(str(v), str(v).replace(".0", "")), F.lit(False))
            bonuses.append(F.when(hit, float(points)).otherwise(0.0))
            if points > 0:
                sums["growth"].append(bonuses[-1])
    add = lambda parts: sum(parts, F.lit(0.0))
    fund = add([F.lit(strategy.base_score), *sums["base"], *sums["value"], *sums["growth"], *sums["quality"]])
    d = d.withColumns({"_own_fund": _clip(fund / max(strategy.most_fund(), 1.0) * 100, 0.0, 100.0), "_own_trend": _clip(add(trend) / MOST_TREND * 100, 0.0, 100.0), "_own_bonus": add(bonuses)})
    size = F.when(F.col("market_cap") >= 100, 1.0).when(F.col("market_cap") >= 30, 0.8).otherwise(0.5) if "market_cap" in d.columns else F.lit(1.0)
    d = d.withColumn("_own_raw", (F.col("_own_fund") * strategy.fund_weight + F.col("_own_trend") * strategy.trend_weight + F.col("_own_bonus")) * size)
    d = d.withColumn("quant_score_normalized", _clip(F.col("_own_raw"), 0.0, 100.0))
    d = d.withColumn("_own_noisy", F.round(F.col("quant_score_normalized") + F.ascii(F.substring(F.md5(F.col("code").cast("string")), 1, 1)) % 10 * 1e-4, 9))
    by_sector = Window.partitionBy("sector").orderBy(F.desc("_own_noisy"))
    tied = F.count("*").over(Window.partitionBy("sector", "_own_noisy"))
    score = F.round(F.col("quant_score_normalized") + 1e-9, 2)
    if "rsi_14" in d.columns:
        score = F.when(F.abs(F.col("rsi_14") - 50) < 0.1, _clip(score, 0.0, 50.0)).otherwise(score)
    d = d.withColumns({"rank": F.rank().over(by_sector) + (tied - 1) / 2, "quant_score": score, "strategy_name": F.lit(strategy.name)})
    return d.select(*[c for c in d.columns if not c.startswith("_own_") and (c in CONTRACT or not c.startswith(PURGED))])


def legacy_rank(df: DataFrame, bounds: dict[str, tuple[str, float]], by: str) -> DataFrame:
    """bounds: column -> (min or max, value); rows without a value fail. Best first, ranked over ranges of the order."""
    for c, (side, v) in bounds.items():
        df = df.filter(F.col(c) >= v if side == "min" else F.col(c) <= v)
    return numbered(df, F.desc(by), F.col("code"))


def filter_and_rank(df: DataFrame, strategy: Strategy, bypass: bool = False) -> DataFrame:
    """Rows beyond all thresholds of the strategy, each in its metric's direction, the best score first."""
    for metric, v in strategy.thresholds.items() if not bypass else ():
        if metric in df.columns:
            df = df.filter(F.col(metric) <= v if strategy.lower(metric) else F.col(metric) >= v)
    return df.orderBy(F.desc("quant_score"), "code")


def dividend_quality(df: DataFrame, full: float = 20.0, least_yield: float = 3.0) -> DataFrame:
    """Points for a yield of at least least_yield. Only points that were given are taken: all on negative operating cash
    flow, 20 beyond a payout of 100 %."""
    p = F.when(F.col("dividend_yield") >= least_yield, full).otherwise(0.0)
    p = F.when((F.col("operating_cf") < 0) & (p > 0), 0.0).otherwise(p)
    return df.withColumn("dividend_points", F.when((F.col("payout_ratio") > 100) & (p > 0), p - 20.0).otherwise(p))
