"""The flagship plan: bars, master and fundamentals to scored, graded and rejected securities, as one lazy graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import ScreenConfig
from ..operators import fundamentals as fun
from ..operators import scoring, tables
from ..operators import technicals as tech
from ..operators.liquidity import liquidity
from ..operators.prefilter import prefilter


def candidates(bars: DataFrame, stocks: DataFrame, fundamentals: DataFrame, splits: DataFrame) -> DataFrame:
    """One row a security: its latest indicators, master data and repaired fundamentals. The history is reduced to one
    row a code before any join."""
    newest = tech.latest(tech.indicators(tech.clean_prices(bars)))
    joined = tables.join_fundamentals(tables.join_master(stocks, newest), fun.split_adjust(fundamentals, splits))
    return fun.repair(joined)


def screen(bars: DataFrame, stocks: DataFrame, fundamentals: DataFrame, splits: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Every security with filter_reason and filter_detail, and for those that pass with quant_score and verdict.

    The bars are read three times: for indicators, for the market's days, and for liquidity over the newest of those. Where
    they are made by a costly plan rather than stored, store them first."""
    from pyspark.sql import functions as F

    bars = bars.select("code", "entry_date", "price", "volume", "trading_value")
    judged = prefilter(candidates(bars, stocks, fundamentals, splits), liquidity(bars), config)
    scored = scoring.score(judged, config)
    passed = F.col("filter_reason").isNull()
    return scored.withColumns({"quant_score": F.when(passed, F.col("quant_score")), "verdict": F.when(passed, F.col("verdict"))})
