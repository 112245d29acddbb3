"""Scores of 0 to 100 from piecewise-linear rules, and grades under caps: one projection, no user functions.

The breakpoints are tables of (condition, value) texts over {x}, so that a rule reads as it is defined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CATEGORIES, MOST_POINTS, PRESETS, ScreenConfig
from ..functions.exprs import NUDGE, cases

ROE = [("{x} IS NULL OR {x} <= 0", "0.0"), ("{x} < 5", "{x}"), ("{x} < 10", "5 + (({x}) - 5) * 2.0"), ("{x} < 25", "15 + (({x}) - 10) * 1.0")]
PBR = [("{x} IS NULL OR {x} <= 0", "0.0"), ("{x} <= 0.6", "13.0"), ("{x} <= 1", "10 + (1 - {x}) * 7.5"), ("{x} <= 2", "4 + (2 - {x}) * 6"), ("{x} <= 4", "greatest(0.0, 4 - ({x} - 2) * 2)")]
PER = [
    ("{x} IS NULL OR {x} <= 0", "0.0"),
    ("{x} < 4 AND coalesce(operating_margin <= 0, false)", "0.0"),
    ("{x} < 4 AND coalesce(net_profit > 0 AND (operating_income <= 0 OR operating_income < 0.5 * net_profit), false)", "0.0"),
    ("{x} < 3", "2.0"), ("{x} <= 6", "12.0"), ("{x} <= 10", "8 + (10 - {x})"), ("{x} <= 15", "4 + (15 - {x}) * 0.8"),
    ("{x} <= 25", "greatest(0.0, 4 - ({x} - 15) * 0.4)"), ("{x} > 40", "-least(3.0, ({x} - 40) * 0.1)"),
]
EQUITY = [("{x} IS NULL OR {x} <= 0", "0.0"), ("{x} >= 80", "15.0"), ("{x} >= 50", "8 + ({x} - 50) * 7 / 30"), ("{x} >= 25", "2 + ({x} - 25) * 0.24")]
DIVIDEND = [("{x} IS NULL", "0.0"), ("{x} >= 5", "10.0"), ("{x} >= 3", "5 + ({x} - 3) * 2.5"), ("{x} >= 1.5", "1 + ({x} - 1.5) * 4 / 1.5")]
MACD = [
    ("macd_status LIKE '%Bullish%'", "6 + greatest(0.0, least(2.0, coalesce({x}, 0.0)))"),
    ("macd_status LIKE '%Bearish%'", "greatest(0.0, 2 + least(0.0, coalesce({x}, 0.0) * 0.5))"),
]
RSI = [("{x} IS NULL", "0.0"), ("{x} <= 25", "7.0"), ("{x} <= 35", "5.5 + (35 - {x}) * 0.15"), ("{x} <= 50", "4 + (50 - {x}) * 0.1"), ("{x} <= 65", "2.5 + (65 - {x}) * 0.1"), ("{x} <= 75", "(75 - {x}) * 0.25")]
DIVERGENCE = [
    ("{x} IS NULL", "0.0"), ("{x} < -25", "-least(3.0, (-25 - {x}) * 0.2)"), ("{x} < -15", "5 - (-15 - {x}) * 0.5"), ("{x} <= -5", "3 + (-5 - {x}) * 0.2"), ("{x} <= 5", "3.0"),
    ("{x} <= 15", "3 - ({x} - 5) * 0.1"), ("{x} <= 25", "2 - ({x} - 15) * 0.2"),
]

#: Score column -> text over the columns of a candidate.
PARTS = {
    "score_roe": cases("roe", ROE, "30.0"),
    "score_pbr": cases("pbr", PBR, "0.0"),
    "score_per": cases("per", PER, "0.0"),
    "score_equity": cases("equity_ratio", EQUITY, "{x} * 0.08"),
    "score_dividend": cases("dividend_yield", DIVIDEND, "0.0"),
    "score_macd": cases("macd_hist", MACD, "3.0"),
    "score_rsi": cases("rsi_14", RSI, "greatest(-3.0, -({x} - 75) * 0.2)"),
    "score_divergence": cases("ma_divergence", DIVERGENCE, "-least(4.0, ({x} - 25) * 0.4)"),
}
SUMS = {"profit": "score_roe", "value": "score_pbr + score_per", "safety": "score_equity", "dividend": "score_dividend", "technical": "score_macd + score_rsi + score_divergence"}
DEAD = "coalesce(abs(rsi_14 - 50) < 0.001 AND abs(ma_divergence) < 0.001, false)"
GRADES = ("Grade C", "Grade B", "Grade A", "Grade S")
LEGACY = ("PASS", "WATCH", "BUY", "STRONG_BUY")


def raw_score(weights: tuple[float, ...]) -> str:
    """All weights 1 or none above 0: the plain sum; else the weighted share of the weighted most."""
    plain = " + ".join(f"({SUMS[k]})" for k in CATEGORIES)
    most = sum(w * m for w, m in zip(weights, MOST_POINTS, strict=True))
    if all(w == 1 for w in weights) or most <= 0:
        return plain
    return "(" + " + ".join(f"({SUMS[k]}) * {w}" for k, w in zip(CATEGORIES, weights, strict=True)) + f") / {most} * 100"


def total(weights: tuple[float, ...]) -> str:
    return f"CASE WHEN {DEAD} THEN 45.0 ELSE round(least(98.0, greatest(15.0, {raw_score(weights)})) + {NUDGE:.8f}, 1) END"


def level(score: str = "quant_score") -> str:
    """0 to 3: by score, then under the caps."""
    base = f"CASE WHEN {score} >= 80 THEN 3 WHEN {score} >= 65 THEN 2 WHEN {score} >= 50 THEN 1 ELSE 0 END"
    caps = [("coalesce(roe < 0, false)", 1), ("coalesce(operating_margin <= 0, false) OR coalesce(operating_income <= 0, false)", 1), ("coalesce(macd_status LIKE '%Bearish%', false)", 2), ("coalesce(macd_status LIKE '%Bearish%' AND ma_divergence < -10, false)", 1)]
    return f"least({base}, " + ", ".join(f"CASE WHEN {c} THEN {n} ELSE 3 END" for c, n in caps) + ")"


def verdict(mode: str = "grade", score: str = "quant_score") -> str:
    names = GRADES if mode == "grade" else LEGACY
    return f"CASE WHEN {DEAD} THEN 'PASS' ELSE CASE {level(score)} WHEN 0 THEN '{names[0]}' WHEN 1 THEN '{names[1]}' WHEN 2 THEN '{names[2]}' ELSE '{names[3]}' END END"


def fill_inputs(df: DataFrame) -> DataFrame:
    """A blank status follows the histogram's sign; the divergence may come under its other name; absent ones are null."""
    columns = ("roe", "pbr", "per", "equity_ratio", "dividend_yield", "operating_margin", "operating_income", "net_profit", "macd_hist", "rsi_14")
    df = df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})
    other = [F.col(c) for c in ("ma_divergence", "ma25_divergence") if c in df.columns]
    given = F.col("macd_status") if "macd_status" in df.columns else F.lit(None).cast("string")
    blank = given.isNull() | F.trim(given).isin("", "None", "nan")
    sign = F.when(F.col("macd_hist") > 0, "Bullish").when(F.col("macd_hist") < 0, "Bearish").when(F.col("macd_hist") == 0, "Neutral")
    return df.withColumns({"macd_status": F.when(blank, sign).otherwise(given), "ma_divergence": F.coalesce(*other) if other else F.lit(None).cast("double")})


def add_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(f"CAST({v} AS DOUBLE)") for k, v in PARTS.items()})


def score(df: DataFrame, config: ScreenConfig = ScreenConfig()) -> DataFrame:
    """df with the parts, quant_score and verdict."""
    df = add_parts(fill_inputs(df)).withColumn("quant_score", F.expr(f"CAST({total(config.weights())} AS DOUBLE)"))
    return df.withColumn("verdict", F.expr(verdict(config.verdict_mode)))


def score_by_preset(df: DataFrame) -> DataFrame:
    """One row for each preset: the presets are an array of the row, so nothing is joined."""
    scored = add_parts(fill_inputs(df))
    each = F.array(*[F.struct(F.lit(k).alias("preset"), F.expr(f"CAST({total(w)} AS DOUBLE)").alias("quant_score")) for k, w in PRESETS.items()])
    rows = scored.withColumn("_p", F.explode(each)).select("*", "_p.*").drop("_p")
    return rows.withColumn("verdict", F.expr(verdict()))

