"""Indicators over price bars (code, entry_date, price, ...): windows by code in date order, JVM-side throughout.

All windows share the partitioning by code, so one exchange serves them; the recursive averages are prefix sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows after which a recursive average starts a new prefix sum, so that powers stay within a double at any length.
BLOCK = 1024


def by_code():
    return Window.partitionBy("code").orderBy("entry_date")


def normalize_bars(df: DataFrame) -> DataFrame:
    """Alias columns to the engine's names, dates from text or timestamps, volume to long with null as 0."""
    names = {"Close": "price", "Price": "price", "Open": "open", "High": "high", "Low": "low", "Volume": "volume", "Adj Close": "adj_close"}
    df = df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns and v not in df.columns})
    date = next((c for c in ("entry_date", "Date", "index") if c in df.columns), None)
    if date is None:
        raise ValueError("bars need a date column")
    df = df.withColumn("_d", F.try_to_date(F.substring(F.col(date).cast("string"), 1, 10))).drop(date).withColumnRenamed("_d", "entry_date")
    if "volume" in df.columns:
        df = df.withColumn("volume", F.coalesce(F.col("volume").try_cast("double").cast("long"), F.lit(0)))
    return df


#: The columns of an indicator table and their types.
SCHEMA = {
    "code": "string", "entry_date": "date", "price": "double", "open": "double", "high": "double", "low": "double", "volume": "bigint", "adj_close": "double",
    "volume_ratio": "double", "trading_value": "double", "macd": "double", "macd_signal": "double", "macd_hist": "double", "rsi_14": "double", "ma_divergence": "double",
    "volatility": "double", "ma25": "double", "ma75": "double", "bb_mid": "double", "bb_sigma": "double", "bb_p1sig": "double", "bb_p2sig": "double", "bb_m1sig": "double",
    "bb_m2sig": "double", "quant_score": "double", "trend_score": "int", "trend_signal": "int", "trend_up": "double", "macd_status": "string", "fetch_status": "string", "repair_metadata": "string",
}


def conform_schema(df: DataFrame) -> DataFrame:
    """The fixed schema: missing columns become typed nulls, others go."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()])


def _off_median(c: str, near: str) -> Column:
    """Whether c is off the median of near, an array of at least 5 values, by over 5 times. A median lies between the least and
    the largest value, so values are put in order only where c is so far off one of those."""
    lo, hi, n = F.array_min(near), F.array_max(near), F.size(near)
    may = (F.col(c) / lo > 5) | (F.col(c) / hi < 0.2) | F.isnan(hi)
    ordered = F.sort_array(near)
    ratio = F.col(c) / (0.5 * F.get(ordered, F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get(ordered, F.floor(n / 2).cast("int")))
    return F.when((n >= 5) & may, (ratio > 5) | (ratio < 0.2)).otherwise(F.lit(False))


def clean_prices(df: DataFrame) -> DataFrame:
    """Glitches become null: not positive; off the centred 31-row median by over 5 times; off the code's median by over
    20 times; then, on what is left, off the day before by over 5 times. Negative volume becomes 0."""
    df = df.withColumn("price", F.when(F.col("price") > 0, F.col("price")))
    if "volume" in df.columns:
        df = df.withColumn("volume", F.when(F.col("volume") < 0, F.lit(0).cast("long")).otherwise(F.col("volume")))
    df = df.withColumn("_near", F.collect_list("price").over(by_code().rowsBetween(-15, 15)))
    df = df.withColumn("_whole", F.col("price") / F.percentile("price", 0.5).over(Window.partitionBy("code")))
    far = _off_median("price", "_near") | (F.col("_whole") > 20) | (F.col("_whole") < 0.05)
    df = df.withColumn("price", F.when(F.coalesce(far, F.lit(False)), None).otherwise(F.col("price"))).drop("_near", "_whole")
    step = F.col("price") / F.lag("price").over(by_code())
    df = df.withColumn("_step", step)
    return df.withColumn("price", F.when(F.coalesce((F.col("_step") > 5) | (F.col("_step") < 0.2), F.lit(False)), None).otherwise(F.col("price"))).drop("_step")


def priced(df: DataFrame) -> DataFrame:
    return df.filter(F.col("price") > 0)


def rolling(c: str, n: int, f=F.avg) -> Column:
    """f over the last n rows, null until n values are there."""
    w = by_code().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, f(c).over(w))


def numbered(df: DataFrame) -> DataFrame:
    """Adds a code's row number _i, its block _b and its place there _p. Blocks are in date order, so every window after
    this one orders by block and date: one sort serves them all."""
    if "_b" in df.columns:
        return df
    if "_i" not in df.columns:
        df = df.withColumn("_i", F.row_number().over(by_code()) - 1)
    return df.withColumn("_b", F.floor(F.col("_i") / BLOCK)).withColumn("_p", F.pmod(F.col("_i"), F.lit(BLOCK)))


def _by_block():
    return Window.partitionBy("code").orderBy("_b", "entry_date")


def ewms(df: DataFrame, averages: dict[str, tuple[str, float]]) -> DataFrame:
    """averages: new column -> (source, alpha). y0 = x0, y = (1 - alpha) y + alpha x, by code in date order; sources have no
    nulls. df is numbered.

    Within blocks of BLOCK rows as (1-a)^p * sum of w x (1-a)^-p; the block before enters with its last value, which
    holds what is older to less than a double's last place. All averages of a call share two windows."""
    in_block = Window.partitionBy("code", "_b").orderBy("entry_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = _by_block().rowsBetween(Window.unboundedPreceding, -1)
    power = lambda a, e: F.pow(F.lit(1.0 - a), e)
    weight = lambda a: F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(a))
    df = df.withColumns({f"_s_{y}": power(a, F.col("_p")) * F.sum(weight(a) * F.col(x) * power(a, -F.col("_p"))).over(in_block) for y, (x, a) in averages.items()})
    df = df.withColumns({f"_l_{y}": F.last(F.when(F.col("_p") == BLOCK - 1, F.col(f"_s_{y}")), ignorenulls=True).over(before) for y in averages})
    out = {y: F.col(f"_s_{y}") + F.coalesce(F.col(f"_l_{y}") * power(a, F.col("_p") + 1), F.lit(0.0)) for y, (_, a) in averages.items()}
    return df.withColumns(out).drop(*[f"_{k}_{y}" for k in "sl" for y in averages])


def ewm(df: DataFrame, source: str, target: str, alpha: float) -> DataFrame:
    """One recursive average."""
    return ewms(numbered(df), {target: (source, alpha)}).drop("_i", "_b", "_p")


def add_bands(df: DataFrame) -> DataFrame:
    df = df.select("*", rolling("price", 25).alias("ma25"), rolling("price", 75).alias("ma75"), rolling("price", 25, F.stddev_samp).alias("bb_sigma"))
    bands = {"bb_mid": 0, "bb_p1sig": 1, "bb_p2sig": 2, "bb_m1sig": -1, "bb_m2sig": -2}
    return df.withColumns({k: F.col("ma25") + n * F.col("bb_sigma") for k, n in bands.items()})


def _moves(df: DataFrame, stable: int) -> DataFrame:
    """Adds gains, losses, the number of the last stable rows, and a code's row number, all by one window."""
    move = F.coalesce(F.col("price") - F.lag("price").over(by_code()), F.lit(0.0))
    df = df.withColumns({"_move": move, "_n": F.count("price").over(by_code().rowsBetween(-(stable - 1), 0)), "_i": F.row_number().over(by_code()) - 1})
    return df.withColumns({"_gain": F.greatest("_move", F.lit(0.0)), "_loss": F.greatest(-F.col("_move"), F.lit(0.0))}).drop("_move")


def _rsi(df: DataFrame, stable: int) -> DataFrame:
    index = F.when(F.col("_l") == 0, F.when(F.col("_g") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide("_g", "_l")))
    return df.withColumn("rsi_14", F.when(F.col("_n") >= stable, index)).drop("_n", "_gain", "_loss", "_g", "_l")


WILDER, FAST, SLOW, STABLE = 1 / 14, 2 / 13, 2 / 27, 30
SIGNAL = 0.2
_GAINS = {"_g": ("_gain", WILDER), "_l": ("_loss", WILDER)}
_PRICES = {"_e12": ("price", FAST), "_e26": ("price", SLOW), "_e9": ("price", SIGNAL)}


def _smoothed(alpha: float) -> tuple[float, float]:
    """(k, m) of ewm(ewm(x, alpha), SIGNAL) = k * ewm(x, alpha) - m * ewm(x, SIGNAL): both sides obey the same recursion and
    begin with x0, so an average of an average needs no pass of its own."""
    a, b = 1.0 - alpha, 1.0 - SIGNAL
    return SIGNAL * a / (a - b), alpha * b / (a - b)


def signal_of(fast: str, slow: str, plain: str) -> Column:
    """The recursive average of fast - slow, of averages of the price by FAST, SLOW and SIGNAL."""
    (k, m), (l, n) = _smoothed(FAST), _smoothed(SLOW)  # noqa: E741
    return k * F.col(fast) - l * F.col(slow) - (m - n) * F.col(plain)


def plain_of(fast: str, slow: str, signal: str) -> Column:
    """The other way: the price's average by SIGNAL that belongs to a signal."""
    (k, m), (l, n) = _smoothed(FAST), _smoothed(SLOW)  # noqa: E741
    return (k * F.col(fast) - l * F.col(slow) - F.col(signal)) / (m - n)


def _macd(df: DataFrame) -> DataFrame:
    df = df.withColumns({"macd": F.col("_e12") - F.col("_e26"), "macd_signal": signal_of("_e12", "_e26", "_e9")})
    h = F.col("macd") - F.col("macd_signal")
    df = df.withColumn("macd_hist", F.when(F.abs(h) < 1e-9 * F.col("price"), 0.0).otherwise(h)).drop("_e12", "_e26", "_e9")
    return df.withColumn("macd_status", F.when(F.col("macd_hist") > 0, "Bullish").when(F.col("macd_hist") < 0, "Bearish").otherwise("Neutral"))


def add_rsi(df: DataFrame, stable: int = STABLE) -> DataFrame:
    """Wilder's index, null for a code's first rows; 50 without moves, 100 without losses."""
    return _rsi(ewms(numbered(_moves(df, stable)), _GAINS), stable).drop("_i", "_b", "_p")


def add_macd(df: DataFrame) -> DataFrame:
    """MACD 12/26/9; a histogram that is 0 but for rounding is Neutral."""
    return _macd(ewms(numbered(df), _PRICES)).drop("_i", "_b", "_p")


def add_rsi_and_macd(df: DataFrame, stable: int = STABLE) -> DataFrame:
    """Both, with the averages of prices and moves in one pass."""
    return _macd(_rsi(ewms(numbered(_moves(df, stable)), _GAINS | _PRICES), stable)).drop("_i", "_b", "_p")


def add_trend(df: DataFrame) -> DataFrame:
    """Divergence from ma25 in percent, a score of four conditions, and the traded value."""
    holds = [F.col("ma25") > F.col("ma75"), F.col("price") > F.col("ma25"), F.col("macd_hist") > 0, F.col("rsi_14") > 50]
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in holds), F.lit(0))
    df = df.withColumn("ma_divergence", (F.col("price") - F.col("ma25")) / F.col("ma25") * 100).withColumn("trend_score", score.cast("int"))
    df = df.withColumn("trend_signal", F.col("trend_score")).withColumn("trend_up", F.when(F.col("trend_score") >= 3, 1.0).otherwise(0.0))
    own = F.col("trading_value") if "trading_value" in df.columns else F.lit(None).cast("double")
    return df.withColumn("trading_value", F.coalesce(own, F.col("volume") * F.col("price")))


def indicators(bars: DataFrame) -> DataFrame:
    """All indicators of priced bars; Saturdays and Sundays go after they have counted."""
    return weekday_guard(add_trend(add_rsi_and_macd(add_bands(priced(bars)))))


def weekday_guard(df: DataFrame) -> DataFrame:
    return df.filter(F.col("entry_date").isNotNull() & (F.weekday("entry_date") < 5))


def purge_weekend(df: DataFrame) -> DataFrame:
    return df.filter(~F.dayofweek("entry_date").isin(1, 7))


def latest(df: DataFrame) -> DataFrame:
    """Each code's row of the newest date; of several one. Only rows of that date are put in order."""
    newest = df.withColumn("_r", F.max("entry_date").over(Window.partitionBy("code"))).filter(F.col("entry_date").eqNullSafe(F.col("_r")))
    return newest.withColumn("_r", F.row_number().over(by_code())).filter("_r = 1").drop("_r")


def simple_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """The index over plain means of the last n moves; 50 where it isn't defined."""
    df = df.withColumn("_move", F.col("price") - F.lag("price").over(by_code()))
    df = df.withColumn("_gain", F.greatest("_move", F.lit(0.0))).withColumn("_loss", F.greatest(-F.col("_move"), F.lit(0.0)))
    df = df.withColumn("_g", rolling("_gain", n)).withColumn("_l", rolling("_loss", n))
    index = F.when(F.col("_l") == 0, F.when(F.col("_g") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide("_g", "_l")))
    return df.withColumn("rsi_sma", F.coalesce(index, F.lit(50.0))).drop("_move", "_gain", "_loss", "_g", "_l")


def volume_ratio(df: DataFrame, n: int = 25) -> DataFrame:
    w = by_code().rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("volume").over(w) == n, F.avg("volume").over(w))
    return df.withColumn("volume_ratio", F.try_divide(F.col("volume").cast("double"), mean))


def historical_volatility(df: DataFrame, least: int = 20) -> DataFrame:
    """Per code the yearly volatility of log returns in percent, null for fewer than least rows."""
    moves = df.withColumn("_r", F.ln(F.col("price") / F.lag("price").over(by_code())))
    return moves.groupBy("code").agg(F.count("*").alias("n_rows"), F.when(F.count("*") >= least, F.stddev_samp("_r") * F.sqrt(F.lit(252.0)) * 100).alias("volatility"))


def summary(df: DataFrame, least: int = 30) -> DataFrame:
    """Per code of at least so many bars its latest values, in the simple form: RSI over plain means, volume ratio, yearly
    volatility, trend score, and bands, which are 0 where a code has too few bars for them.

    What goes by date comes before what goes by block, and the latest row is the last by number, so two sorts serve all."""
    d = volume_ratio(simple_rsi(add_bands(priced(df))))
    d = d.withColumns({"_at": F.row_number().over(by_code()), "_n": F.count("*").over(Window.partitionBy("code"))})
    d = add_macd(d.filter(F.col("_n") >= least)).filter(F.col("_at") == F.col("_n"))
    holds = [F.col("ma25") > F.col("ma75"), F.col("price") > F.col("ma25"), F.col("macd_hist") > 0, F.col("rsi_sma") > 50]
    score = sum((F.coalesce(c, F.lit(False)).cast("int") for c in holds), F.lit(0))
    d = d.withColumn("trend_score", score).join(historical_volatility(priced(df)).select("code", F.col("volatility").alias("real_volatility")), "code")
    bands = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bb_p1sig", "bb_p2sig", "bb_m1sig", "bb_m2sig")]
    ratio = F.when(F.col("price") != 0, (F.col("price") - F.col("ma25")) / F.col("ma25") * 100)
    return d.select("code", "entry_date", "macd_hist", F.col("rsi_sma").alias("rsi_14"), F.when(F.col("trend_score") >= 3, 1.0).otherwise(0.0).alias("trend_up"), "trend_score", ratio.alias("ma_divergence"), "volume_ratio", "real_volatility", *bands)
