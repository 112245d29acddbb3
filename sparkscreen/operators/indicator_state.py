"""Indicators over a daily append: a state a code that new bars continue, so that a day costs its own bars.

A state holds what the recursive averages were last, how many bars a code has had, and its last TAIL dates and prices,
which the rolling means need. New bars are put behind those; the last of them is given the averages' values in place of its
own sources, so the same prefix sums as over a whole history go on from there.

Bars that a state has seen may come again. If one of them has another price, or is older than the tail and so can't be
told, that code alone is computed anew from its history.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import technicals as tech

TAIL = 75
#: The averages that go on: the state's name, and alpha.
AVERAGES = {"g": tech.WILDER, "l": tech.WILDER, "e12": tech.FAST, "e26": tech.SLOW}
_BAR = "struct<entry_date:date,price:double>"
SCHEMA = f"code string, n long, last_date date, tail array<{_BAR}>, " + ", ".join(f"{c} double" for c in (*AVERAGES, "signal"))


@dataclass(frozen=True)
class Advanced:
    """rows: indicators of the new bars, and of all bars of codes that were computed anew; state: of all codes, after them;
    renewed: the codes that were computed anew, if some may be."""

    rows: DataFrame
    state: DataFrame
    renewed: DataFrame | None = None


def _averaged(df: DataFrame) -> DataFrame:
    """df: bars with the columns of a state, null but for a code's first row where it goes on. Adds n_bars, the averages
    (y_*), macd, macd_signal, and whether a row is its code's last (_last) or among its last TAIL (_late).

    What goes by date is asked for at once, so one window gives it."""
    by_date, first = tech.by_code(), tech.by_code().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({
        "_move": F.coalesce(F.col("price") - F.lag("price").over(by_date), F.lit(0.0)), "_i": F.row_number().over(by_date) - 1, "_n": F.first("n").over(first),
        "_last": F.lead(F.lit(1), 1).over(by_date).isNull(), "_late": F.lead(F.lit(1), TAIL).over(by_date).isNull(),
    })
    source = {"g": F.greatest("_move", F.lit(0.0)), "l": F.greatest(-F.col("_move"), F.lit(0.0)), "e12": F.col("price"), "e26": F.col("price")}
    begun = {c: F.coalesce(F.col(c), v) for c, v in source.items()} | {"e9": F.coalesce(tech.plain_of("e12", "e26", "signal"), F.col("price"))}
    df = tech.numbered(df.withColumns({f"_x_{c}": v for c, v in begun.items()}))
    df = tech.ewms(df, {f"y_{c}": (f"_x_{c}", a) for c, a in (AVERAGES | {"e9": tech.SIGNAL}).items()})
    df = df.withColumns({"macd": F.col("y_e12") - F.col("y_e26"), "macd_signal": tech.signal_of("y_e12", "y_e26", "y_e9")})
    df = df.withColumn("n_bars", F.col("_i") + F.coalesce("_n", F.lit(1)))  # the row that goes on is the n-th
    return df.drop("_move", "_i", "_b", "_p", "_n", "y_e9", *[f"_x_{c}" for c in begun])


def _finished(df: DataFrame, stable: int) -> DataFrame:
    """Indicators out of the averages."""
    index = F.when(F.col("y_l") == 0, F.when(F.col("y_g") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide("y_g", "y_l")))
    h = F.col("macd") - F.col("macd_signal")
    df = df.withColumns({"rsi_14": F.when(F.col("n_bars") >= stable, index), "macd_hist": F.when(F.abs(h) < 1e-9 * F.col("price"), 0.0).otherwise(h)})
    df = df.withColumn("macd_status", F.when(F.col("macd_hist") > 0, "Bullish").when(F.col("macd_hist") < 0, "Bearish").otherwise("Neutral"))
    return tech.weekday_guard(tech.add_trend(df)).drop("n_bars", *[f"y_{c}" for c in AVERAGES])


def _fresh(bars: DataFrame) -> DataFrame:
    """Bars with the columns of a state, all null."""
    kinds = {"n": "long", "g": "double", "l": "double", "e12": "double", "e26": "double", "signal": "double", "tail": f"array<{_BAR}>"}
    return bars.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items()})


def _state_of(averaged: DataFrame) -> DataFrame:
    """The state after rows of averaged bars: of each code the last one, and the last TAIL dates and prices. A row that goes
    on brings the tail up to it."""
    last = averaged.filter(F.col("_late") | F.col("tail").isNotNull())
    at_end = lambda c: F.max(F.when(F.col("_last"), F.col(c)))
    own = F.sort_array(F.collect_list(F.when(F.col("tail").isNull(), F.struct("entry_date", "price"))))  # at most TAIL rows a code
    out = last.groupBy("code").agg(
        at_end("n_bars").alias("n"), F.max("entry_date").alias("last_date"), F.first("tail", ignorenulls=True).alias("_before"), own.alias("_own"), *[at_end(f"y_{c}").alias(c) for c in AVERAGES], at_end("macd_signal").alias("signal")
    )
    both = F.when(F.col("_before").isNull(), F.col("_own")).otherwise(F.concat("_before", "_own"))
    tail = F.slice(both, F.greatest(F.size(both) - TAIL, F.lit(0)) + 1, TAIL)
    return out.select("code", "n", "last_date", tail.alias("tail"), *AVERAGES, "signal")


def _whole(bars: DataFrame) -> DataFrame:
    return _averaged(_fresh(tech.add_bands(tech.priced(bars))))


def _rows_of(averaged: DataFrame, stable: int) -> DataFrame:
    return _finished(averaged.drop("n", *AVERAGES, "signal", "tail", "_last", "_late"), stable)


def whole_run(bars: DataFrame, stable: int = tech.STABLE) -> Advanced:
    """All of a history: bars (code, entry_date, price, volume, ...), of which those without a price don't count."""
    averaged = _whole(bars)
    return Advanced(_rows_of(averaged, stable), _state_of(averaged))


def _stale(state: DataFrame, new: DataFrame) -> DataFrame:
    """Codes of which a bar that the state has seen, or may have seen, comes with another price."""
    met = new.select("code", "entry_date", F.when(F.col("price") > 0, F.col("price")).alias("price")).join(state.select("code", "last_date", "tail"), "code").filter("entry_date <= last_date")
    known = F.get(F.filter("tail", lambda x: x["entry_date"] == F.col("entry_date")), F.lit(0))["price"]
    unseen = (F.size("tail") >= TAIL) & (F.col("entry_date") < F.get("tail", F.lit(0))["entry_date"])
    return met.filter(unseen | ~F.col("price").eqNullSafe(known)).select("code").distinct()


def advance(state: DataFrame, new: DataFrame, history: DataFrame | Callable[[DataFrame], DataFrame], stable: int = tech.STABLE, keep: Callable[[DataFrame, str], DataFrame] = lambda df, what: df) -> Advanced:
    """New bars after a state. history: all bars with the new ones; only codes that are computed anew are read from it; or a function
    that makes their history, given a frame of their codes.

    A code without a state starts with its new bars; one without new bars keeps its state; new bars without a price don't
    count; an empty table of new bars gives no rows and the same state. keep stores what both results read, so that it is
    computed once, and so that joins see how few codes are computed anew; without it all is lazy."""
    stale = keep(_stale(state, new), "stale")
    again = keep(_whole(history(stale) if callable(history) else history.join(stale, "code", "left_semi")), "renewed")

    ahead = tech.priced(new).join(stale, "code", "left_anti").join(state.select("code", "last_date"), "code", "left")
    ahead = keep(ahead.filter(F.col("last_date").isNull() | (F.col("entry_date") > F.col("last_date"))).drop("last_date"), "ahead")
    met = ahead.select("code").distinct()
    at_end = lambda c: F.when(F.col("bar.entry_date") == F.col("last_date"), F.col(c)).alias(c)
    seeds = state.join(met, "code", "left_semi").select("*", F.explode("tail").alias("bar")).select(
        "code", F.col("bar.entry_date").alias("entry_date"), F.col("bar.price").alias("price"), *[at_end(c) for c in ("n", *AVERAGES, "signal", "tail")], F.lit(True).alias("_held")
    )
    rows = tech.add_bands(seeds.unionByName(_fresh(ahead).withColumn("_held", F.lit(False)), allowMissingColumns=True))
    going_on = keep(_averaged(rows.filter(~F.col("_held") | F.col("n").isNotNull())), "going-on")
    found = _rows_of(going_on.filter(~F.col("_held")).drop("_held"), stable)

    kept = state.join(met.unionByName(stale), "code", "left_anti")
    states = kept.unionByName(_state_of(going_on)).unionByName(_state_of(again))
    return Advanced(found.unionByName(_rows_of(again, stable), allowMissingColumns=True), states, stale)
