"""Price limits, jumps that trading can't make, and stock splits."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import let
from ..sources.paths import stored

#: Fixed values: (price below, most change in a day).
PRICE_LIMITS = (
    (100, 30), (200, 50), (500, 80), (700, 100), (1_000, 150), (1_500, 300), (2_000, 400), (3_000, 500), (5_000, 700), (7_000, 1_000), (10_000, 1_500), (15_000, 3_000),
    (20_000, 4_000), (30_000, 5_000), (50_000, 7_000), (70_000, 10_000), (100_000, 15_000), (150_000, 30_000), (200_000, 40_000), (300_000, 50_000), (500_000, 70_000),
    (700_000, 100_000), (1_000_000, 150_000),
)
LIKELY, NEAR, GAP_DAYS, MATCH = 1.9, 0.05, 7, 0.12
BEFORE, AFTER, APART = 14, 5, 10
LOOK_BACK = 3  # rows before a row that its limit depends on


def by_code():
    return Window.partitionBy("code").orderBy("entry_date")


def price_limit_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {p} THEN {n}.0" for p, n in PRICE_LIMITS) + f" ELSE {x} * 0.3 END"


def price_limit(x: Column) -> Column:
    chain = F.when(x < PRICE_LIMITS[0][0], float(PRICE_LIMITS[0][1]))
    for p, n in PRICE_LIMITS[1:]:
        chain = chain.when(x < p, float(n))
    return chain.otherwise(x * 0.3)


def _hit(prev: Column, cur: Column) -> Column:
    """1 or -1 for a day that moved by at least 80 % of its limit, else 0."""
    big = (prev > 0) & (cur > 0) & (F.abs(cur - prev) >= 0.8 * price_limit(prev))
    return F.when(F.coalesce(big, F.lit(False)), F.when(cur > prev, 1).otherwise(-1)).otherwise(0)


def _beyond(p: Column) -> Column:
    """Whether a price (p0) is off the one before (p1) by more than the day's limit."""
    return (p["p1"] > 0) & (p["p0"] > 0) & (F.abs(p["p0"] - p["p1"]) > price_limit(p["p1"]))


def _widened(p: Column) -> Column:
    """Whether the two days before both hit their limits the same way."""
    one, two = _hit(p["p2"], p["p1"]), _hit(p["p3"], p["p2"])
    return (one != 0) & (one == two)


def impossible_jump(bars: DataFrame) -> DataFrame:
    """Adds prev_price, prev_date and impossible: a change beyond the day's limit, unless the two days before both hit
    their limits the same way, which widens it."""
    lag = lambda n: F.lag("price", n).over(by_code())
    d = bars.select("*", lag(1).alias("_p1"), lag(2).alias("_p2"), lag(3).alias("_p3"), F.lag("entry_date").over(by_code()).alias("prev_date"), F.row_number().over(by_code()).alias("_n"))
    # In a lambda, as the tables of limits written out in line make a method that the JVM no longer compiles.
    impossible = let(F.struct(F.col("price").alias("p0"), *[F.col(f"_p{n}").alias(f"p{n}") for n in (1, 2, 3)]), lambda p: _beyond(p) & ~((F.col("_n") > 3) & _widened(p)))
    return d.withColumn("impossible", F.coalesce(impossible, F.lit(False))).withColumn("prev_price", F.col("_p1")).drop("_p1", "_p2", "_p3", "_n")


def infer_splits(bars: DataFrame) -> DataFrame:
    """code, split_date, ratio: impossible jumps close to a whole ratio within a week's gap."""
    apart = F.greatest("prev_price", "price") >= 0.99 * LIKELY * F.least("prev_price", "price")  # cheap, and before the limits
    j = impossible_jump(bars).filter(apart).filter("impossible").withColumn("_r", F.col("prev_price") / F.col("price"))
    j = j.withColumn("_x", F.greatest("_r", 1 / F.col("_r"))).withColumn("_w", F.rint("_x"))
    ok = (F.col("_x") >= LIKELY) & (F.datediff("entry_date", "prev_date") <= GAP_DAYS) & F.col("_w").between(0.02, 100) & (F.col("_w") != 1) & (F.abs(F.col("_x") / F.col("_w") - 1) <= NEAR)
    return j.filter(ok).select("code", F.col("entry_date").alias("split_date"), F.when(F.col("_r") >= 1, F.col("_w")).otherwise(1 / F.col("_w")).alias("ratio"))


def plausible(events: DataFrame) -> DataFrame:
    """Events of a ratio that a jump can show."""
    return events.filter(F.col("ratio").between(0.02, 100) & (F.col("ratio") != 1) & (F.abs(F.ln("ratio")) >= F.ln(F.lit(LIKELY)))).withColumn("ratio", F.col("ratio").cast("double"))


def _stretch(date: Column) -> Column:
    """A date's stretch of as many days as an event's window has."""
    return F.floor(F.unix_date(date) / (BEFORE + AFTER)).cast("int")


def split_jump(bars: DataFrame, events: DataFrame) -> DataFrame:
    """For each event (code, split_date, ratio) the day of the jump that fits it best, if one fits: a range join on
    code and days, then an arg-min; the earliest day wins a tie. Both meet by code and stretch of days, an event in each
    stretch that its days reach, so a code with many events and jumps isn't all pairs of them."""
    e = plausible(events)
    hit = impossible_jump(bars.join(e.select("code").distinct(), "code", "left_semi")).filter("impossible").select("code", F.col("entry_date").alias("jump_date"), "prev_price", "price")
    e = e.withColumn("_s", F.explode(F.sequence(_stretch(F.date_sub("split_date", BEFORE)), _stretch(F.date_add("split_date", AFTER)))))
    near = e.join(hit.withColumn("_s", _stretch(F.col("jump_date"))), ["code", "_s"]).filter(F.col("jump_date").between(F.date_sub("split_date", BEFORE), F.date_add("split_date", AFTER)))
    near = near.withColumn("err", F.abs(F.ln(F.col("prev_price") / F.col("price")) - F.ln("ratio"))).filter(F.col("err") <= MATCH)
    return near.groupBy("code", "split_date", "ratio").agg(F.min(F.struct("err", "jump_date"))["jump_date"].alias("jump_date"))


def apply_once(bars: DataFrame, events: DataFrame) -> DataFrame:
    """One event a code: prices before its jump are divided by the ratio, volume multiplied."""
    found = split_jump(bars, events).select("code", "jump_date", "ratio")
    j = bars.join(found, "code", "left")
    before = F.coalesce(F.col("entry_date") < F.col("jump_date"), F.lit(False))
    prices = [c for c in ("open", "high", "low", "price", "adj_close") if c in bars.columns]
    out = {c: F.when(before, F.col(c) / F.col("ratio")).otherwise(F.col(c)) for c in prices}
    if "volume" in bars.columns:
        out["volume"] = F.when(before, F.col("volume") * F.col("ratio")).otherwise(F.col("volume").cast("double"))
    return j.withColumns(out).select(*bars.columns)


def _event_rows(events: DataFrame, rows: DataFrame) -> DataFrame:
    """Events that can be applied, in a code's order (k), each with the first and last row (numbers lo, hi) of its days, in
    clusters: an event belongs to the cluster of the one before if that one's jump could be a row that it looks at. r: its
    place in the cluster. Events without a row in their days find no jump and are left out."""
    e = plausible(events).withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("split_date", "ratio")))
    e = e.withColumn("_s", F.explode(F.sequence(_stretch(F.date_sub("split_date", BEFORE)), _stretch(F.date_add("split_date", AFTER)))))
    met = e.join(rows.select("code", "i", "entry_date", _stretch(F.col("entry_date")).alias("_s")), ["code", "_s"]).filter(F.col("entry_date").between(F.date_sub("split_date", BEFORE), F.date_add("split_date", AFTER)))
    e = met.groupBy("code", "k", "ratio").agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    order = Window.partitionBy("code").orderBy("k")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    e = e.withColumn("_new", F.coalesce(F.col("lo") - LOOK_BACK >= reached, F.lit(True)).cast("int"))
    e = e.withColumn("cluster", F.sum("_new").over(order))
    return e.withColumn("r", F.row_number().over(Window.partitionBy("code", "cluster").orderBy("k"))).drop("_new")


def jumps_in_order(bars: DataFrame, events: DataFrame) -> DataFrame:
    """code, k, jump_date, ratio: the jump of each event that has one, events by code in the order k of their dates, each
    searched in the prices that the earlier ones left.

    An event changes only prices before its jump, so what a later one sees differs by those events alone whose jump is
    among the rows that it looks at. Such events make a cluster; its rows are gathered, and its events folded over them by
    built-in functions. Where events follow each other closely a cluster may be a code's history, so an event computes only
    the prices of its own rows, from those earlier jumps that still reach them: the fold grows with the events, not with
    events times rows. All clusters of all codes are worked on at once."""
    with_events = plausible(events).select("code").distinct()
    rows = stored(bars.join(with_events, "code", "left_semi").select("code", "entry_date", F.col("price").cast("double").alias("price"), F.row_number().over(by_code()).alias("i")), "split-rows")
    e = stored(_event_rows(events, rows), "split-events")
    spans = e.groupBy("code", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("r", "k", "ratio", "lo", "hi"))).alias("events"))
    looked_at = spans.select("code", "cluster", F.explode(F.sequence(F.greatest(F.col("lo") - LOOK_BACK, F.lit(1)), F.col("hi"))).alias("i")).join(rows, ["code", "i"])
    gathered = looked_at.groupBy("code", "cluster").agg(F.sort_array(F.collect_list(F.struct("i", "entry_date", "price"))).alias("rows")).join(spans.select("code", "cluster", "events"), ["code", "cluster"])
    start = F.get("rows", F.lit(0))["i"]

    def step(acc: Column, e: Column) -> Column:
        first = F.greatest(e["lo"] - LOOK_BACK - start, F.lit(0))  # the first place that the event looks at

        def left(at: Column) -> Column:
            return F.aggregate(acc["live"], F.get("rows", at)["price"], lambda p, j: F.when(at < j["at"], p / j["ratio"]).otherwise(p))

        def best(prices: Column) -> Column:
            def fit(x: Column) -> Column:
                def judged(p: Column) -> Column:
                    err = F.abs(F.ln(p["p1"] / p["p0"]) - F.ln(e["ratio"]))
                    ok = (p["p1"] > 0) & (p["p0"] > 0) & (err <= MATCH) & _beyond(p) & ~((x + first + start > 3) & _widened(p))
                    return F.when(F.coalesce(ok, F.lit(False)), F.struct(err.alias("err"), (x + first).alias("at")))

                return let(F.struct(*[F.get(prices, x - n).alias(f"p{n}") for n in range(4)]), judged)  # a row's price and the three before

            return F.array_min(F.transform(F.sequence(e["lo"] - start - first, F.size(prices) - 1), fit))["at"]

        def applied(at: Column) -> Column:
            # Later events look at no row before this one's, so jumps that change older rows alone go.
            live = F.filter(F.when(at.isNull(), acc["live"]).otherwise(F.concat(acc["live"], F.array(F.struct(at.alias("at"), e["ratio"].alias("ratio"))))), lambda j: j["at"] > e["lo"] - LOOK_BACK - start)
            return F.struct(live.alias("live"), F.concat(acc["jumps"], F.array(at)).alias("jumps"))

        return let(let(F.transform(F.sequence(first, e["hi"] - start), left), best), applied)

    begin = F.struct(F.array().cast("array<struct<at:int,ratio:double>>").alias("live"), F.array().cast("array<int>").alias("jumps"))
    jumps = F.aggregate("events", begin, step, lambda acc: acc["jumps"])
    told = F.transform(F.arrays_zip("events", jumps.alias("at")), lambda x: F.struct(x["events"]["k"].alias("k"), F.get("rows", x["at"])["entry_date"].alias("jump_date"), x["events"]["ratio"].alias("ratio")))
    found = gathered.select("code", F.explode(F.filter(told, lambda x: x["jump_date"].isNotNull())).alias("x"))  # without the cluster's rows, which each jump would carry
    return stored(found.select("code", "x.*"), "jumps")


def apply_splits(bars: DataFrame, events: DataFrame) -> DataFrame:
    """All events, each searched in what the earlier ones left, as limits are in money: prices before an event's jump are
    divided by its ratio, volume multiplied. Codes without events pass by; the others are read for their events' rows, and
    once to be changed: jumps come among the rows, and a running product from the newest day back is each row's factor."""
    prices = [c for c in ("open", "high", "low", "price", "adj_close") if c in bars.columns]
    bars = bars.withColumns({c: F.col(c).cast("double") for c in (*prices, "volume") if c in bars.columns})
    jumps = jumps_in_order(bars, events).select("code", F.col("jump_date").alias("entry_date"), F.col("ratio").alias("_ratio"), F.lit(True).alias("_jump"))
    rows = bars.withColumns({"_ratio": F.lit(1.0), "_jump": F.lit(False)}).unionByName(jumps, allowMissingColumns=True)
    back = Window.partitionBy("code").orderBy(F.desc("entry_date"), "_jump").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    factor = F.least(F.greatest(F.product("_ratio").over(back), F.lit(5e-324)), F.lit(sys.float_info.max))  # never 0, never infinite
    rows = rows.withColumn("_factor", factor).filter(~F.col("_jump"))
    moved = F.col("entry_date").isNotNull() & (F.col("_factor") != 1)
    out = {c: F.when(moved, F.col(c) / F.col("_factor")).otherwise(F.col(c)) for c in prices}
    if "volume" in bars.columns:
        out["volume"] = F.when(moved, F.col("volume") * F.col("_factor")).otherwise(F.col("volume"))
    return rows.withColumns(out).select(*bars.columns)


def dedup_events(events: DataFrame, known: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """The plausible events that are to be recorded: of a code's, in order of arrival (a column order, else by date), each
    that no recorded one lies within ten days of, be it known before (code, split_date) or kept now. A fold over a code's
    events, not a session window. By date an event is held against the last kept one alone."""
    plausible = events.filter(F.col("ratio").between(0.02, 100) & (F.col("ratio") != 1))
    one = "struct<split_date:date,ratio:double>"
    at = F.col(order) if order else F.lit(0)
    folded = plausible.groupBy("code").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "split_date", F.col("ratio").cast("double").alias("ratio")))).alias("e"))
    if known is None:
        folded = folded.withColumn("known", F.array().cast("array<date>"))
    else:
        folded = folded.join(known.groupBy("code").agg(F.collect_set("split_date").alias("known")), "code", "left").withColumn("known", F.coalesce("known", F.array().cast("array<date>")))
    near = lambda a, b: F.abs(F.datediff(a, b)) <= APART

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))["split_date"]
        met = F.exists(acc, lambda k: near(k["split_date"], x["split_date"])) if order else F.coalesce(near(last, x["split_date"]), F.lit(False))
        return F.when(met, acc).otherwise(F.concat(acc, F.array(F.struct(x["split_date"].alias("split_date"), x["ratio"].alias("ratio")))))

    free = F.filter("e", lambda x: ~F.exists("known", lambda k: near(k, x["split_date"])))
    kept = folded.select("code", F.aggregate(free, F.array().cast(f"array<{one}>"), step).alias("e"))
    return kept.select("code", F.explode("e").alias("e")).select("code", "e.split_date", "e.ratio")


def adjust_history(bars: DataFrame, events: DataFrame) -> DataFrame:
    """Recorded events, then those inferred from the result, then the result's own adjustment; changed tells codes whose
    prices moved. Rows without a code or day go.

    Events are found once and stored, as they are read several times; a row takes its old price along. bars are read twice:
    where they are made by a costly plan, store them first."""
    first = stored(apply_splits(bars.withColumn("_old", F.col("price")), stored(dedup_events(events), "recorded")), "adjusted")
    second = apply_splits(first, stored(infer_splits(first), "inferred")).filter("code is not null and entry_date is not null")
    moved = F.coalesce(F.abs(F.col("price") / F.col("_old") - 1) > 1e-12, F.lit(False))
    return second.withColumn("changed", F.max(moved).over(Window.partitionBy("code"))).drop("_old")
