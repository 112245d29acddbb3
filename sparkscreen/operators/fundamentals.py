"""Repair of fundamentals, their adjustment for splits, and seed upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite


def _cols(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("double") for n in names if n not in df.columns})


def _positive(name: str) -> Column:
    return finite(F.col(name)) & (F.col(name) > 0)


def repair_equity(df: DataFrame) -> DataFrame:
    """A missing equity ratio from assets, else from the debt-equity ratio, where the divisor is finite and positive."""
    df = _cols(df, "equity_ratio", "net_assets", "total_assets", "debt_equity_ratio")
    from_assets = F.when(finite(F.col("net_assets")) & _positive("total_assets"), F.try_divide("net_assets", "total_assets") * 100)
    from_debt = F.when(_positive("debt_equity_ratio"), 100 / (1 + F.col("debt_equity_ratio") / 100))
    return df.withColumn("equity_ratio", F.coalesce("equity_ratio", from_assets, from_debt))


def repair_valuation(df: DataFrame) -> DataFrame:
    """Missing eps and bps from totals; per, pbr, yield and market value anew from the price, else as stored."""
    df = _cols(df, "eps", "bps", "dps", "per", "pbr", "dividend_yield", "market_cap", "net_profit", "net_assets", "shares_outstanding", "price")
    share = lambda total: F.when(finite(F.col(total)) & _positive("shares_outstanding"), F.try_divide(total, "shares_outstanding"))
    df = df.withColumns({"eps": F.coalesce("eps", share("net_profit")), "bps": F.coalesce("bps", share("net_assets"))})
    price = _positive("price")
    anew = lambda ok, value, stored: F.when(ok, value).otherwise(F.col(stored))
    return df.withColumns(
        {
            "per": anew(price & _positive("eps"), F.try_divide("price", "eps"), "per"),
            "pbr": anew(price & _positive("bps"), F.try_divide("price", "bps"), "pbr"),
            "dividend_yield": anew(price & finite(F.col("dps")) & (F.col("dps") >= 0), F.try_divide("dps", "price") * 100, "dividend_yield"),
            "market_cap": anew(price & _positive("shares_outstanding"), F.col("price") * F.col("shares_outstanding"), "market_cap"),
        }
    )


def profit_status(df: DataFrame) -> DataFrame:
    """How profit moved since the year before, and by how many percent of its size then."""
    df = _cols(df, "net_profit", "prev_net_profit")
    now, prev = F.col("net_profit"), F.col("prev_net_profit")
    status = F.when((prev < 0) & (now > 0), "turnaround_black").when((prev > 0) & (now < 0), "turnaround_white").when((prev < 0) & (now < 0) & (now > prev), "loss_shrinking").otherwise("normal")
    df = df.withColumn("turnaround_status", status).withColumn("is_turnaround", status == "turnaround_black")
    return df.withColumn("profit_growth_raw", F.when(prev != 0, F.try_divide(now - prev, F.abs(prev)) * 100))


def repair_clip(df: DataFrame, scale_below: float = 0.0, most_per: float = 1000.0) -> DataFrame:
    """Optional percent scaling of small ratios; per at most most_per; equity ratio within 0 and 100. Nulls stay."""
    out = {}
    if scale_below > 0:
        for c in ("roe", "equity_ratio", "operating_margin", "dividend_yield"):
            if c in df.columns:
                small = (F.abs(F.col(c)) > 0) & (F.abs(F.col(c)) < scale_below)
                df = df.withColumn(c, F.when(small, F.col(c) * 100).otherwise(F.col(c)))
    if "per" in df.columns:
        out["per"] = F.when(F.col("per") > most_per, F.lit(most_per)).otherwise(F.col("per"))
    if "equity_ratio" in df.columns:
        out["equity_ratio"] = F.when(F.col("equity_ratio") < 0, 0.0).when(F.col("equity_ratio") > 100, 100.0).otherwise(F.col("equity_ratio"))
    return df.withColumns(out)


def repair(df: DataFrame) -> DataFrame:
    return repair_clip(profit_status(repair_valuation(repair_equity(df))))


def _with_factors(df: DataFrame, splits: DataFrame, factors: dict[str, str]) -> DataFrame:
    """df with a factor for each date column of factors (new column -> date column): the product of the plausible ratios of
    splits after that date; 1 without any or for an unknown date. A code's splits, a handful, come to its row by one join."""
    plausible = splits.filter(F.col("ratio").between(0.02, 100) & (F.col("ratio") != 1))
    own = plausible.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("split_date", F.col("ratio").cast("double").alias("ratio")))).alias("_splits"))
    product = lambda day: F.aggregate(F.filter("_splits", lambda s: F.coalesce(s["split_date"] > F.try_to_date(day), F.lit(False))), F.lit(1.0), lambda acc, s: acc * s["ratio"])
    return df.join(own, "code", "left").withColumns({name: F.coalesce(product(day), F.lit(1.0)) for name, day in factors.items()}).drop("_splits")


def split_factor(basis: DataFrame, splits: DataFrame) -> DataFrame:
    """basis: code, basis_date. Adds factor."""
    return _with_factors(basis, splits, {"factor": "basis_date"})


def split_adjust(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Per-share facts after their filing's date are divided by the factor, the share count multiplied."""
    out = _with_factors(df, splits, {"_pl": "submitted_at", "_bs": "bs_submitted_at"})
    return out.withColumns({**{c: F.col(c) / F.col("_pl") for c in ("eps", "bps", "dps")}, "shares_outstanding": F.col("shares_outstanding") * F.col("_bs")}).drop("_pl", "_bs")


PL_FIELDS = ("sales", "net_profit", "operating_income", "eps", "dps", "roe")
BS_FIELDS = ("net_assets", "total_assets", "equity_ratio", "bps", "shares_outstanding")


def refresh_from_seed(stored: DataFrame, seed: DataFrame) -> DataFrame:
    """Profit and balance fields are judged by their own clocks: the seed's are taken if its period is newer, or the
    stored one unknown, or the periods equal and its filing not older. Seed nulls never erase; new sales bring the
    seed's growth, also a null one."""
    s = seed.select("code", *[F.col(c).alias(f"_{c}") for c in seed.columns if c != "code"])
    j = stored.join(s, "code", "left")

    def newer(period: str, filed: str) -> Column:
        a, b = F.nullif(F.col(f"_{period}"), F.lit("")), F.nullif(F.col(period), F.lit(""))
        same = (a == b) & (F.substring(F.coalesce(f"_{filed}", F.lit("")), 1, 16) >= F.substring(F.coalesce(filed, F.lit("")), 1, 16))
        return F.coalesce(a.isNotNull() & (b.isNull() | (a > b) | same), F.lit(False))

    pl, bs = newer("period_end", "submitted_at"), newer("bs_period_end", "bs_submitted_at")
    take = lambda ok, c: F.when(ok & F.col(f"_{c}").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
    out = {c: take(pl, c) for c in (*PL_FIELDS, "period_end", "submitted_at") if f"_{c}" in j.columns} | {c: take(bs, c) for c in (*BS_FIELDS, "bs_period_end", "bs_submitted_at") if f"_{c}" in j.columns}
    if "_sales_growth" in j.columns:
        out["sales_growth"] = F.when(pl & F.col("_sales").isNotNull(), F.col("_sales_growth")).otherwise(F.col("sales_growth"))
    return j.withColumns(out).select(*stored.columns)


def restore_missing(stored: DataFrame, seed: DataFrame, columns: list[str]) -> DataFrame:
    s = seed.select("code", *[F.col(c).alias(f"_{c}") for c in columns])
    return stored.join(s, "code", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(*stored.columns)


def backfill_growth(stored: DataFrame, seed: DataFrame, columns: tuple[str, ...] = ("sales_growth",)) -> DataFrame:
    """Only if no stored row has any of the growth columns: they come from the seed. The guard is a one-row aggregate."""
    any_stored = stored.agg(F.max(F.greatest(*[F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))).alias("_any"))
    s = seed.select("code", *[F.col(c).alias(f"_{c}") for c in columns])
    j = stored.join(s, "code", "left").crossJoin(F.broadcast(any_stored))
    return j.withColumns({c: F.when(F.col("_any") == 0, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*stored.columns)


def assemble_seed(parsed: DataFrame, base: DataFrame, listed: DataFrame) -> DataFrame:
    """All listed codes of either side; parsed values first, the base's where they are missing."""
    columns = [c for c in parsed.columns if c != "code"]
    b = base.select("code", *[F.col(c).alias(f"_{c}") for c in columns])
    out = parsed.join(b, "code", "full").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select("code", *columns)
    return out.join(listed.select("code").distinct(), "code", "left_semi")


#: Columns of a seed whose origin isn't verified.
UNVERIFIED = (
    "operating_cf", "free_cf", "payout_ratio", "payout_status", "current_ratio", "quick_ratio", "debt_equity_ratio", "sales_status", "profit_status", "is_turnaround", "turnaround_status",
    "profit_growth", "profit_growth_raw", "sales_growth", "repair_metadata", "fetch_status",
)


def drop_unverified(seed: DataFrame, columns: tuple[str, ...] = UNVERIFIED) -> DataFrame:
    """The seed with those columns null, of their own types."""
    return seed.withColumns({c: F.lit(None).cast(kind) for c, kind in seed.dtypes if c in columns})
