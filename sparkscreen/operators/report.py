"""The report: metrics with their source, ranks and formatted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import rounded
from .ranks import numbered


def with_sources(df: DataFrame) -> DataFrame:
    """Value and source of per, pbr, div_yield, market_cap and roe: what is stored if it is acceptable (calc if a
    recomputation agrees, else stored), what can be computed, or nothing (-)."""
    price = F.col("price")
    ratio = lambda d: F.when(F.col(d) > 0, price / F.col(d))
    real = F.when(price != 0, price)
    strict = {"per": F.when(F.col("eps") > 0, real / F.col("eps")), "pbr": F.when(F.col("bps") > 0, real / F.col("bps")), "div_yield": F.when(price > 0, F.col("dps") / price * 100), "market_cap": F.when(F.col("shares_outstanding") > 0, real * F.col("shares_outstanding"))}
    loose = {"per": ratio("eps"), "pbr": ratio("bps"), "div_yield": strict["div_yield"], "market_cap": F.when(F.col("shares_outstanding") > 0, price * F.col("shares_outstanding"))}
    stored = {"per": F.col("per"), "pbr": F.col("pbr"), "div_yield": F.col("dividend_yield"), "market_cap": F.col("market_cap")}
    out = {}
    for m in stored:
        fine = stored[m].isNotNull() & (F.lit(True) if m == "div_yield" else stored[m] > 0)
        rel, absolute = (0.001, 1.0) if m == "market_cap" else (0.01, 0.01)
        agrees = F.coalesce(F.abs(stored[m] - strict[m]) <= F.abs(strict[m]) * rel + absolute, F.lit(False))
        out[f"{m}_value"] = F.when(fine, stored[m]).otherwise(loose[m])
        out[f"{m}_src"] = F.when(fine & agrees, "calc").when(fine, "stored").when(loose[m].isNotNull(), "calc").otherwise("-")
    edinet = F.col("edinet_roe") if "edinet_roe" in df.columns else F.lit(None).cast("double")
    own = F.when(F.col("bps") > 0, F.col("eps") / F.col("bps") * 100)
    out["roe_value"] = F.coalesce(F.col("roe"), F.when(F.abs(edinet) < 1, edinet * 100).otherwise(edinet), own)
    out["roe_src"] = F.when(F.col("roe").isNotNull(), "stored").when(edinet.isNotNull(), "edinet").when(own.isNotNull(), "calc").otherwise("-")
    return df.withColumns(out)


def ranked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Ranks by score, then code, over ranges of the order. A limit keeps the top of a report, which is ranked alone."""
    order = F.desc_nulls_last("quant_score"), F.col("code")
    if limit is None:
        return numbered(df, *order)
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


#: The columns of a report.
COLUMNS = (
    "Rank", "Code", "Name", "Sector", "Market", "Market_Cap_Src", "Market_Cap", "Verdict", "Score", "Price", "Price_Date", "PER_Src", "PER", "PBR_Src", "PBR", "Div_Yield_Src", "Div_Yield",
    "ROE_Src", "ROE", "Sales_Growth", "Profit_Growth", "Operating_Margin", "Equity_Ratio", "RSI", "Trend", "Report_Timestamp",
)


def report_rows(df: DataFrame, limit: int | None = None, now: str | None = None) -> DataFrame:
    """Text rows with - for what is missing. Ratios have two decimals, other numbers four; the market value is cut to a whole
    number after rounding to three, so that a price whose last bit is off gives the same; the growth of profit is the one
    computed from filings if there is one; now: the report's time."""
    r = ranked(with_sources(df), limit)
    there = lambda *names: [F.col(c) for c in names if c in r.columns]
    first = lambda *names: F.coalesce(*there(*names)) if there(*names) else F.lit(None).cast("double")
    dash = lambda c: F.coalesce(c, F.lit("-"))
    number = lambda c, digits: dash(F.when(c.isNotNull() & ~F.isnan(c.cast("double")), F.format_string(f"%.{digits}f", rounded(c.cast("double"), digits))))
    label = lambda c: dash(F.when(~F.lower(F.trim(c)).isin("", "nan", "none"), c))
    out = {
        "Rank": F.col("rank"), "Code": F.col("code"), "Name": F.coalesce("name", F.lit("")), "Sector": label(first("sector_17", "sector").cast("string")), "Market": label(F.col("market")),
        "Market_Cap": dash(rounded(F.col("market_cap_value"), 3).cast("bigint").cast("string")), "Verdict": dash(F.col("verdict")), "Score": F.format_string("%.2f", rounded(F.coalesce("quant_score", F.lit(0.0)), 2)),
        "Price": number(F.col("price"), 4), "Price_Date": dash(F.substring(first("entry_date").cast("string"), 1, 10)),
        **{n: number(F.col(f"{n.lower()}_value"), 2) for n in ("PER", "PBR", "Div_Yield", "ROE")}, **{f"{n}_Src": F.col(f"{n.lower()}_src") for n in ("Market_Cap", "PER", "PBR", "Div_Yield", "ROE")},
        "Sales_Growth": number(first("sales_growth"), 4), "Profit_Growth": number(first("profit_growth_raw", "profit_growth"), 4), "Operating_Margin": number(first("operating_margin"), 4),
        "Equity_Ratio": number(first("equity_ratio"), 4), "RSI": number(first("rsi_14"), 1), "Trend": dash(first("score_trend", "trend_score").cast("string")),
        "Report_Timestamp": F.lit(now) if now else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"),
    }
    return r.select(*[out[c].alias(c) for c in COLUMNS])


GRADE_NAMES = {"STRONG_BUY": "Grade S", "BUY": "Grade A", "WATCH": "Grade B", "PASS": "Grade C"}


def grade_map(c: Column) -> Column:
    chain = F.when(F.lit(False), c)
    for k, v in GRADE_NAMES.items():
        chain = chain.when(c == k, v)
    return chain.otherwise(c)


def top_candidates(df: DataFrame, n: int = 10) -> DataFrame:
    """The best n of the two top grades; if nobody has one, the best n of all."""
    top = F.col("verdict").isin("Grade S", "Grade A")
    any_top = df.agg(F.coalesce(F.max(top.cast("int")), F.lit(0)).alias("_any"))
    return df.crossJoin(F.broadcast(any_top)).filter(top | (F.col("_any") == 0)).orderBy(F.desc("quant_score"), "code").limit(n).drop("_any")


def write_reports(df: DataFrame, path: str, now: str | None = None) -> None:
    """Two CSV folders of one file each, in UTF-8 with a byte order mark before the header: what passed, as report rows, and
    what was rejected, all columns with reason and detail."""

    def write(rows: DataFrame, name: str) -> None:
        rows = rows.withColumnRenamed(rows.columns[0], "\ufeff" + rows.columns[0])
        rows.coalesce(1).write.mode("overwrite").option("header", "true").option("nullValue", "-").option("encoding", "UTF-8").csv(f"{path}/{name}")

    write(report_rows(df.filter("filter_reason is null"), now=now), "passed")
    write(df.filter("filter_reason is not null"), "rejected")


def read_report(spark, path: str) -> DataFrame:
    """Report rows with the null marks read as nulls."""
    raw = spark.read.option("header", "true").csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    return raw.select(*[F.when(~F.trim(c).isin("-", "None", "null", ""), F.col(c)).alias(c) for c in raw.columns])
