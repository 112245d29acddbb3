"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added before rounding, so that two engines that differ in a last bit round a tie the same way.
NUDGE = 1e-7


def finite(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c + F.lit(NUDGE), digits)


def cases(var: str, table: list[tuple[str, str]], last: str) -> str:
    """A CASE text for Spark and DuckDB: (condition, value) pairs, in order; the first that holds counts."""
    text = "CASE " + " ".join(f"WHEN {cond} THEN {value}" for cond, value in table) + f" ELSE {last} END"
    return text.replace("{x}", var)


def safe_float(c: Column) -> Column:
    """A number from text with thousands separators or a percent sign; null for nan, none, - or blank."""
    t = F.lower(F.trim(F.regexp_replace(c, "[,%]", "")))
    return F.when(t.isin("", "-", "nan", "none", "null"), F.lit(None)).otherwise(t).try_cast("double")


def date_text(c: Column) -> Column:
    """ISO text of a date in one of several writings, or the empty string."""
    t = F.trim(c)
    tries = [F.try_to_date(F.substring(t, 1, 10), f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd")] + [F.try_to_date(F.substring(t, 1, 8), "yyyyMMdd")]
    return F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)
