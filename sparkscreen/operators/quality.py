"""Contracts, profiles, scrubbing and fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import safe_float

ESSENTIAL = ("code", "price", "verdict")


def missing(df: DataFrame, c: str) -> Column:
    """Whether a row has no value in a column: null, NaN, or no such column."""
    kinds = dict(df.dtypes)
    if c not in kinds:
        return F.lit(True)
    return F.col(c).isNull() | (F.coalesce(F.isnan(c), F.lit(False)) if kinds[c] in ("double", "float") else F.lit(False))


def contract_check(df: DataFrame, essential: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """column, n_bad: nulls and NaNs; a missing column counts all rows."""
    one = df.agg(*[F.count_if(missing(df, c)).alias(c) for c in essential])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_bad")) for c in essential])).alias("x")).select("x.*")


def require_contract(df: DataFrame, essential: tuple[str, ...] = ESSENTIAL) -> DataFrame:
    """df itself; a row that breaks the contract, by a null or NaN, stops the job that reads it."""
    absent = [c for c in essential if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    ok = reduce(lambda a, b: a & b, [~missing(df, c) for c in essential])
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("an essential value is missing")).cast("boolean")))


class ContractError(ValueError):
    """Rows that were written break the contract."""


def write_observed(df: DataFrame, path: str, essential: tuple[str, ...] = ESSENTIAL, counts: dict[str, Column] | None = None, stop: bool = True) -> dict[str, int]:
    """Write df, and count on the way: n, how many rows miss each essential value, and how many meet each condition of counts.

    The write that happens anyway is the only pass. If the contract is broken, what was written is removed and the job ends
    with an error; with stop=False it stays, and the counts tell."""
    counts = counts or {}
    seen = Observation()
    told = [F.count(F.lit(1)).alias("n"), *[F.count_if(missing(df, c)).alias(f"missing {c}") for c in essential], *[F.count_if(F.coalesce(x, F.lit(False))).alias(f"count {k}") for k, x in counts.items()]]
    df.observe(seen, *told).write.parquet(path)
    got = {k: int(v) for k, v in seen.get.items()}
    bad = {c: got[f"missing {c}"] for c in essential if got[f"missing {c}"]}
    if bad and stop:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        raise ContractError(f"essential values are missing: {bad}")
    return got


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, share: filled values."""
    one = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_filled"), F.try_divide(F.col(c), F.col("_n")).alias("share")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


#: Headers of listing and screening files, and which of the names are numbers.
HEADERS = {
    "コード": "code", "コード/ティッカー": "code", "銘柄名": "name", "売上高": "sales", "市場": "market", "業種": "sector", "現在値": "current_price", "現値": "current_price",
    "PER(株価収益率)": "per", "予想PER": "per", "PER": "per", "PBR(株価純資産倍率)": "pbr", "実績PBR": "pbr", "PBR": "pbr", "ROE(自己資本利益率)": "roe", "配当利回り": "dividend_yield",
    "予想配当利回り": "dividend_yield", "売上高変化率": "sales_growth", "経常利益変化率": "profit_growth", "流動比率": "current_ratio", "当座比率": "quick_ratio", "平均売買代金": "trading_value", "売買代金": "trading_value", "RSI": "rsi",
}
NUMBERS = ("per", "pbr", "roe", "dividend_yield", "sales_growth", "profit_growth", "current_ratio", "quick_ratio", "trading_value", "rsi", "current_price")


def named(df: DataFrame, headers: dict[str, str] = HEADERS, numbers: tuple[str, ...] = NUMBERS) -> DataFrame:
    """df with known headers renamed and numbers parsed. Of several headers of one name the first column that has a value
    counts; other columns stay."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(headers.get(c, c), []).append(c)
    value = lambda name, c: safe_float(F.col(f"`{c}`").cast("string")) if name in numbers else F.col(f"`{c}`")
    return df.select(*[F.coalesce(*[value(name, c) for c in columns]).alias(name) for name, columns in groups.items()])


def history_profile(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("n_rows"), F.countDistinct("code").alias("n_codes"), F.countDistinct("entry_date").alias("n_days"), F.min("entry_date").alias("first_day"), F.max("entry_date").alias("last_day"))


def integrity(stocks: DataFrame, fundamentals: DataFrame, bars: DataFrame, least_rows: int = 1000, least_days: int = 20) -> DataFrame:
    """check, value, ok."""
    one = lambda df, name, agg, least: df.agg(agg.alias("value")).select(F.lit(name).alias("check"), "value", (F.col("value") >= least).alias("ok"))
    return one(stocks, "stocks", F.count("*"), least_rows).unionByName(one(fundamentals, "fundamentals", F.count("*"), least_rows)).unionByName(one(bars, "days", F.countDistinct("entry_date"), least_days))


#: What is scrubbed from texts, in order.
SCRUBS = (
    (r"(?i)(Subscription-Key=)[^&\s]+", "$1***"),
    (r"(?i)(api[_-]?key['\"]?\s*[:=]\s*['\"]?)[^\s'\",&]+", "$1***"),
    (r"\b[0-9a-fA-F]{32,}\b", "***"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "***@***"),
)


def scrub(text: Column) -> Column:
    for pattern, put in SCRUBS:
        text = F.regexp_replace(text, pattern, put)
    return text


#: What identifies a scored row.
HASHED = ("code", "name", "per", "pbr", "roe", "dividend_yield", "current_ratio", "rsi", "quant_score")


def row_hash(df: DataFrame, columns: tuple[str, ...] = HASHED) -> Column:
    """md5 of the values' texts between bars. Texts are taken as they are; a whole double has no fraction; what is missing,
    also as a column, is NaN."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if c not in kinds:
            return F.lit("NaN")
        plain = F.col(c).cast("string")
        if kinds[c] in ("double", "float"):
            x = F.col(c).cast("double")
            plain = F.when(~F.isnan(x), F.when((x == F.floor(x)) & (F.abs(x) < 1e18), x.cast("bigint").cast("string")).otherwise(plain))
        return F.coalesce(plain, F.lit("NaN"))

    return F.md5(F.concat_ws("|", *[text(c) for c in columns]))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Twelve hex digits that don't depend on the rows' order: row hashes are summed, a commutative aggregate of one row."""
    own = F.md5(F.to_json(F.struct(*sorted(df.columns))))
    half = lambda a: F.sum(F.conv(F.substring(own, a, 12), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.substring(F.sha1(F.concat_ws("-", F.count("*").cast("string"), half(1).cast("string"), half(13).cast("string"), half(21).cast("string"))), 1, 12).alias("fingerprint"))


def null_policy(df: DataFrame, policy: DataFrame, columns: list[str]) -> DataFrame:
    """policy: sector, column that may be null there. Per sector and column: nulls that no policy allows."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().alias("missing")) for c in columns])
    rows = df.select("sector", F.explode(each).alias("x")).select("sector", "x.*").groupBy("sector", "column").agg(F.count_if(F.col("missing")).alias("n"))
    allowed = policy.select(F.col("sector").alias("_s"), F.col("column").alias("_c"))
    return rows.join(allowed, (F.col("sector").eqNullSafe(F.col("_s"))) & (F.col("column") == F.col("_c")), "left_anti").filter("n > 0").select("sector", "column", F.col("n").alias("n_unexpected"))


def parity_diff(got: DataFrame, want: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, difference: missing, extra or the names of columns that differ."""
    a = got.select(key, *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("_a"))
    b = want.select(key, *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("_b"))
    differ = F.concat_ws(",", *[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns])
    j = a.join(b, key, "full").select(key, F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "extra").otherwise(differ).alias("difference"))
    return j.filter("difference <> ''")
