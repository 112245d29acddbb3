"""Company filings: index, facts, field extraction by priority, sanity and merging into fundamentals."""

from __future__ import annotations

import io
import lzma
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_DOCUMENT = 256 << 20  # bytes of an unpacked document that a task reads
ANNUAL_TYPES, INTERIM_TYPES = ("120", "130"), ("160", "170")
NON_CONSOLIDATED = "_NonConsolidatedMember"
_S = "SummaryOfBusinessResults"
_NET_PROFIT = [f"ProfitLossAttributableToOwnersOfParent{_S}", f"ProfitLossAttributableToOwnersOfParentIFRS{_S}", f"NetIncomeLossAttributableToOwnersOfParentUSGAAP{_S}", f"NetIncomeLoss{_S}"]
#: Field, kind of period, elements by priority, whether the company's own statement may stand in.
#: EquityToAssetRatioIFRS is, against its name, equity per share.
FIELDS = (
    ("sales", "duration", [f"NetSales{_S}", f"RevenueIFRS{_S}", f"RevenuesUSGAAP{_S}", f"OperatingRevenue{_S}", f"OperatingRevenue1{_S}", f"OperatingRevenue2{_S}", f"BusinessRevenue{_S}", f"GrossOperatingRevenue{_S}", f"OrdinaryIncome{_S}", f"NetSalesIFRS{_S}"], False),
    ("net_profit", "duration", _NET_PROFIT, False),
    ("prev_net_profit", "prior_duration", _NET_PROFIT, False),
    ("total_assets", "instant", [f"TotalAssets{_S}", f"TotalAssetsIFRS{_S}", f"TotalAssetsUSGAAP{_S}"], False),
    ("net_assets", "instant", [f"NetAssets{_S}", f"EquityAttributableToOwnersOfParentIFRS{_S}", f"EquityAttributableToOwnersOfParentUSGAAP{_S}"], False),
    ("equity_ratio", "instant", [f"EquityToAssetRatio{_S}", f"RatioOfOwnersEquityToGrossAssetsIFRS{_S}", f"EquityToAssetRatioUSGAAP{_S}"], False),
    ("roe", "duration", [f"RateOfReturnOnEquity{_S}", f"RateOfReturnOnEquityIFRS{_S}", f"RateOfReturnOnEquityUSGAAP{_S}"], False),
    ("eps", "duration", [f"BasicEarningsLossPerShare{_S}", f"BasicEarningsLossPerShareIFRS{_S}", f"BasicEarningsLossPerShareUSGAAP{_S}"], False),
    ("bps", "instant", [f"NetAssetsPerShare{_S}", f"EquityToAssetRatioIFRS{_S}", f"EquityAttributableToOwnersOfParentPerShareUSGAAP{_S}"], False),
    ("dps", "duration", [f"DividendPaidPerShare{_S}"], True),
    ("shares_outstanding", "instant", [f"TotalNumberOfIssuedShares{_S}"], True),
    ("operating_income", "duration", ["OperatingIncome", "OperatingProfitLossIFRS", "OperatingIncomeLossUSGAAP"], False),
)
CONTEXTS = {
    "annual": {"duration": "CurrentYearDuration", "instant": "CurrentYearInstant", "prior_duration": "Prior1YearDuration"},
    "interim": {"duration": "InterimDuration", "instant": "InterimInstant"},
}
#: The share count as of the filing date.
FILING_SHARES = ("NumberOfIssuedSharesAsOfFilingDateIssuedSharesTotalNumberOfSharesEtc", "FilingDateInstant")
INTERIM_FIELDS = ("total_assets", "net_assets", "equity_ratio", "shares_outstanding")
RATIOS = ("equity_ratio", "roe")


def document_index(raw: DataFrame) -> DataFrame:
    """doc_id, code, is_annual, period_end, submitted of annual and interim reports of listed codes."""
    d = raw.filter(F.col("doc_type").isin(*ANNUAL_TYPES, *INTERIM_TYPES)).withColumn("code", clean_code(F.col("sec_code")))
    return d.filter("code is not null").select("doc_id", "code", F.col("doc_type").isin(*ANNUAL_TYPES).alias("is_annual"), period_end(F.col("period_end"), F.col("description")).alias("period_end"), "submitted")


def clean_code(c):
    four = F.substring(F.trim(c), 1, 4)
    return F.when(F.rlike(four, F.lit("^[0-9A-Za-z]{4}$")) & (four != "0000"), four)


def period_end(given, description):
    """The given end, else the last date written in the description, else empty."""
    written = F.try_element_at(F.regexp_extract_all(description, F.lit(r"(\d{4}/\d{2}/\d{2})"), F.lit(1)), F.lit(-1))
    return F.coalesce(F.nullif(F.substring(given, 1, 10), F.lit("")), F.replace(written, F.lit("/"), F.lit("-")), F.lit(""))


def select_documents(index: DataFrame, today: str, oldest: int = 480) -> DataFrame:
    """Per code the latest annual report, unless too old, and the latest interim one if it is newer."""
    w = Window.partitionBy("code", "is_annual").orderBy(F.desc("period_end"), F.desc("submitted"), "doc_id")
    top = index.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    annual = top.filter("is_annual").filter(F.coalesce(F.try_to_date("period_end") >= F.date_sub(F.to_date(F.lit(today)), oldest), F.lit(True)))
    interim = top.filter("not is_annual").join(annual.select("code", F.col("period_end").alias("_pe")), "code", "left").filter(F.col("_pe").isNull() | (F.col("period_end") > F.col("_pe"))).drop("_pe")
    return annual.unionByName(interim)


def filing_kind(facts: DataFrame) -> DataFrame:
    """doc_id, kind (annual before interim; others drop), consolidated."""
    has = lambda p: F.max(F.col("context").startswith(p).cast("int"))
    plain = F.col("element").endswith(_S) & ~F.col("context").endswith(NON_CONSOLIDATED) & F.col("value").isNotNull()
    k = facts.groupBy("doc_id").agg(F.when(has("CurrentYearDuration") == 1, "annual").when(has("InterimDuration") == 1, "interim").alias("kind"), (F.max(plain.cast("int")) == 1).alias("consolidated"))
    return k.filter("kind is not null")


def priority_table(spark: SparkSession) -> DataFrame:
    """field, kind, consolidated, element, context, prio: context first, then element. A few hundred fixed rows."""
    rows = []
    for field, period, tags, own in FIELDS:
        for kind, ctx in CONTEXTS.items():
            if period not in ctx or kind == "interim" and field not in INTERIM_FIELDS:
                continue
            for consolidated in (True, False):
                contexts = [ctx[period] + ("" if consolidated else NON_CONSOLIDATED)] + ([ctx[period] + NON_CONSOLIDATED] if own and consolidated else [])
                rows += [(field, kind, consolidated, t, c, 100 * i + j) for i, c in enumerate(contexts) for j, t in enumerate(tags)]
    return spark.createDataFrame(rows, "field string, kind string, consolidated boolean, element string, context string, prio int")


def filing_fields(facts: DataFrame) -> DataFrame:
    """One row a filing: kind and its fields, each from the first element and context that has a value."""
    spark = facts.sparkSession
    kinds = filing_kind(facts)
    hit = facts.filter("value is not null").join(kinds, "doc_id").join(F.broadcast(priority_table(spark)), ["kind", "consolidated", "element", "context"])
    best = hit.groupBy("doc_id", "kind", "field").agg(F.min_by("value", "prio").alias("v"))
    names = list(dict.fromkeys(f[0] for f in FIELDS))
    wide = best.groupBy("doc_id", "kind").agg(*[F.max(F.when(F.col("field") == n, F.col("v") * (100 if n in RATIOS else 1))).alias(n) for n in names])
    filed = facts.filter((F.col("element") == FILING_SHARES[0]) & (F.col("context") == FILING_SHARES[1]) & (F.col("value") > 0)).groupBy("doc_id").agg(F.max("value").alias("_filed"))
    out = kinds.select("doc_id", "kind").join(wide.drop("kind"), "doc_id", "left").join(filed, "doc_id", "left")
    return out.withColumn("shares_outstanding", F.coalesce("_filed", "shares_outstanding")).drop("_filed")


def sane(results: DataFrame) -> DataFrame:
    """Values that can't be: shares below 1000 void all per-share facts and themselves; net assets a thousand times off
    shares times bps void the per-share facts; an equity ratio beyond -1000 to 100 goes."""
    few = F.coalesce(F.col("shares_outstanding") < 1000, F.lit(False))
    r = F.abs(F.try_divide("net_assets", F.col("shares_outstanding") * F.nullif("bps", F.lit(0.0))))
    off = ~few & F.coalesce(~r.between(1e-3, 1e3), F.lit(False))
    out = {c: F.when(few | off, None).otherwise(F.col(c)) for c in ("eps", "bps", "dps")}
    out["shares_outstanding"] = F.when(few, None).otherwise(F.col("shares_outstanding"))
    out["equity_ratio"] = F.when(F.col("equity_ratio").between(-1000, 100), F.col("equity_ratio"))
    return results.withColumns(out)


def _blank(c):
    return F.nullif(F.coalesce(c, F.lit("")), F.lit(""))


PL = ("sales", "net_profit", "operating_income", "eps", "dps", "roe")
BS = ("net_assets", "total_assets", "equity_ratio", "bps", "shares_outstanding")


def bridge(results: DataFrame, stored: DataFrame) -> DataFrame:
    """stored fundamentals after at most one annual and then one interim filing a code: the interim one is judged by the
    periods that the annual one left. Adds annual_status and interim_status (success, superseded or null)."""
    pick = lambda kind, p: sane(results.filter(F.col("kind") == kind)).drop("kind").select("code", *[F.col(c).alias(f"{p}{c}") for c in results.columns if c not in ("code", "kind")])
    j = stored.join(pick("annual", "a_"), "code", "left").join(pick("interim", "i_"), "code", "left")
    has_a, a_pe = F.col("a_period_end").isNotNull(), F.col("a_period_end")
    a_ok = has_a & ~F.coalesce(a_pe < _blank(F.col("period_end")), F.lit(False))
    a_bs = a_ok & ~F.coalesce(a_pe < _blank(F.col("bs_period_end")), F.lit(False))
    same = F.abs(F.col("a_sales") - F.col("sales")) <= 1e-9 * F.greatest(F.abs("a_sales"), F.abs("sales"), F.lit(1.0))
    a_ratio = F.coalesce("a_equity_ratio", F.when(F.col("a_total_assets") > 0, F.try_divide("a_net_assets", "a_total_assets") * 100))
    a_roe = F.coalesce("a_roe", F.when(F.col("a_net_assets") > 0, F.try_divide("a_net_profit", "a_net_assets") * 100))
    margin = F.when(a_ok & (F.col("a_sales") > 0), F.try_divide("a_operating_income", "a_sales") * 100)
    value = {"equity_ratio": a_ratio, "roe": a_roe}
    upd = lambda ok, c: F.when(ok, F.coalesce(value.get(c, F.col(f"a_{c}")), F.col(c))).otherwise(F.col(c))
    step = {c: upd(a_ok, c) for c in PL} | {c: upd(a_bs, c) for c in BS}
    step["operating_margin"] = F.coalesce(margin, "operating_margin")
    step["sales_growth"] = F.when(a_ok & F.coalesce(~same, F.lit(False)), None).otherwise(F.col("sales_growth"))
    for c, s in (("period_end", "a_period_end"), ("submitted_at", "a_submit_date")):
        step[c] = F.when(a_ok, F.col(s)).otherwise(F.col(c))
        step[f"bs_{c}"] = F.when(a_bs, F.col(s)).otherwise(F.col(f"bs_{c}"))
    step["annual_status"] = F.when(a_ok, "success").when(has_a, "superseded")
    m = j.withColumns(step)
    i_pe = F.col("i_period_end")
    i_ok = i_pe.isNotNull() & ~F.coalesce(i_pe < _blank(F.col("bs_period_end")), F.lit(False)) & ~F.coalesce(i_pe <= _blank(F.col("period_end")), F.lit(False))
    i_ratio = F.coalesce("i_equity_ratio", F.when(F.col("i_total_assets") > 0, F.try_divide("i_net_assets", "i_total_assets") * 100))
    last = {c: F.when(i_ok, F.coalesce(i_ratio if c == "equity_ratio" else F.col(f"i_{c}"), F.col(c))).otherwise(F.col(c)) for c in INTERIM_FIELDS}
    last |= {"bs_period_end": F.when(i_ok, i_pe).otherwise(F.col("bs_period_end")), "bs_submitted_at": F.when(i_ok, F.col("i_submit_date")).otherwise(F.col("bs_submitted_at"))}
    last["interim_status"] = F.when(i_ok, "success").when(i_pe.isNotNull(), "superseded")
    return m.withColumns(last).select(*stored.columns, "annual_status", "interim_status")


def archive_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of each zip under path. Spark lists and deals the archives; the file's name is the document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    return facts_of_archives(files.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("doc_id"), "content"))


def facts_of_archives(archives: DataFrame) -> DataFrame:
    """archives: doc_id, content (a zip). doc_id, element, context, value, period of the largest public .xbrl of each (of any
    .xbrl, if none is public). The first fact of an element and context counts, also one that is no number, which has no
    value. An archive or a document that can't be read, or that says it has over
    MOST_DOCUMENT bytes, gives no facts. A task reads one archive after the other."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [x for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True) for x in facts_of(doc, bytes(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "element", "context", "value", "period"]).astype({"value": "float64"})

    return archives.select("doc_id", "content").mapInPandas(read, "doc_id string, element string, context string, value double, period string")


def facts_of(doc_id: str, archive: bytes) -> list[tuple]:
    local = lambda tag: tag.rpartition("}")[2]
    periods, found = {}, {}
    try:
        with zipfile.ZipFile(io.BytesIO(archive)) as z:
            every = [i for i in z.infolist() if i.filename.endswith(".xbrl")]
            names = [i for i in every if "PublicDoc" in i.filename] or every
            one = max(names, key=lambda i: i.file_size) if names else None
            root = ElementTree.fromstring(z.read(one)) if one is not None and one.file_size <= MOST_DOCUMENT else ElementTree.Element("none")
    except (zipfile.BadZipFile, zlib.error, lzma.LZMAError, EOFError, OSError, RuntimeError, NotImplementedError, ElementTree.ParseError):  # damaged, encrypted, or packed in another way
        root = ElementTree.Element("none")
    for e in root.iter():
        name = e.tag.rpartition("}")[2]
        if name == "context":
            ends = {local(x.tag): x.text for x in reversed(list(e.iter())) if local(x.tag) in ("instant", "endDate")}
            end = ends.get("instant") or ends.get("endDate")
            periods[e.get("id")] = end.strip() if end else None
        elif (ref := e.get("contextRef")) and (name, ref) not in found:
            try:
                found[name, ref] = float((e.text or "").strip())
            except ValueError:
                found[name, ref] = None
    return [(doc_id, t, c, v, periods.get(c)) for (t, c), v in found.items()]


def land_packed(results: DataFrame, path: str) -> None:
    """results: code, submit_date and fields. All results as JSON, one in a line, each under the name that its own file would
    have in a field item; so there are as many files as tasks, and not as many as results."""
    named = results.withColumn("item", F.concat("code", F.lit("_"), "submit_date", F.lit(".json")))
    named.drop("code").write.mode("append").json(path)


def parsed_results(spark: SparkSession, path: str, version: int, code: str = r"([^/_.]+)[^/]*\.json$", packed: bool = False) -> DataFrame:
    """Landed JSON results of the current parser version; the code is a part of the file's path, by default how its name begins.
    packed: as land_packed writes them; the item of a line stands for the path."""
    read = spark.read.option("recursiveFileLookup", "true")
    df = read.json(path) if packed else read.option("multiLine", "true").json(path)
    return df.withColumn("code", F.regexp_extract(F.col("item") if packed else F.col("_metadata.file_path"), code, 1)).filter(F.col("parser_version") == version)


#: The fields of landed results and their types, where a parser's version may have written another type.
RESULT_FIELDS = {
    "kind": "string", "period_end": "string", "submit_date": "string", "sales": "double", "net_profit": "double", "operating_income": "double", "net_assets": "double", "total_assets": "double",
    "equity_ratio": "double", "shares_outstanding": "double", "eps": "double", "bps": "double", "dps": "double", "roe": "double",
}


def results_of_versions(spark: SparkSession, path: str, versions: tuple[int, ...], fields: dict[str, str] | None = None, code: str = r"([^/_.]+)[^/]*\.json$", packed: bool = False) -> DataFrame:
    """Landed JSON results, one in a line, of several parser versions: code, parser_version and the fields. packed: as
    land_packed writes them; the item of a line stands for the file's path.

    A line becomes a variant once and each field is taken from it with its type, so files are read once, without a pass that
    guesses a schema of all of them, and a field that versions wrote with different types (a number as text) is one column.
    A value that can't be of the type is null, as is a field that a version lacks; a line that is no JSON gives no row."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(F.try_parse_json("value").alias("v"), F.col("_metadata.file_path").alias("path"))
    name = F.try_variant_get("v", "$.item", "string") if packed else F.col("path")
    version = F.try_variant_get("v", "$.parser_version", "int")
    rows = lines.filter(version.isin(*versions)).select(F.regexp_extract(name, code, 1).alias("code"), version.alias("parser_version"), *[F.try_variant_get("v", f"$.{c}", t).alias(c) for c, t in (fields or RESULT_FIELDS).items()])
    return rows
