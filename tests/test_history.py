"""Splits, merges, upserts, master and filings on small histories with known results."""

import datetime as dt
import io
import math
import random
import zipfile

import pytest

from sparkscreen.operators import filings, history, splits, tables
from sparkscreen.sources import loads


def weekdays(start, n):
    d, out = start, []
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


def bars(spark, prices, start=dt.date(2026, 2, 12), code="1"):
    return spark.createDataFrame([(code, d, float(p), 100) for d, p in zip(weekdays(start, len(prices)), prices, strict=True)], "code string, entry_date date, price double, volume long")


def events(spark, *rows):
    return spark.createDataFrame([("1", d, float(r)) for d, r in rows], "code string, split_date date, ratio double")


def prices(df):
    return [round(r["price"], 4) for r in df.orderBy("entry_date").collect()]


def folded(series, found):
    """Bars (day, price, volume) after split events in the order of their dates, one after the other."""
    series = [list(b) for b in sorted(series)]

    def limit(p):
        return next((float(n) for below, n in splits.PRICE_LIMITS if p < below), p * 0.3)

    def side(i):
        if i < 1 or abs(series[i][1] - series[i - 1][1]) < 0.8 * limit(series[i - 1][1]):
            return 0
        return 1 if series[i][1] > series[i - 1][1] else -1

    for day, ratio in sorted(found):
        if not 0.02 <= ratio <= 100 or abs(math.log(ratio)) < math.log(1.9):
            continue
        fits = []
        for i in range(1, len(series)):
            before, now = series[i - 1][1], series[i][1]
            wide = i >= 3 and side(i - 1) == side(i - 2) != 0
            err = abs(math.log(before / now) - math.log(ratio))
            if -14 <= (series[i][0] - day).days <= 5 and abs(now - before) > limit(before) and not wide and err <= 0.12:
                fits.append((err, i))
        for b in series[: min(fits)[1]] if fits else []:
            b[1] /= ratio
            b[2] *= ratio
    return series


def test_splits_equal_a_plain_fold(spark):
    """Histories of random lengths and gaps with splits planted in them, events near and off those days, dense runs of
    events, events of other codes, and ratios that don't count."""
    r = random.Random(11)
    data, told = {}, {}
    for n in range(14):
        day, price, series, found = dt.date(2011, 5, 3) + dt.timedelta(days=n), r.uniform(80, 9000), [], []
        for _ in range(r.randrange(2, 160)):
            if r.random() < (0.3 if n % 3 == 0 else 0.05):
                ratio = r.choice([2, 3, 5, 10, 0.5, 0.2, 0.1])
                price /= ratio
                if r.random() < 0.8:
                    found.append((day + dt.timedelta(days=r.randrange(-6, 16)), ratio * r.choice([1.0, 1.0, 1.05, 1.3])))
            series.append((day, price, float(r.randrange(1, 500))))
            price = max(2.0, price * r.uniform(0.97, 1.03))
            day += dt.timedelta(days=r.choice([1, 1, 1, 3, 4, 12]))
        data[f"c{n}"], told[f"c{n}"] = series, [*found, (day, 1.0), (day, 1.2), (series[0][0], 5000.0)]
    told["nowhere"] = [(dt.date(2011, 7, 1), 2.0)]
    data["plain"] = data["c1"]
    df = spark.createDataFrame([(c, *b) for c, s in data.items() for b in s], "code string, entry_date date, price double, volume double")
    ev = spark.createDataFrame([(c, *e) for c, s in told.items() for e in s], "code string, split_date date, ratio double")
    got: dict = {}
    for row in splits.apply_splits(df, ev).orderBy("code", "entry_date").collect():
        got.setdefault(row["code"], []).append([row["entry_date"], row["price"], row["volume"]])
    changed = 0
    for c, series in data.items():
        want = folded(series, told.get(c, []))
        changed += want != [list(b) for b in series]
        assert [g[0] for g in got[c]] == [w[0] for w in want]
        assert [x for g in got[c] for x in g[1:]] == pytest.approx([x for w in want for x in w[1:]], rel=1e-12), c
    assert changed >= 8
    assert splits.apply_splits(df, ev.limit(0)).exceptAll(df).count() == 0 and splits.apply_splits(df.limit(0), ev).count() == 0


def test_an_event_is_applied_once(spark):
    """What an event has changed no longer shows its jump; one event alone has the simple form as well."""
    series = [(d, float(p), 60.0) for d, p in zip(weekdays(dt.date(2018, 9, 3), 11), [4400, 4431, 4380, 4402, 4399, 887, 880, 891, 902, 899, 884], strict=True)]
    df = spark.createDataFrame([("1", *b) for b in series], "code string, entry_date date, price double, volume double")
    ev = events(spark, (dt.date(2018, 9, 11), 5))
    once = splits.apply_splits(df, ev)
    assert prices(once) == [round(b[1], 4) for b in folded(series, [(dt.date(2018, 9, 11), 5.0)])] != prices(df)
    assert prices(splits.apply_splits(once, ev)) == prices(once) == prices(splits.apply_once(df, ev))


@pytest.mark.parametrize(
    ("series", "event"),
    # A fall within the day's limit, an implausible ratio, a ratio too near 1.
    [([640, 655, 650, 661, 590], (dt.date(2026, 2, 16), 4)), ([500, 502, 501, 503, 500], (dt.date(2026, 2, 16), 3e-06)), ([2000, 2010, 2030, 1990, 1880, 1900, 1885], (dt.date(2026, 2, 18), 1.06))],
)
def test_no_split(spark, series, event):
    assert prices(splits.apply_splits(bars(spark, series), events(spark, event))) == [round(float(p), 4) for p in series]


@pytest.mark.parametrize(
    ("series", "want"),
    # Ten for one; two to one back; a glitch of no whole ratio; a doubling within the limit of a low price; one after two days at
    # their limits; one after quiet days.
    [([6000, 6060, 607, 604], [10.0]), ([310, 618], [0.5]), ([900, 650, 649, 250, 7e10], []), ([25, 50], []), ([195, 197, 246, 325, 645], []), ([320, 322, 321, 640], [0.5])],
)
def test_inferred(spark, series, want):
    assert [r["ratio"] for r in splits.infer_splits(bars(spark, series)).collect()] == want


def test_events_within_ten_days_are_one(spark):
    d = dt.date(2026, 1, 1)
    got = splits.dedup_events(events(spark, (d, 2), (d + dt.timedelta(8), 2), (d + dt.timedelta(12), 3), (d + dt.timedelta(5), 1)))
    assert [(r["split_date"], r["ratio"]) for r in got.orderBy("split_date").collect()] == [(d, 2.0), (d + dt.timedelta(12), 3.0)]


def test_adjust_history_finds_the_rest(spark):
    got = splits.adjust_history(bars(spark, [6000, 6060, 607, 604]), events(spark, (dt.date(2020, 1, 1), 2)))
    assert prices(got)[:2] == [600.0, 606.0] and got.filter("changed").count() == 4


def test_adjust_history_joins_no_bars_again(spark):
    """A row takes its old price along, and jumps come among the rows: no join of a whole history is left."""
    got = splits.adjust_history(bars(spark, [6000, 6060, 607, 604]), events(spark, (dt.date(2020, 1, 1), 2)))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_long_chain_of_splits(spark):
    """6,000 events, each near the next, make one cluster of a code's whole history, and each row has one factor."""
    days = weekdays(dt.date(1970, 1, 5), 12_000)
    series = [("1", d, 250.0 if (i + 1) // 2 % 2 else 1000.0, 100) for i, d in enumerate(days)]
    found = [("1", d, 4.0 if i % 4 == 1 else 0.25) for i, d in enumerate(days) if i % 2]
    df = spark.createDataFrame(series, "code string, entry_date date, price double, volume long")
    ev = spark.createDataFrame(found, "code string, split_date date, ratio double")
    assert {r["price"] for r in splits.apply_splits(df, ev).collect()} == {series[-1][2]}


def test_merge_and_mismatch(spark):
    day = dt.date(2026, 5, 12)
    one = lambda *r: spark.createDataFrame([("1", day + dt.timedelta(i), float(p)) for i, p in r], "code string, entry_date date, price double")
    assert prices(history.merge_history(one((0, 100), (1, 0)), one((1, 102), (4, 103)))) == [100, 102, 103]
    assert history.adjust_mismatch(one((0, 8000), (1, 8100)), one((1, 8100))).first()["mismatch"] is False
    assert history.adjust_mismatch(one((0, 8000), (1, 8100)), one((1, 2700))).first()["ratio"] == pytest.approx(3.0)


@pytest.mark.parametrize(("last", "today", "want"), [("2026-09-25", "2026-09-28", "2d"), ("2026-09-25", "2026-10-02", "10d"), ("2026-09-28", "2026-09-28", "2d"), ("2026-08-01", "2026-10-02", "1y")])
def test_load_plan(spark, last, today, want):
    d = dt.date.fromisoformat(last)
    df = spark.createDataFrame([("1", d - dt.timedelta(i)) for i in range(30)], "code string, entry_date date")
    codes = spark.createDataFrame([("1",), ("2",)], "code string")
    got = {r["code"]: r["period"] for r in history.load_plan(df, codes, today).collect()}
    assert got == {"1": want, "2": "1y"}


def test_partial_upsert(spark):
    t = spark.createDataFrame([("a", 1, 2), ("b", 3, 4)], "k string, x int, y int")
    s = spark.createDataFrame([("a", None), ("c", 9)], "k string, x int")
    assert sorted(map(tuple, tables.upsert(t, s, ["k"]).collect())) == [("a", None, 2), ("b", 3, 4), ("c", 9, None)]


def test_known_events_count_as_recorded(spark):
    d = dt.date(2026, 1, 1)
    days = lambda *n: events(spark, *[(d + dt.timedelta(i), 2) for i in n])
    got = splits.dedup_events(days(0, 5, 16, 40), days(9, 300).drop("ratio"))
    assert sorted((r["split_date"] - d).days for r in got.collect()) == [40]
    arrived = days(20, 12, 31, 0).selectExpr("*", "CASE datediff(split_date, DATE '2026-01-01') WHEN 20 THEN 1 WHEN 12 THEN 2 WHEN 31 THEN 3 ELSE 4 END AS at")
    assert sorted((r["split_date"] - d).days for r in splits.dedup_events(arrived, order="at").collect()) == [0, 20, 31]


MASTER = "code string, name string, sector string, market string, status string, is_active boolean, exclusion_reason string, excluded_until string, fail_count int, last_fail_date string"


def master(spark, rows):
    return spark.createDataFrame([(c, "n", "s", "m", *rest) for c, *rest in rows], MASTER)


def test_master_guard(spark):
    stocks = master(spark, [(str(i), "active", True, None, None, 0, None) for i in range(10)])
    live = stocks.select("code", "name", "sector", "market").filter("code <> '3'")
    gone = tables.master_sync(stocks, live, least=5).filter("code = '3'").first()
    assert (gone["status"], gone["is_active"], gone["exclusion_reason"]) == ("delisted", False, tables.DELISTED_REASON)
    kept = tables.master_sync(stocks, live, least=3000).filter("code = '3'").first()
    assert (kept["status"], kept["is_active"]) == ("active", True)
    many = tables.master_sync(stocks, live.filter("code > '5'"), least=1)
    assert many.filter("status = 'delisted'").count() == 0


def test_only_delisted_codes_are_relisted(spark):
    stocks = master(spark, [("1", "delisted", False, tables.DELISTED_REASON, None, 0, None), ("2", "suspended", False, "paused", None, 0, None), ("3", "active", True, None, None, 0, None)])
    live = spark.createDataFrame([(c, f"new {c}", "x", None) for c in "12345"] + [("5", "again", "x", None)], "code string, name string, sector string, market string")
    got = {r["code"]: (r["name"], r["market"], r["status"], r["is_active"], r["exclusion_reason"], r["change"]) for r in tables.master_sync(stocks, live, least=1).collect()}
    assert got["1"] == ("new 1", None, "active", True, None, "relisted") and got["2"] == ("new 2", None, "suspended", False, "paused", "kept")
    assert got["3"][2:] == ("active", True, None, "kept") and got["4"][2:] == ("active", True, None, "new") and len(got) == 5


@pytest.mark.parametrize(("last", "due"), [(None, True), ("", True), ("soon", True), ("2026-05-01", True), ("2026-05-02T09:00", False), ("2026-05-30", False)])
def test_the_master_is_due_after_thirty_days(last, due):
    assert tables.refresh_due(last, "2026-05-31") is due and tables.refresh_due(last, "2026-05-31", force=True)


def test_codes_without_data_pause_at_the_third_failure(spark):
    rows = [("a", "active", True, None, None, 2, "2026-05-01"), ("b", "active", True, None, None, 1, "2026-05-10"), ("c", "active", True, tables.NO_DATA_REASON, "2026-06-01", 3, "2026-05-01"), ("d", "active", True, "other", None, 0, "2026-01-01"), ("e", "active", True, None, None, 5, "2026-05-10"), ("f", "active", True, None, None, 1, None)]
    stocks = master(spark, rows + [(f"g{i}", "active", True, None, None, 0, None) for i in range(20)])
    codes = lambda *c: spark.createDataFrame([(x,) for x in c], "code string")
    asked, got = stocks.select("code"), codes("c", "d", *[f"g{i}" for i in range(20)])
    found = {r["code"]: tuple(r)[1:] for r in tables.track_no_data(stocks, asked, got, codes("f"), "2026-05-10").collect()}
    assert found["a"] == (3, "2026-05-10", "2026-06-09", tables.NO_DATA_REASON)
    assert found["b"] == (1, "2026-05-10", None, None) and found["e"] == (5, "2026-05-10", "2026-06-09", tables.NO_DATA_REASON)
    assert found["c"] == (0, None, None, None) and found["d"] == (0, "2026-01-01", None, "other") and found["f"] == (1, None, None, None)
    bad = {r["code"]: tuple(r)[1:] for r in tables.track_no_data(stocks, asked, codes("c"), codes("f"), "2026-05-10").collect()}
    assert bad["a"] == (2, "2026-05-01", None, None)


@pytest.mark.parametrize(
    ("log", "want"),
    # run, days scanned, and those that failed
    [
        ([("2026-01-05", ["2026-01-05"], ["2026-01-05"]), ("2026-06-01", ["2026-06-01"], [])], ("2026-06-01", 7)),
        ([("2026-05-20", ["2026-05-20"], []), ("2026-06-01", ["2026-05-21", "2026-05-25", "2026-06-01"], ["2026-05-25"])], ("2026-05-20", 14)),
        ([("2026-05-20", ["2026-05-20"], []), ("2026-06-01", ["2026-05-01", "2026-06-01"], ["2026-06-01"])], ("2026-05-20", 14)),
        ([("2026-06-01", ["2026-06-01"], ["2026-06-01"])], ("2026-05-31", 7)),
        ([("2020-06-01", ["2020-06-01"], [])], ("2020-06-01", 365)),
    ],
)
def test_scan_window(spark, log, want):
    rows = [(dt.date.fromisoformat(run), dt.date.fromisoformat(d), d not in bad) for run, days, bad in log for d in days]
    got = tables.scan_window(spark.createDataFrame(rows, "run_date date, scan_date date, ok boolean"), "2026-06-02", 7).first()
    assert (str(got["mark"]), got["days"]) == want
    none = tables.scan_window(spark.createDataFrame([], "run_date date, scan_date date, ok boolean"), "2026-06-02", 7).first()
    assert (none["mark"], none["days"]) == (None, 7)


XML = b"""<x xmlns:a="u"><context id="CurrentYearDuration"><period><endDate>2026-03-31</endDate></period></context>
<a:NetSalesSummaryOfBusinessResults contextRef="CurrentYearDuration">1000</a:NetSalesSummaryOfBusinessResults>
<a:EquityToAssetRatioSummaryOfBusinessResults contextRef="CurrentYearInstant">.415</a:EquityToAssetRatioSummaryOfBusinessResults>
<a:NetIncomeLossSummaryOfBusinessResults contextRef="Prior1YearDuration">40</a:NetIncomeLossSummaryOfBusinessResults>
<a:DividendPaidPerShareSummaryOfBusinessResults contextRef="CurrentYearDuration_NonConsolidatedMember">13</a:DividendPaidPerShareSummaryOfBusinessResults>
<a:Note contextRef="CurrentYearDuration">text</a:Note></x>"""


def test_archives_to_fields(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("XBRL/PublicDoc/report.xbrl", XML)
        z.writestr("XBRL/AuditDoc/other.xbrl", XML * 3)
    (tmp_path / "S100.zip").write_bytes(b.getvalue())
    facts = filings.archive_facts(spark, str(tmp_path))
    r = filings.filing_fields(facts).first()
    assert (r["doc_id"], r["kind"], r["sales"], r["equity_ratio"], r["prev_net_profit"], r["dps"], r["bps"]) == ("S100", "annual", 1000.0, 41.5, 40.0, 13.0, None)


def test_archives_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    for name, files in (("other", {"XBRL/AuditDoc/a.xbrl": XML}), ("broken", {"XBRL/PublicDoc/a.xbrl": b"<x>"}), ("none", {"readme.txt": b""})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for path, text in files.items():
                z.writestr(path, text)
    facts = filings.archive_facts(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in facts} == {"other"} and {(r["element"], r["value"]) for r in facts} >= {("Note", None), ("NetSalesSummaryOfBusinessResults", 1000.0)}


def test_results_of_the_current_version(spark, tmp_path):
    for name, version in (("7203_S1.json", 3), ("130A.json", 3), ("9999_S2.json", 2)):
        (tmp_path / name).write_text(f'{{"parser_version": {version},\n "sales": 5}}')
    assert {r["code"] for r in filings.parsed_results(spark, str(tmp_path), 3).collect()} == {"7203", "130A"}


def test_a_price_batch(spark):
    nan = float("nan")
    wide = spark.createDataFrame(
        [("2026-01-05", 1.0, 10.0, 0.0, nan, nan), ("2026-01-06", 2.0, nan, 3.0, 20.0, 1e-7), ("2026-01-07", nan, nan, nan, 21.0, 0.5)],
        "Date string, `7203.T|Open` double, `7203.T|Close` double, `7203.T|Stock Splits` double, `130A.T|Close` double, `130A.T|Stock Splits` double",
    )
    bars = sorted((r["code"], r["Date"], r["Open"], r["Close"]) for r in loads.batch_bars(wide).collect())
    assert bars == [("130A", "2026-01-06", None, 20.0), ("130A", "2026-01-07", None, 21.0), ("7203", "2026-01-05", 1.0, 10.0)]
    assert loads.batch_bars(wide).columns == ["code", "Date", "Close", "Open"]
    assert sorted((r["code"], str(r["split_date"]), r["ratio"]) for r in loads.batch_events(wide).collect()) == [("130A", "2026-01-07", 0.5), ("7203", "2026-01-06", 3.0)]


def test_lookups(spark):
    stocks = master(spark, [("1", "active", True, None, None, 0, None), ("2", "active", None, None, None, 0, None), ("3", "active", False, None, None, 0, None)])
    assert [loads.active(stocks, u).count() for u in (True, False)] == [2, 1]
    assert loads.exists(stocks, "2") and not loads.exists(stocks, "9") and loads.by_code(stocks, "3").first()["is_active"] is False
    assert stocks.filter("code = '1'").count() == tables.suspend(stocks, stocks.filter("code = '1'"), "why").filter("status = 'suspended' and not is_active and exclusion_reason = 'why'").count()


def test_document_index_codes(spark):
    raw = spark.createDataFrame([("d1", "72030", "120", None, "report (2025/04/01-2026/03/31)", "s"), ("d2", "00000", "120", "2026-03-31", "", "s"), ("d3", None, "160", "2026-03-31", "", "s"), ("d4", "130A0", "160", "2026-09-30", "", "s"), ("d5", "72030", "140", "x", "", "s")], "doc_id string, sec_code string, doc_type string, period_end string, description string, submitted string")
    assert sorted(map(tuple, filings.document_index(raw).collect())) == [("d1", "7203", True, "2026-03-31", "s"), ("d4", "130A", False, "2026-09-30", "s")]


def test_archives_that_cannot_be_read_give_no_facts(spark):
    def packed(name, text, how=zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", how) as z:
            z.writestr(name, text)
        return bytearray(out.getvalue())

    fine = packed("XBRL/PublicDoc/a.xbrl", '<x><context id="c"><period><instant>2001-03-31</instant></period></context><Sales contextRef="c">5</Sales></x>' * 1)
    noise = "".join(random.Random(2).choice("<ab>") for _ in range(4000))
    damaged, encrypted, unknown = packed("PublicDoc/a.xbrl", noise), bytearray(fine), bytearray(fine)
    damaged[60:400] = bytes(340)  # within the deflated bytes
    for z, local, central, value in ((encrypted, 6, 8, 1), (unknown, 8, 10, 99)):
        at = bytes(z).index(b"PK\x01\x02")
        z[local], z[at + central] = value, value
    short = fine[: len(fine) // 2]
    rows = [("fine", bytes(fine)), ("damaged", bytes(damaged)), ("encrypted", bytes(encrypted)), ("unknown", bytes(unknown)), ("short", bytes(short)), ("none", b"")]
    got = filings.facts_of_archives(spark.createDataFrame(rows, "doc_id string, content binary")).collect()
    assert [tuple(r) for r in got] == [("fine", "Sales", "c", 5.0, "2001-03-31")]


def test_results_of_versions_have_one_type(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "7203_1.json").write_text('{"parser_version": 3, "sales": "1200.5", "eps": 4, "kind": "annual", "extra": [1]}\n')
    (tmp_path / "a" / "7203_2.json").write_text('{"parser_version": 2, "sales": 10, "eps": "n/a"}\nno json\n{"sales": 3}\n\n')
    (tmp_path / "a" / "9984_1.json").write_text('{"parser_version": 1, "sales": 1}\n')
    got = filings.results_of_versions(spark, str(tmp_path), (2, 3), {"sales": "double", "eps": "double", "kind": "string"})
    assert sorted(tuple(r) for r in got.collect()) == [("7203", 2, 10.0, None, None), ("7203", 3, 1200.5, 4.0, "annual")]


def test_a_code_listed_twice_takes_its_first_row(spark):
    stocks = spark.createDataFrame([("1", "old", "s", "m", "active", True, None)], "code string, name string, sector string, market string, status string, is_active boolean, exclusion_reason string")
    live = [("1", n, "s", "m") for n in "zyxbcdefg"] + [("2", "q", s, "m") for s in "zyxbcdefg"]
    for rows in (live, live[::-1]):
        got = tables.master_sync(stocks, spark.createDataFrame(rows, "code string, name string, sector string, market string"), least=1)
        assert sorted((r["code"], r["name"], r["sector"]) for r in got.collect()) == [("1", "b", "s"), ("2", "q", "b")]


def test_packed_results_keep_their_names(spark, tmp_path):
    rows = [("7203", "2026-06-25", 3, 5.0), ("130A", "2026-06-26", 3, 6.0), ("9999", "2026-06-27", 2, 7.0)]
    filings.land_packed(spark.createDataFrame(rows, "code string, submit_date string, parser_version int, sales double").coalesce(1), f"{tmp_path}/r")
    assert sorted((r["code"], r["sales"]) for r in filings.parsed_results(spark, f"{tmp_path}/r", 3, packed=True).collect()) == [("130A", 6.0), ("7203", 5.0)]
    got = filings.results_of_versions(spark, f"{tmp_path}/r", (2, 3), {"sales": "double"}, packed=True)
    assert sorted(tuple(r) for r in got.collect()) == [("130A", 3, 6.0), ("7203", 3, 5.0), ("9999", 2, 7.0)]
