"""The registered queries in DuckDB's SQL, over the same views."""

from __future__ import annotations

from ..config import CASH_EXEMPT_SECTORS, PRESETS
from ..operators import scoring
from ..operators.filings import FIELDS, CONTEXTS, INTERIM_FIELDS, NON_CONSOLIDATED, RATIOS
from ..operators.quality import SCRUBS
from ..operators.splits import price_limit_sql
from ..sources.views import oracle

TODAY, SINCE = "2001-12-01", "1999-01-01"


def r(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({x} + 1e-7, {digits}) AS {name or x.split('.')[-1]}"


def rs(names: str, digits: int = 6) -> str:
    return ", ".join(r(n.strip(), digits) for n in names.split(","))


def _ewm(x: str, alpha: str) -> str:
    """The recursive average of x over rows numbered i, as a prefix sum."""
    return f"pow(1 - {alpha}, i) * sum(CASE WHEN i = 0 THEN 1.0 ELSE {alpha} END * {x} * pow(1 - {alpha}, -i)) OVER (PARTITION BY code ORDER BY i ROWS UNBOUNDED PRECEDING)"


def _rolling(x: str, n: int, f: str = "avg") -> str:
    w = f"(PARTITION BY code ORDER BY entry_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {w} = {n} THEN {f}({x}) OVER {w} END"


def _liquidity(bars: str) -> str:
    return f"""SELECT code, coalesce(avg(CASE WHEN place BETWEEN 1 AND 20 THEN yen END), 0.0) AS avg_trading_value_20d,
      CAST(CASE WHEN count(*) FILTER (place BETWEEN 1 AND 5) > 0 THEN count(*) FILTER (place BETWEEN 1 AND 5 AND (yen <= 0 OR volume <= 0 OR volume IS NULL)) ELSE 5 END AS BIGINT) AS zero_volume_days_5d,
      CAST(max(entry_date) AS VARCHAR) AS latest_trade_date, min(rnk) <= 5 AS is_recent_trade
    FROM (SELECT b.*, d.rnk, d.rnk - d.skip AS place FROM
        (SELECT code, entry_date, volume, coalesce(trading_value, volume * price, 0.0) AS yen FROM {bars}) b
      JOIN (SELECT entry_date, rnk, max(CASE WHEN rnk = 1 AND total >= 100 AND n_days >= 2 AND traded * 100.0 / n < 60 THEN 1 ELSE 0 END) OVER () AS skip FROM (
        SELECT entry_date, n, traded, row_number() OVER (ORDER BY entry_date DESC) AS rnk, sum(n) OVER () AS total, count(*) OVER () AS n_days FROM (
          SELECT entry_date, count(*) AS n, count(*) FILTER (coalesce(trading_value, volume * price, 0.0) > 0) AS traded FROM {bars} GROUP BY entry_date))) d USING (entry_date))
    GROUP BY code HAVING count(*) FILTER (place BETWEEN 1 AND 20) > 0"""



_JUMPS = f"""SELECT *, coalesce(p1 > 0 AND price > 0 AND abs(price - p1) > {price_limit_sql('p1')}, false)
      AND NOT (n > 3 AND h1 <> 0 AND h1 = h2) AS impossible FROM (
    SELECT *, CASE WHEN coalesce(p2 > 0 AND p1 > 0 AND abs(p1 - p2) >= 0.8 * {price_limit_sql('p2')}, false) THEN CASE WHEN p1 > p2 THEN 1 ELSE -1 END ELSE 0 END AS h1,
      CASE WHEN coalesce(p3 > 0 AND p2 > 0 AND abs(p2 - p3) >= 0.8 * {price_limit_sql('p3')}, false) THEN CASE WHEN p2 > p3 THEN 1 ELSE -1 END ELSE 0 END AS h2 FROM (
      SELECT *, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2, lag(price, 3) OVER w AS p3, lag(entry_date) OVER w AS prev_date, row_number() OVER w AS n
      FROM {{bars}} WINDOW w AS (PARTITION BY code ORDER BY entry_date)))"""

_K = "CAST(code AS BIGINT)"
_PARTS = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in scoring.PARTS.items())
_REASONS = f"""CASE WHEN status = 'delisted' THEN '上場廃止' WHEN price IS NULL THEN '市場データ取得不能'
    WHEN latest_trade_date IS NULL OR NOT is_recent_trade THEN 'データ鮮度不足 (取引停止)'
    WHEN zero_volume_days_5d IS NULL OR zero_volume_days_5d > 0 THEN '商い不成立'
    WHEN avg_trading_value_20d IS NULL OR avg_trading_value_20d < 30000 THEN '極小流動性トラップ'
    WHEN price < 1100 THEN '超低位ボロ株' WHEN net_assets <= 0 OR equity_ratio <= 0 THEN '構造的破綻 (債務超過)'
    WHEN equity_ratio IS NULL THEN '重要指標未開示/算出不能'
    WHEN sector NOT IN {CASH_EXEMPT_SECTORS!r} AND sales > 0 AND operating_cf / sales < -0.1 THEN '致命的キャッシュ枯渇' END"""
_MONEY = lambda x: f"format('{{:,.0f}}', round({x} + 1e-7))"
_PERCENT = lambda x: f"printf('%.1f', round({x} + 1e-7, 1))"
_DETAILS = f"""CASE WHEN status = 'delisted' THEN 'JPX 上場銘柄一覧に掲載がありません (上場廃止・整理等)'
    WHEN price IS NULL AND coalesce(starts_with(exclusion_reason, '市場データ提供なし'), false) THEN 'Yahoo Finance に株価データが提供されていません (PRO Market 等。30日ごとに再確認)'
    WHEN price IS NULL THEN '市場価格データ欠損 (OHLCV未取得)' WHEN latest_trade_date IS NULL THEN '最終取引日データ欠損'
    WHEN NOT is_recent_trade THEN '最終取引日 (' || latest_trade_date || ') が直近5営業日範囲外'
    WHEN zero_volume_days_5d IS NULL THEN '出来高時系列データ欠損' WHEN zero_volume_days_5d > 0 THEN '直近5営業日以内に出来高ゼロ日あり (' || zero_volume_days_5d || '日)'
    WHEN avg_trading_value_20d < 30000 THEN '20日平均売買代金不足 (' || {_MONEY('avg_trading_value_20d / 10000')} || '万円 < 3万円)'
    WHEN price < 1100 THEN '株価基準未満 (' || {_MONEY('price')} || '円 < 1,100円)' WHEN net_assets <= 0 THEN '純資産マイナス (' || {_MONEY('net_assets')} || '円)'
    WHEN equity_ratio <= 0 THEN '自己資本比率マイナス/ゼロ (' || {_PERCENT('equity_ratio')} || '% <= 0.0%)'
    WHEN equity_ratio IS NULL THEN '自己資本比率等の財務諸表データ未開示または欠損'
    WHEN sector NOT IN {CASH_EXEMPT_SECTORS!r} AND sales > 0 AND operating_cf / sales < -0.1 THEN '営業CFマージン大幅赤字 (' || {_PERCENT('operating_cf / sales * 100')} || '% < -10.0%)' END"""


def _valuation(src: str) -> str:
    return f"""SELECT * REPLACE (
      CASE WHEN price > 0 AND eps > 0 THEN price / eps ELSE per END AS per, CASE WHEN price > 0 AND bps > 0 THEN price / bps ELSE pbr END AS pbr,
      CASE WHEN price > 0 AND dps >= 0 THEN dps / price * 100 ELSE dividend_yield END AS dividend_yield,
      CASE WHEN price > 0 AND shares_outstanding > 0 THEN price * shares_outstanding ELSE market_cap END AS market_cap)
    FROM (SELECT * REPLACE (coalesce(eps, CASE WHEN shares_outstanding > 0 THEN net_profit / shares_outstanding END) AS eps,
      coalesce(bps, CASE WHEN shares_outstanding > 0 THEN net_assets / shares_outstanding END) AS bps) FROM {src})"""


_EQUITY = "coalesce(equity_ratio, CASE WHEN total_assets > 0 THEN net_assets / total_assets * 100 END, CASE WHEN debt_equity_ratio > 0 THEN 100 / (1 + debt_equity_ratio / 100) END)"
_STATUS = "CASE WHEN prev_net_profit < 0 AND net_profit > 0 THEN 'turnaround_black' WHEN prev_net_profit > 0 AND net_profit < 0 THEN 'turnaround_white' WHEN prev_net_profit < 0 AND net_profit < 0 AND net_profit > prev_net_profit THEN 'loss_shrinking' ELSE 'normal' END"
_GROWTH = "CASE WHEN prev_net_profit <> 0 THEN (net_profit - prev_net_profit) / abs(prev_net_profit) * 100 END"
_CLIP = "CASE WHEN per > 1000 THEN 1000.0 ELSE per END AS per, CASE WHEN equity_ratio < 0 THEN 0.0 WHEN equity_ratio > 100 THEN 100.0 ELSE equity_ratio END AS equity_ratio"


def _factor(basis: str) -> str:
    return f"(SELECT coalesce(product(s.ratio), 1.0) FROM splits s WHERE s.code = f.code AND s.ratio BETWEEN 0.02 AND 100 AND s.ratio <> 1 AND s.split_date > TRY_CAST(f.{basis} AS DATE))"


def _indicators(src: str) -> str:
    """All indicators of priced rows of src."""
    return f"""SELECT * FROM (
      SELECT *, (price - ma25) / ma25 * 100 AS ma_divergence,
        CAST(coalesce(ma25 > ma75, false) AS INT) + CAST(coalesce(price > ma25, false) AS INT) + CAST(coalesce(macd_hist > 0, false) AS INT) + CAST(coalesce(rsi_14 > 50, false) AS INT) AS trend_score,
        CASE WHEN macd_hist > 0 THEN 'Bullish' WHEN macd_hist < 0 THEN 'Bearish' ELSE 'Neutral' END AS macd_status FROM (
        SELECT *, CASE WHEN abs(macd - macd_signal) < 1e-9 * price THEN 0.0 ELSE macd - macd_signal END AS macd_hist,
          CASE WHEN i >= 29 THEN CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / l) END END AS rsi_14 FROM (
          SELECT *, {_ewm('macd', '0.2')} AS macd_signal FROM (
            SELECT *, e12 - e26 AS macd FROM (
              SELECT *, {_ewm('price', '(2.0/13)')} AS e12, {_ewm('price', '(2.0/27)')} AS e26, {_ewm('greatest(mv, 0.0)', '(1.0/14)')} AS g, {_ewm('greatest(-mv, 0.0)', '(1.0/14)')} AS l FROM (
                SELECT *, row_number() OVER (PARTITION BY code ORDER BY entry_date) - 1 AS i, coalesce(price - lag(price) OVER (PARTITION BY code ORDER BY entry_date), 0.0) AS mv,
                  {_rolling('price', 25)} AS ma25, {_rolling('price', 75)} AS ma75, {_rolling('price', 25, 'stddev_samp')} AS bb_sigma
                FROM {src} WHERE price > 0))))))"""


_NEAR = "(PARTITION BY code ORDER BY entry_date ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)"
_STOCK_JOIN = """SELECT s.code, coalesce(s.name, 'Unknown') AS name, coalesce(s.sector, 'Other') AS sector, s.market, s.status, s.exclusion_reason, b.entry_date, b.price, b.open, b.high, b.low, b.volume, b.trading_value"""
_F = "f.per, f.pbr, f.roe, f.dividend_yield, f.equity_ratio, f.debt_equity_ratio, f.sales, f.net_profit, f.prev_net_profit, f.operating_income, f.operating_margin, f.operating_cf, f.net_assets, f.total_assets, f.shares_outstanding, f.eps, f.bps, f.dps, f.payout_ratio, f.market_cap, f.sales_growth"

MORE = {
    "lastbar": "SELECT * FROM {bars} QUALIFY row_number() OVER (PARTITION BY code ORDER BY entry_date DESC) = 1",
    "snap": _STOCK_JOIN + f", {_F} FROM {{stocks}} s LEFT JOIN {{lastbar}} b ON s.code = b.code LEFT JOIN {{fundamentals}} f ON s.code = f.code",
    "valued": _valuation("(SELECT * REPLACE (" + _EQUITY + " AS equity_ratio) FROM {snap})"),
    "fixed": f"SELECT * REPLACE ({_CLIP}), {_STATUS} AS turnaround_status, {_GROWTH} AS profit_growth_raw FROM {{valued}}",
    "liq": _liquidity("{bars}"),
    "filtered": f"SELECT f.*, l.* EXCLUDE (code), {_REASONS} AS filter_reason, {_DETAILS} AS filter_detail FROM {{fixed}} f LEFT JOIN {{liq}} l ON f.code = l.code",
    "inputs": f"""SELECT * REPLACE (CAST(({_K} * 7 % 60) - 12.5 AS DOUBLE) AS roe, CAST(({_K} * 13 % 90) / 20.0 - 0.2 AS DOUBLE) AS pbr, CAST(({_K} * 17 % 120) / 2.0 - 3 AS DOUBLE) AS per,
        CAST(CASE WHEN {_K} % 9 = 0 THEN NULL ELSE ({_K} * 29 % 115) - 5.0 END AS DOUBLE) AS equity_ratio, CAST(CASE WHEN {_K} % 8 = 0 THEN NULL ELSE ({_K} * 3 % 66) / 10.0 END AS DOUBLE) AS dividend_yield),
        CAST(CASE WHEN {_K} % 10 = 0 THEN NULL ELSE ({_K} * 5 % 41) / 5.0 - 4 END AS DOUBLE) AS macd_hist, CAST(CASE WHEN {_K} % 11 = 0 THEN 50.0 ELSE ({_K} * 19 % 200) / 2.0 END AS DOUBLE) AS rsi_14,
        CAST(CASE WHEN {_K} % 11 = 0 THEN 0.0 ELSE ({_K} * 23 % 140) / 2.0 - 35 END AS DOUBLE) AS ma_divergence FROM {{fixed}}""",
    "parts": f"SELECT *, {_PARTS} FROM (SELECT *, CASE WHEN macd_hist > 0 THEN 'Bullish' WHEN macd_hist < 0 THEN 'Bearish' WHEN macd_hist = 0 THEN 'Neutral' END AS macd_status FROM {{inputs}})",
    "scored": f"SELECT *, CAST({scoring.total(PRESETS['balanced'])} AS DOUBLE) AS quant_score FROM {{parts}}",
    "graded": f"SELECT *, {scoring.verdict()} AS verdict, {scoring.verdict('legacy')} AS legacy_verdict FROM {{scored}}",
    "jumps": _JUMPS,
    "inferred": """SELECT code, entry_date AS split_date, CASE WHEN q >= 1 THEN w ELSE 1 / w END AS ratio FROM (
        SELECT *, p1 / price AS q, greatest(p1 / price, price / p1) AS x, round_even(greatest(p1 / price, price / p1), 0) AS w FROM {jumps} WHERE impossible)
        WHERE x >= 1.9 AND entry_date - prev_date <= 7 AND w BETWEEN 0.02 AND 100 AND w <> 1 AND abs(x / w - 1) <= 0.05""",
    "found": """SELECT code, split_date, ratio, min_by(jump_date, (err, jump_date)) AS jump_date FROM (
        SELECT e.*, j.entry_date AS jump_date, abs(ln(j.p1 / j.price) - ln(e.ratio)) AS err FROM {events_split} e JOIN {jumps} j ON e.code = j.code AND j.impossible
        AND j.entry_date BETWEEN e.split_date - 14 AND e.split_date + 5 WHERE e.ratio BETWEEN 0.02 AND 100 AND e.ratio <> 1 AND abs(ln(e.ratio)) >= ln(1.9)) WHERE err <= 0.12 GROUP BY code, split_date, ratio""",
    "cleaned": f"""SELECT code, entry_date, CASE WHEN coalesce(p / lag(p) OVER w > 5 OR p / lag(p) OVER w < 0.2, false) THEN NULL ELSE p END AS price, open, high, low, CASE WHEN volume < 0 THEN 0 ELSE volume END AS volume, trading_value FROM (
        SELECT *, CASE WHEN coalesce(q / m > 5 OR q / m < 0.2 OR q / a > 20 OR q / a < 0.05, false) THEN NULL ELSE q END AS p FROM (
          SELECT *, CASE WHEN count(q) OVER {_NEAR} >= 5 THEN median(q) OVER {_NEAR} END AS m, median(q) OVER (PARTITION BY code) AS a FROM (
            SELECT *, CASE WHEN price > 0 THEN price END AS q FROM {{bars}}))) WINDOW w AS (PARTITION BY code ORDER BY entry_date)""",
    "ind": _indicators("{bars}"),
    "index2": r"""SELECT doc_id, code, doc_type IN ('120', '130') AS is_annual, period_end, submitted FROM (
        SELECT doc_id, doc_type, submitted, CASE WHEN regexp_full_match(substr(trim(sec_code), 1, 4), '[0-9A-Za-z]{4}') AND substr(trim(sec_code), 1, 4) <> '0000' THEN substr(trim(sec_code), 1, 4) END AS code,
          coalesce(nullif(substr(period_end, 1, 10), ''), replace(list_extract(regexp_extract_all(description, '(\d{4}/\d{2}/\d{2})'), -1), '/', '-'), '') AS period_end FROM {doc_index})""",
    "s_ind": _indicators("{cleaned}"),
    "s_last": "SELECT * FROM {s_ind} WHERE isodow(entry_date) < 6 QUALIFY row_number() OVER (PARTITION BY code ORDER BY entry_date DESC) = 1",
    "s_fund": f"""SELECT * EXCLUDE (p, q) REPLACE (eps / p AS eps, bps / p AS bps, dps / p AS dps, shares_outstanding * q AS shares_outstanding) FROM (
        SELECT f.*, {_factor('submitted_at')} AS p, {_factor('bs_submitted_at')} AS q FROM {{fundamentals}} f, (SELECT 1 FROM {{splits}} LIMIT 1))""",
    "s_snap": _STOCK_JOIN + f", b.rsi_14, b.macd_hist, b.ma_divergence, b.macd_status, {_F} FROM {{stocks}} s LEFT JOIN {{s_last}} b ON s.code = b.code LEFT JOIN {{s_fund}} f ON s.code = f.code",
    "s_fixed": "SELECT * REPLACE (" + _CLIP + ") FROM (" + _valuation("(SELECT * REPLACE (" + _EQUITY + " AS equity_ratio) FROM {s_snap})") + ")",
    "s_filtered": f"SELECT f.*, l.* EXCLUDE (code), {_REASONS} AS filter_reason, {_PARTS} FROM {{s_fixed}} f LEFT JOIN {{liq}} l ON f.code = l.code",
    "s_scored": f"SELECT *, CAST({scoring.total(PRESETS['balanced'])} AS DOUBLE) AS quant_score FROM {{s_filtered}}",
    "seedrows": "SELECT *, period_end AS bs_period_end, submit_date AS submitted_at, submit_date AS bs_submitted_at, CAST(NULL AS DOUBLE) AS sales_growth FROM {results}",
    "sane": """SELECT * REPLACE (CASE WHEN few OR off THEN NULL ELSE eps END AS eps, CASE WHEN few OR off THEN NULL ELSE bps END AS bps, CASE WHEN few OR off THEN NULL ELSE dps END AS dps,
        CASE WHEN few THEN NULL ELSE shares_outstanding END AS shares_outstanding, CASE WHEN equity_ratio BETWEEN -1000 AND 100 THEN equity_ratio END AS equity_ratio) FROM (
        SELECT *, coalesce(shares_outstanding < 1000, false) AS few, NOT coalesce(shares_outstanding < 1000, false) AND coalesce(abs(net_assets / (shares_outstanding * nullif(bps, 0))) NOT BETWEEN 0.001 AND 1000, false) AS off FROM {results})""",
    "kinds": f"""SELECT doc_id, CASE WHEN bool_or(starts_with(context, 'CurrentYearDuration')) THEN 'annual' WHEN bool_or(starts_with(context, 'InterimDuration')) THEN 'interim' END AS kind,
        bool_or(ends_with(element, 'SummaryOfBusinessResults') AND NOT ends_with(context, '{NON_CONSOLIDATED}') AND value IS NOT NULL) AS consolidated FROM {{facts}} GROUP BY doc_id""",
}


def _prio() -> str:
    rows = []
    for field, period, tags, own in FIELDS:
        for kind, ctx in CONTEXTS.items():
            if period not in ctx or kind == "interim" and field not in INTERIM_FIELDS:
                continue
            for consolidated in (True, False):
                names = [ctx[period] + ("" if consolidated else NON_CONSOLIDATED)] + ([ctx[period] + NON_CONSOLIDATED] if own and consolidated else [])
                rows += [f"('{field}','{kind}',{consolidated},'{t}','{c}',{100 * i + j})" for i, c in enumerate(names) for j, t in enumerate(tags)]
    return ",".join(rows)


def _newer(period: str, filed: str) -> str:
    return f"""coalesce(nullif(s.{period}, '') IS NOT NULL AND (nullif(f.{period}, '') IS NULL OR s.{period} > f.{period}
        OR (s.{period} = f.{period} AND substr(coalesce(s.{filed}, ''), 1, 16) >= substr(coalesce(f.{filed}, ''), 1, 16))), false)"""


_PLN, _BSN = _newer("period_end", "submitted_at"), _newer("bs_period_end", "bs_submitted_at")
_take = lambda ok, c: f"CASE WHEN {ok} AND s.{c} IS NOT NULL THEN s.{c} ELSE f.{c} END"
_A_OK = "(a.period_end IS NOT NULL AND NOT coalesce(a.period_end < nullif(f.period_end, ''), false))"
_A_BS = f"({_A_OK} AND NOT coalesce(a.period_end < nullif(f.bs_period_end, ''), false))"
_upd = lambda ok, v, c: f"CASE WHEN {ok} THEN coalesce({v}, f.{c}) ELSE f.{c} END AS {c}"
_scrubbed = "text"
for _p, _put in SCRUBS:
    _scrubbed = f"regexp_replace({_scrubbed}, '{_p.replace(chr(39), chr(39) * 2)}', '{_put.replace('$1', chr(92) + '1')}', 'g')"
_text = lambda c: f"coalesce(CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END, 'NaN')"
_APPLIED = """SELECT b.code, b.entry_date, CASE WHEN j.jump_date IS NOT NULL AND b.entry_date < j.jump_date THEN b.price / j.ratio ELSE b.price END AS price,
    CASE WHEN j.jump_date IS NOT NULL AND b.entry_date < j.jump_date THEN b.volume * j.ratio ELSE CAST(b.volume AS DOUBLE) END AS volume FROM {bars} b LEFT JOIN (
    SELECT f.* FROM {found} f JOIN (SELECT code, min(split_date) AS split_date FROM {events_split} GROUP BY code) m USING (code, split_date)) j ON b.code = j.code"""

_SQL = {
    "src_bars": f"SELECT code, entry_date, {rs('open, high, low, price')}, volume FROM {{bars}} WHERE volume % 7 <> 0",
    "src_listing": """SELECT CAST(1000 + c_custkey % 700 AS VARCHAR) AS code, c_name AS name, c_mktsegment AS sector,
        CASE c_custkey % 4 WHEN 0 THEN 'Prime' WHEN 1 THEN 'Standard' WHEN 2 THEN 'Unknown' ELSE 'Other' END AS market
        FROM {customer} WHERE c_custkey % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY c_custkey % 700 ORDER BY c_custkey) = 1""",
    "src_code_map": """SELECT 'E' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS filer, CASE WHEN length(s) = 5 THEN substr(s, 1, 4) ELSE s END AS code FROM (
        SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN CAST(1000 + c_custkey AS VARCHAR) || '0' ELSE CAST(1000 + c_custkey AS VARCHAR) END AS s FROM {customer} WHERE c_custkey % 3 <> 0)""",
    "src_doc_index": "SELECT i.* FROM {index2} i JOIN {doc_index} d USING (doc_id) WHERE d.doc_type <> '140' AND code IS NOT NULL",
    "doc_period": "SELECT doc_id, code, period_end FROM {index2}",
    "select_docs": """WITH i AS (SELECT i.* FROM {index2} i JOIN {doc_index} d USING (doc_id) WHERE d.doc_type <> '140' AND code IS NOT NULL),
        top AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY code, is_annual ORDER BY period_end DESC, submitted DESC, doc_id) = 1),
        a AS (SELECT * FROM top WHERE is_annual AND coalesce(TRY_CAST(period_end AS DATE) >= DATE '2001-06-30' - 480, true))
        SELECT * FROM a UNION ALL SELECT t.* FROM top t LEFT JOIN a USING (code) WHERE NOT t.is_annual AND (a.period_end IS NULL OR t.period_end > a.period_end)""",
    "scan_recent": f"SELECT code, entry_date, {r('price')}, volume FROM {{bars}} WHERE entry_date >= DATE '{TODAY}' - 200 AND code IN (SELECT code FROM {{stocks}} WHERE market = 'ASIA')",
    "scan_history": f"SELECT code, entry_date, {r('nullif(open, 0)', name='open')}, {r('nullif(high, 0)', name='high')}, {r('nullif(low, 0)', name='low')}, {r('price')}, volume FROM {{bars}} WHERE entry_date >= DATE '{TODAY}' - 372",
    "scan_active": "SELECT code, name, status FROM {stocks} WHERE is_active IS NOT FALSE",
    "lookup_status": "SELECT entry_date, count(DISTINCT code) AS n_codes FROM {bars} GROUP BY entry_date",
    "scan_calendar": f"SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(min(entry_date), max(entry_date), INTERVAL 1 DAY)) AS d FROM {{bars}}) WHERE isodow(d) < 6 AND d BETWEEN DATE '{SINCE}' AND DATE '{TODAY}'",
    "upsert_partial": f"SELECT coalesce(t.code, s.code) AS code, coalesce(t.entry_date, s.entry_date) AS entry_date, {r('CASE WHEN s.code IS NOT NULL THEN s.price * 2 ELSE t.price END', name='price')}, t.volume FROM {{old_bars}} t FULL JOIN (SELECT * FROM {{new_bars}} WHERE volume % 3 = 0) s ON t.code = s.code AND t.entry_date = s.entry_date",
    "upsert_replace": f"SELECT coalesce(s.code, t.code) AS code, coalesce(s.entry_date, t.entry_date) AS entry_date, {r('CASE WHEN s.code IS NOT NULL THEN s.price ELSE t.price END', name='price')}, coalesce(s.volume, t.volume) AS volume FROM {{old_bars}} t FULL JOIN {{new_bars}} s ON t.code = s.code AND t.entry_date = s.entry_date",
    "upsert_ignore": "SELECT DISTINCT entry_date FROM (SELECT entry_date FROM {old_bars} UNION ALL SELECT entry_date FROM {new_bars})",
    "alerts_open": "SELECT event_id AS alert_id, lpad(CAST(user_id AS VARCHAR), 8, '0') AS code, event_type AS alert_type FROM {events} WHERE event_type <> 'error' AND event_id % 4 <> 0",
    "normalize_bars": f"SELECT code, entry_date, {r('price')}, CASE WHEN volume % 5 = 0 THEN 0 ELSE volume END AS volume FROM {{bars}}",
    "conform_schema": f"SELECT code, entry_date, {r('price')}, volume, CAST(NULL AS VARCHAR) AS macd_status, CAST(NULL AS INTEGER) AS trend_score FROM {{bars}}",
    "union_diagonal": f"SELECT code, entry_date, {r('price')}, volume, {r('trading_value')} FROM (SELECT code, entry_date, price, volume, CAST(NULL AS DOUBLE) AS trading_value FROM {{old_bars}} WHERE volume > 50 UNION ALL SELECT code, entry_date, price, NULL, trading_value FROM {{bars_ev}})",
    "weekday_guard": f"SELECT code, entry_date, {r('price')} FROM {{bars}} WHERE isodow(entry_date) < 6",
    "purge_weekend": f"SELECT code, entry_date, {r('price')} FROM {{bars_ev}} WHERE dayofweek(entry_date) NOT IN (0, 6)",
    "drop_unsettled": f"SELECT code, entry_date, {r('price')} FROM {{bars_ev}} WHERE entry_date <> DATE '2024-01-30'",
    "select_targets": f"SELECT code FROM {{stocks}} WHERE is_active IS NOT FALSE AND NOT coalesce(excluded_until > '{TODAY}', false)",
    "pending_docs": "SELECT doc_id FROM {doc_index} WHERE CAST(substr(doc_id, 2) AS INT) % 3 <> 0",
    "join_master": f"SELECT s.code, coalesce(s.name, 'Unknown') AS name, coalesce(s.sector, 'Other') AS sector, s.market, b.entry_date, {r('b.price')} FROM {{stocks}} s LEFT JOIN (SELECT * FROM {{bars}} WHERE volume > 20 QUALIFY row_number() OVER (PARTITION BY code ORDER BY entry_date DESC) = 1) b ON s.code = b.code",
    "join_fundamentals": f"SELECT code, name, {rs('price, sales, net_assets, shares_outstanding')} FROM {{snap}}",
    "liquidity_metrics": f"SELECT code, {r('avg_trading_value_20d')}, zero_volume_days_5d, latest_trade_date, is_recent_trade FROM {{liq}}",
    "liquidity_events": f"SELECT code, {r('avg_trading_value_20d')}, zero_volume_days_5d, latest_trade_date, is_recent_trade FROM ({_liquidity('{bars_ev}')})",
    "adjust_mismatch": f"SELECT code, {r('max(abs(x - 1))', name='off')}, max(abs(x - 1)) > 0.005 AS mismatch FROM (SELECT o.code, o.price / n.price AS x FROM {{old_bars}} o JOIN {{new_bars}} n ON o.code = n.code AND o.entry_date = n.entry_date WHERE o.price > 0 AND n.price > 0) GROUP BY code",
    "split_factor": f"SELECT f.code, f.submitted_at AS basis_date, {r(_factor('submitted_at'), name='factor')} FROM {{fundamentals}} f, (SELECT 1 FROM {{splits}} LIMIT 1)",
    "split_jump": f"SELECT code, split_date, {r('ratio')}, jump_date FROM {{found}}",
    "latest_bar": f"SELECT code, entry_date, {r('price')}, volume FROM {{lastbar}}",
    "latest_batch": f"SELECT b.code, b.entry_date, {r('b.price')}, s.name, {r('f.sales')} FROM {{lastbar}} b JOIN {{stocks}} s ON b.code = s.code LEFT JOIN {{fundamentals}} f ON b.code = f.code",
    "restore_missing": f"SELECT f.code, {r('coalesce(f.equity_ratio, s.equity_ratio, 33.0)', name='equity_ratio')}, {r('coalesce(f.eps, s.eps)', name='eps')}, {r('coalesce(f.bps, s.bps)', name='bps')} FROM {{fundamentals}} f LEFT JOIN {{results}} s ON f.code = s.code",
    "assemble_seed": f"SELECT code, {rs('sales, equity_ratio')} FROM (SELECT coalesce(p.code, f.code) AS code, coalesce(p.sales, f.sales) AS sales, coalesce(p.equity_ratio, f.equity_ratio) AS equity_ratio FROM (SELECT * FROM {{results}} WHERE kind = 'annual') p FULL JOIN {{fundamentals}} f ON p.code = f.code) WHERE code IN (SELECT code FROM {{stocks}} WHERE status = 'active')",
    "backfill_growth": f"SELECT code, {r('sales / 1e6', name='sales_growth')} FROM {{fundamentals}}",
    "refresh_seed": f"""SELECT f.code, {', '.join(r(_take(_PLN, c), name=c) for c in ('sales', 'net_profit', 'eps', 'roe'))}, {', '.join(r(_take(_BSN, c), name=c) for c in ('net_assets', 'equity_ratio'))},
        {_take(_PLN, 'period_end')} AS period_end, {_take(_BSN, 'bs_period_end')} AS bs_period_end, {r(f'CASE WHEN {_PLN} AND s.sales IS NOT NULL THEN s.sales_growth ELSE f.sales_growth END', name='sales_growth')}
        FROM {{fundamentals}} f LEFT JOIN {{seedrows}} s ON f.code = s.code""",
    "bridge_filings": f"""WITH m AS (SELECT f.code, {_upd(_A_OK, 'a.sales', 'sales')}, {_upd(_A_BS, 'a.net_assets', 'net_assets')}, {_upd(_A_BS, 'a.total_assets', 'total_assets')},
          {_upd(_A_BS, 'coalesce(a.equity_ratio, CASE WHEN a.total_assets > 0 THEN a.net_assets / a.total_assets * 100 END)', 'equity_ratio')},
          {_upd(_A_OK, 'coalesce(a.roe, CASE WHEN a.net_assets > 0 THEN a.net_profit / a.net_assets * 100 END)', 'roe')},
          coalesce(CASE WHEN {_A_OK} AND a.sales > 0 THEN a.operating_income / a.sales * 100 END, f.operating_margin) AS operating_margin,
          {_upd(_A_BS, 'a.shares_outstanding', 'shares_outstanding')}, {_upd(_A_OK, 'a.eps', 'eps')}, {_upd(_A_BS, 'a.bps', 'bps')},
          CASE WHEN {_A_OK} THEN a.period_end ELSE f.period_end END AS period_end, CASE WHEN {_A_BS} THEN a.period_end ELSE f.bs_period_end END AS bs_period_end,
          CASE WHEN {_A_OK} AND coalesce(abs(a.sales - f.sales) > 1e-9 * greatest(abs(a.sales), abs(f.sales), 1.0), false) THEN NULL ELSE f.sales_growth END AS sales_growth,
          CASE WHEN {_A_OK} THEN 'success' WHEN a.period_end IS NOT NULL THEN 'superseded' END AS annual_status
          FROM {{fundamentals}} f LEFT JOIN (SELECT * FROM {{sane}} WHERE kind = 'annual') a ON f.code = a.code),
        n AS (SELECT m.*, i.period_end AS ipe, i.net_assets AS ina, i.total_assets AS ita, i.equity_ratio AS ier, i.shares_outstanding AS iso,
          i.period_end IS NOT NULL AND NOT coalesce(i.period_end < nullif(m.bs_period_end, ''), false) AND NOT coalesce(i.period_end <= nullif(m.period_end, ''), false) AS ok
          FROM m LEFT JOIN (SELECT * FROM {{sane}} WHERE kind = 'interim') i ON m.code = i.code)
        SELECT code, {r('sales')}, {r('CASE WHEN ok THEN coalesce(ina, net_assets) ELSE net_assets END', name='net_assets')},
          {r('CASE WHEN ok THEN coalesce(ier, CASE WHEN ita > 0 THEN ina / ita * 100 END, equity_ratio) ELSE equity_ratio END', name='equity_ratio')}, {r('roe')}, {r('operating_margin')},
          {r('CASE WHEN ok THEN coalesce(iso, shares_outstanding) ELSE shares_outstanding END', name='shares_outstanding')}, {r('eps')}, {r('bps')}, period_end,
          CASE WHEN ok THEN ipe ELSE bs_period_end END AS bs_period_end, {r('sales_growth')}, annual_status, CASE WHEN ok THEN 'success' WHEN ipe IS NOT NULL THEN 'superseded' END AS interim_status FROM n""",
    "filing_kind": "SELECT * FROM {kinds} WHERE kind IS NOT NULL",
    "filing_fields": f"""WITH p(field, kind, consolidated, element, context, prio) AS (VALUES {_prio()}),
        b AS (SELECT f.doc_id, p.field, min_by(f.value, p.prio) AS v FROM {{facts}} f JOIN {{kinds}} k ON f.doc_id = k.doc_id AND k.kind IS NOT NULL JOIN p ON p.kind = k.kind AND p.consolidated = k.consolidated AND p.element = f.element AND p.context = f.context WHERE f.value IS NOT NULL GROUP BY f.doc_id, p.field)
        SELECT k.doc_id, k.kind, {', '.join(r(f"max(CASE WHEN field = '{n}' THEN v * {100 if n in RATIOS else 1} END)", name=n) for n in ('sales', 'net_profit', 'prev_net_profit', 'total_assets', 'net_assets', 'equity_ratio', 'dps', 'shares_outstanding', 'operating_income'))}
        FROM {{kinds}} k LEFT JOIN b ON k.doc_id = b.doc_id WHERE k.kind IS NOT NULL GROUP BY k.doc_id, k.kind""",
    "filing_sanity": f"SELECT code, {rs('eps, bps, dps, shares_outstanding, equity_ratio')} FROM {{sane}}",
    "profile_history": "SELECT count(*) AS n_rows, count(DISTINCT code) AS n_codes, count(DISTINCT entry_date) AS n_days, min(entry_date) AS first_day, max(entry_date) AS last_day FROM {bars}",
    "profile_nulls": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n_filled, {r(f'count({c}) / count(*)', name='share')} FROM {{fundamentals}}" for c in ("roe", "equity_ratio", "eps", "pbr", "dps", "sales_growth", "total_assets")),
    "integrity_check": """SELECT 'stocks' AS "check", count(*) AS value, count(*) >= 1000 AS ok FROM {stocks} UNION ALL SELECT 'fundamentals', count(*), count(*) >= 1000 FROM {fundamentals}
        UNION ALL SELECT 'days', count(DISTINCT entry_date), count(DISTINCT entry_date) >= 20 FROM {bars}""",
    "null_policy": """SELECT sector, c AS "column", n AS n_unexpected FROM (
        SELECT sector, c, count(*) FILTER (v IS NULL) AS n FROM (""" + " UNION ALL ".join(f"SELECT coalesce(s.sector, 'Other') AS sector, '{c}' AS c, f.{c} AS v FROM {{stocks}} s LEFT JOIN {{fundamentals}} f ON s.code = f.code" for c in ("equity_ratio", "roe", "dps")) + """) GROUP BY sector, c)
        WHERE n > 0 AND NOT (c = 'equity_ratio' AND sector IN (SELECT n_name FROM {nation} WHERE n_nationkey % 2 = 0))""",
    "contract_check": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_bad FROM {{graded}}" for c in ("code", "price", "verdict", "equity_ratio")) + " UNION ALL SELECT 'not_there', count(*) FROM {graded}",
    "scrub_text": f"SELECT doc_id, md5({_scrubbed}) AS scrubbed FROM {{documents}}".replace("{32,}", "{{32,}}").replace("{{32,}}", "{32,}"),
    "parity_diff": """SELECT code, d AS difference FROM (SELECT coalesce(a.code, b.code) AS code, CASE WHEN a.code IS NULL THEN 'missing' WHEN b.code IS NULL THEN 'extra'
        ELSE concat_ws(',', CASE WHEN a.n IS DISTINCT FROM b.n THEN 'n' END, CASE WHEN a.last IS DISTINCT FROM b.last THEN 'last' END) END AS d
        FROM (SELECT code, count(*) AS n, max(entry_date) AS last FROM {old_bars} GROUP BY code) a FULL JOIN (SELECT code, count(*) FILTER (entry_date < DATE '2001-08-01') AS n, max(entry_date) AS last FROM {bars} GROUP BY code) b ON a.code = b.code) WHERE d <> ''""",
    "text_numbers": "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS DOUBLE) * 1000 WHEN 1 THEN c_custkey + 0.5 END AS number FROM {customer}",
    "date_normalize": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM {orders}",
    "tech_ma_bb": f"SELECT code, entry_date, {rs('ma25, ma75, bb_sigma', 4)}, {r('ma25 + 2 * bb_sigma', 4, 'bb_p2sig')}, {r('ma25 - bb_sigma', 4, 'bb_m1sig')} FROM {{ind}}",
    "tech_rsi": f"SELECT code, entry_date, {r('rsi_14', 4)} FROM {{ind}}",
    "tech_macd": f"SELECT code, entry_date, {rs('macd, macd_signal, macd_hist', 4)}, macd_status FROM {{ind}}",
    "tech_trend": f"SELECT code, entry_date, {r('ma_divergence', 4)}, CAST(trend_score AS INTEGER) AS trend_score, CAST(trend_score AS INTEGER) AS trend_signal, {r('CASE WHEN trend_score >= 3 THEN 1.0 ELSE 0.0 END', 4, 'trend_up')}, {r('trading_value', 4)} FROM {{ind}} WHERE isodow(entry_date) < 6",
    "clean_prices": f"SELECT code, entry_date, {r('price')}, volume FROM {{cleaned}}",
    "tech_sma_rsi": f"""SELECT code, entry_date, {r('coalesce(CASE WHEN l = 0 THEN CASE WHEN g = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + g / l) END, 50.0)', 4, 'rsi_sma')} FROM (
        SELECT code, entry_date, {_rolling('up', 14)} AS g, {_rolling('dn', 14)} AS l FROM (SELECT *, CASE WHEN mv IS NOT NULL THEN greatest(mv, 0.0) ELSE 0.0 END AS up, CASE WHEN mv IS NOT NULL THEN greatest(-mv, 0.0) ELSE 0.0 END AS dn FROM (SELECT code, entry_date, price - lag(price) OVER (PARTITION BY code ORDER BY entry_date) AS mv FROM {{bars}} WHERE price > 0)))""",
    "volume_ratio": f"SELECT code, entry_date, {r('volume / m', name='volume_ratio')} FROM (SELECT *, {_rolling('volume', 25)} AS m FROM {{bars}} WHERE price > 0)",
    "hist_vol": f"SELECT code, count(*) AS n_rows, {r('CASE WHEN count(*) >= 20 THEN stddev_samp(x) * sqrt(252.0) * 100 END', name='volatility')} FROM (SELECT code, ln(price / lag(price) OVER (PARTITION BY code ORDER BY entry_date)) AS x FROM {{bars}} WHERE price > 0) GROUP BY code",
    "price_limit": f"SELECT code, entry_date, {r(price_limit_sql('price'), name='most_change')} FROM {{bars}}",
    "impossible_jump": "SELECT code, entry_date, impossible FROM {jumps}",
    "infer_splits": f"SELECT code, split_date, {r('ratio')} FROM {{inferred}}",
    "apply_split": f"SELECT code, entry_date, {rs('price, volume')} FROM ({_APPLIED})",
    "load_plan": """SELECT code, last_date, n_rows, CASE WHEN last_date IS NULL OR n_rows < 20 THEN '1y' WHEN need <= 2 THEN '2d' WHEN need <= 5 THEN '5d' WHEN need <= 10 THEN '10d' WHEN need <= 21 THEN '21d' ELSE '1y' END AS period FROM (
        SELECT c.code, b.last_date, coalesce(b.n, 0) AS n_rows, 1 + len(list_filter(generate_series(b.last_date + 1, DATE '2001-11-06', INTERVAL 1 DAY), lambda x: isodow(x) < 6)) AS need
        FROM (SELECT lpad(CAST(s_suppkey * 2 AS VARCHAR), 8, '0') AS code FROM {supplier}) c LEFT JOIN (SELECT code, max(entry_date) AS last_date, count(*) AS n FROM {bars} GROUP BY code) b ON c.code = b.code)""",
    "merge_history": f"SELECT coalesce(n.code, o.code) AS code, coalesce(n.entry_date, o.entry_date) AS entry_date, {r('CASE WHEN n.code IS NOT NULL THEN n.price ELSE o.price END', name='price')}, coalesce(n.volume, o.volume) AS volume FROM {{old_bars}} o FULL JOIN {{new_bars}} n ON o.code = n.code AND o.entry_date = n.entry_date",
    "route_history": f"""WITH flag AS (SELECT o.code FROM {{old_bars}} o JOIN {{new_bars}} n ON o.code = n.code AND o.entry_date = n.entry_date GROUP BY o.code HAVING max(abs(o.price / n.price - 1)) > 0.005),
        again AS (SELECT code, entry_date, price * 0.5 AS price, volume FROM {{bars}} WHERE CAST(code AS BIGINT) % 12 = 0 AND code IN (SELECT code FROM flag)),
        merged AS (SELECT coalesce(n.code, o.code) AS code, coalesce(n.entry_date, o.entry_date) AS entry_date, CASE WHEN n.code IS NOT NULL THEN n.price ELSE o.price END AS price, coalesce(n.volume, o.volume) AS volume FROM {{old_bars}} o FULL JOIN {{new_bars}} n ON o.code = n.code AND o.entry_date = n.entry_date)
        SELECT code, entry_date, {r('price')}, volume FROM (SELECT * FROM again UNION ALL SELECT * FROM merged WHERE code NOT IN (SELECT code FROM again)) WHERE entry_date >= DATE '{SINCE}'""",
    "repair_equity": f"SELECT code, {r(_EQUITY, name='equity_ratio')} FROM {{fundamentals}}",
    "repair_valuation": f"SELECT code, {rs('eps, bps, per, pbr, dividend_yield, market_cap')} FROM ({_valuation('{snap}')})",
    "profit_status": f"SELECT code, {_STATUS} AS turnaround_status, ({_STATUS}) = 'turnaround_black' AS is_turnaround, {r(_GROWTH, name='profit_growth_raw')} FROM {{fundamentals}}",
    "repair_clip": f"SELECT code, {rs('per, equity_ratio')} FROM (SELECT code, {_CLIP} FROM {{valued}})",
    "split_adjust_fund": f"SELECT code, {r('eps / p', name='eps')}, {r('bps / p', name='bps')}, {r('dps / p', name='dps')}, {r('shares_outstanding * q', name='shares_outstanding')} FROM (SELECT f.*, {_factor('submitted_at')} AS p, {_factor('bs_submitted_at')} AS q FROM {{fundamentals}} f, (SELECT 1 FROM {{splits}} LIMIT 1))",
    "prefilter_all": "SELECT code, filter_reason, filter_detail FROM {filtered}",
    "prefilter_passed": f"SELECT code, {rs('price, avg_trading_value_20d')} FROM {{filtered}} WHERE filter_reason IS NULL",
    "prefilter_rejected": "SELECT code, filter_reason FROM {filtered} WHERE filter_reason IS NOT NULL",
    "reason_counts": "SELECT filter_reason, count(*) AS n FROM {filtered} GROUP BY filter_reason",
    "score_roe": f"SELECT code, {r('score_roe')} FROM {{parts}}",
    "score_value": f"SELECT code, {rs('score_pbr, score_per')} FROM {{parts}}",
    "score_safety": f"SELECT code, {r('score_equity')} FROM {{parts}}",
    "score_dividend": f"SELECT code, {r('score_dividend')} FROM {{parts}}",
    "score_tech": f"SELECT code, {rs('score_macd, score_rsi, score_divergence')} FROM {{parts}}",
    "quant_score": f"SELECT code, {r('quant_score')} FROM {{scored}}",
    "grade": "SELECT code, verdict, legacy_verdict FROM {graded}",
    "grade_counts": "SELECT verdict, count(*) AS n FROM {graded} GROUP BY verdict",
    "grade_map": "SELECT code, CASE legacy_verdict WHEN 'STRONG_BUY' THEN 'Grade S' WHEN 'BUY' THEN 'Grade A' WHEN 'WATCH' THEN 'Grade B' WHEN 'PASS' THEN 'Grade C' END AS grade FROM {graded}",
    "score_by_preset": " UNION ALL ".join(f"SELECT code, preset, {r('quant_score')}, {scoring.verdict()} AS verdict FROM (SELECT *, '{k}' AS preset, CAST({scoring.total(w)} AS DOUBLE) AS quant_score FROM {{parts}})" for k, w in PRESETS.items()),
    "top_candidates": f"SELECT code, {r('quant_score')}, verdict FROM (SELECT *, bool_or(verdict IN ('Grade S', 'Grade A')) OVER () AS any_top FROM {{graded}}) t WHERE verdict IN ('Grade S', 'Grade A') OR NOT any_top ORDER BY t.quant_score DESC, code LIMIT 10",
    "report_sources": f"""WITH v AS (SELECT * REPLACE (CASE WHEN {_K} % 6 = 0 THEN pbr + 1 ELSE pbr END AS pbr) FROM ({_valuation('{snap}')})),
        w AS (SELECT *, CASE WHEN eps > 0 THEN nullif(price, 0) / eps END AS c1, CASE WHEN bps > 0 THEN nullif(price, 0) / bps END AS c2, CASE WHEN price > 0 THEN dps / price * 100 END AS c3, CASE WHEN shares_outstanding > 0 THEN nullif(price, 0) * shares_outstanding END AS c4 FROM v)
        SELECT code, {r('CASE WHEN per > 0 THEN per ELSE c1 END', name='per_value')}, CASE WHEN per > 0 THEN CASE WHEN abs(per - c1) <= abs(c1) * 0.01 + 0.01 THEN 'calc' ELSE 'stored' END WHEN c1 IS NOT NULL THEN 'calc' ELSE '-' END AS per_src,
          {r('CASE WHEN pbr > 0 THEN pbr ELSE c2 END', name='pbr_value')}, CASE WHEN pbr > 0 THEN CASE WHEN abs(pbr - c2) <= abs(c2) * 0.01 + 0.01 THEN 'calc' ELSE 'stored' END WHEN c2 IS NOT NULL THEN 'calc' ELSE '-' END AS pbr_src,
          {r('coalesce(dividend_yield, c3)', name='div_yield_value')}, CASE WHEN dividend_yield IS NOT NULL THEN CASE WHEN abs(dividend_yield - c3) <= abs(c3) * 0.01 + 0.01 THEN 'calc' ELSE 'stored' END WHEN c3 IS NOT NULL THEN 'calc' ELSE '-' END AS div_yield_src,
          CASE WHEN market_cap > 0 THEN CASE WHEN abs(market_cap - c4) <= abs(c4) * 0.001 + 1 THEN 'calc' ELSE 'stored' END WHEN c4 IS NOT NULL THEN 'calc' ELSE '-' END AS market_cap_src,
          {r('coalesce(roe, CASE WHEN bps > 0 THEN eps / bps * 100 END)', name='roe_value')}, CASE WHEN roe IS NOT NULL THEN 'stored' WHEN bps > 0 AND eps IS NOT NULL THEN 'calc' ELSE '-' END AS roe_src FROM w""",
    "report_ranks": f"SELECT CAST(row_number() OVER (ORDER BY g.quant_score DESC NULLS LAST, code) AS INTEGER) AS rank, code, {r('quant_score')}, verdict FROM {{graded}} g",
    "legacy_rank": f"SELECT code, CAST(row_number() OVER (ORDER BY t.roe DESC, code) AS INTEGER) AS rank, {r('roe')} FROM {{inputs}} t WHERE t.roe >= 5 AND per <= 30 AND equity_ratio >= 10",
    "screen": f"""SELECT code, {r('price', 4)}, filter_reason, {r('CASE WHEN filter_reason IS NULL THEN quant_score END', 4, 'quant_score')},
        CASE WHEN filter_reason IS NULL THEN v END AS verdict FROM (SELECT *, {scoring.verdict()} AS v FROM {{s_scored}})""",
    "stream_settled_bars": f"""SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') AS code, CAST(ts AS DATE) AS entry_date, {r('avg(value)', name='price')}, count(*) AS volume, {r('sum(value)', name='trading_value')}
        FROM {{events}} WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(date_trunc('millisecond', ts)) FROM {{events}}) - INTERVAL 1 DAY GROUP BY user_id, CAST(ts AS DATE)""",
}

_BATCH = """SELECT l_linenumber AS n, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS price, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    CAST(sum(l_quantity) AS BIGINT) AS volume FROM {lineitem} GROUP BY ALL"""
_LIVE = "SELECT lpad(CAST(s_suppkey + CASE WHEN s_suppkey % 23 = 0 THEN 5000 ELSE 0 END AS VARCHAR), 8, '0') AS code, s_name AS name FROM {supplier}"
_CHANGE = """CASE WHEN s.code IS NULL THEN 'new' WHEN l.code IS NULL THEN CASE WHEN is_active IS NOT FALSE THEN 'gone' ELSE 'inactive' END WHEN is_active IS FALSE AND status = 'delisted' THEN 'relisted' ELSE 'kept' END"""
_NO_DATA = "市場データ提供なし (Yahoo Finance にデータなし)"
#: The earlier score, written out: each metric's points, the bonuses, what the indicators give.
_LEGACY = f"""WITH v AS (SELECT code, sector, coalesce(roe, 0) AS roe, coalesce(per, 0) AS per, coalesce(pbr, 0) AS pbr, coalesce(equity_ratio, 0) AS eq, coalesce(dividend_yield, 0) AS dy, coalesce(debt_equity_ratio, 0) AS de,
      CASE WHEN {_K} % 6 = 5 THEN 0.0 ELSE coalesce(payout_ratio, 0) END AS po, CASE WHEN {_K} % 5 = 4 THEN 0.0 ELSE {_K} % 5 * 40.0 END AS cap, coalesce(macd_hist, 0) AS mh, coalesce(rsi_14, 0) AS rsi, turnaround_status AS ts FROM {{inputs}}),
    p AS (SELECT *, 50 + 10 * CASE WHEN roe <= 5 THEN 0 WHEN roe >= 15 THEN 1 ELSE (roe - 5) / 10 END + 8 * CASE WHEN per >= 15 THEN 0 WHEN per <= 10 THEN 1 ELSE (15 - per) / 5 END
        + CASE WHEN pbr <= 1 THEN 6 ELSE 0 END + CASE WHEN eq >= 40 THEN 8 ELSE 0 END
        + CASE WHEN dy >= 3 THEN 10 * CASE WHEN dy >= 4 THEN 1 ELSE (dy - 2) / 2 END * CASE WHEN po < 100 THEN 1 ELSE 0.5 END ELSE 0 END
        + 4 * CASE WHEN po <= 30 THEN 0 WHEN po >= 100 THEN 1 ELSE (po - 30) / 70 END - CASE WHEN de >= 150 THEN 5 ELSE 0 END + CASE WHEN ts = 'turnaround_black' THEN 6 ELSE 0 END AS fund,
      50 + CASE WHEN mh > 0 THEN 5 + least(5, mh * 2) WHEN mh < 0 THEN -5 + greatest(-5, mh * 2) ELSE 0 END + greatest(-15, least(15, (50 - rsi) * 0.5)) AS trend,
      CASE ts WHEN 'turnaround_black' THEN 6 WHEN 'turnaround_white' THEN -8 ELSE 0 END AS adj, CASE WHEN cap >= 100 THEN 1.0 WHEN cap >= 30 THEN 0.8 ELSE 0.5 END AS size FROM v),
    q AS (SELECT code, sector, rsi, CAST(greatest(0, least(100, (greatest(0, least(100, fund / 102.0 * 100)) * 0.7 + greatest(0, least(100, trend / 45.0 * 100)) * 0.3 + adj) * size)) AS DOUBLE) AS n FROM p),
    t AS (SELECT *, round(n + ascii(substr(md5(code), 1, 1)) % 10 * 1e-4, 9) AS noisy, CASE WHEN abs(rsi - 50) < 0.1 THEN least(50.0, round(n + 1e-9, 2)) ELSE round(n + 1e-9, 2) END AS score FROM q),
    legacy AS (SELECT code, sector, n, score, rank() OVER (PARTITION BY sector ORDER BY noisy DESC) + (count(*) OVER (PARTITION BY sector, noisy) - 1) / 2.0 AS rnk FROM t)"""

_SQL |= {
    "src_batch_bars": f"SELECT CAST(n AS VARCHAR) AS code, day AS entry_date, {rs('price, high, low')}, volume FROM ({_BATCH}) WHERE dayofmonth(day) % 7 <> n % 7",
    "src_batch_events": f"SELECT CAST(n AS VARCHAR) AS code, day AS split_date, CAST(n AS DOUBLE) AS ratio FROM (SELECT DISTINCT unnest(range(2, 8)) AS n, CAST(l_shipdate AS DATE) AS day FROM {{lineitem}}) WHERE dayofmonth(day) = n",
    "src_csv_alias": "SELECT CAST(c_custkey AS VARCHAR) AS code, c_name AS name, c_mktsegment AS sector, CASE WHEN c_custkey % 3 = 0 THEN 'スタンダード' END AS market FROM {customer}",
    "src_code_map_csv": "SELECT '提出者' || c_custkey AS filer, CASE WHEN length(s) = 5 THEN s[1:4] ELSE s END AS code FROM (SELECT c_custkey, CAST(1000 + c_custkey AS VARCHAR) || '0' AS s FROM {customer} WHERE c_custkey % 2 = 0)",
    "src_facts": f"SELECT doc_id, element, context, {r('value')}, CASE WHEN context = 'CurrentYearInstant' THEN '2001-03-31' END AS period FROM {{facts}} UNION ALL SELECT DISTINCT doc_id, 'Note', 'CurrentYearInstant', CAST(NULL AS DOUBLE), '2001-03-31' FROM {{facts}}",
    "src_results": f"SELECT code, kind, period_end, {rs('sales, net_assets, eps')} FROM {{results}} WHERE {_K} % 2 = 1",
    "scan_active_strict": "SELECT code FROM {stocks} WHERE is_active",
    "lookup_fetched": "SELECT DISTINCT code FROM {bars} WHERE entry_date = DATE '1998-06-15' AND volume % 3 <> 0",
    "lookup_codes": "SELECT c.code, f.code IS NOT NULL AS present FROM (SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code FROM {customer}) c LEFT JOIN {fundamentals} f ON c.code = f.code",
    "seed_verified": f"SELECT code, CAST(NULL AS DOUBLE) AS operating_cf, CAST(NULL AS DOUBLE) AS payout_ratio, CAST(NULL AS DOUBLE) AS sales_growth, CAST(NULL AS DOUBLE) AS debt_equity_ratio, {r('sales')} FROM {{fundamentals}}",
    "scan_window": f"""WITH RECURSIVE runs AS (SELECT d AS run_date, min(CASE WHEN bad THEN s END) AS first_bad, row_number() OVER (ORDER BY d) AS i FROM (
          SELECT last_day(CAST(o_orderdate AS DATE)) AS d, CAST(o_orderdate AS DATE) AS s, bool_or(o_orderkey % 997 = 1) AS bad FROM {{orders}} GROUP BY 1, 2) GROUP BY d),
        marks AS (SELECT i, CASE WHEN first_bad IS NULL THEN run_date ELSE first_bad - 1 END AS mark FROM runs WHERE i = 1
          UNION ALL SELECT r.i, CASE WHEN first_bad IS NULL THEN run_date ELSE least(first_bad - 1, m.mark) END FROM marks m JOIN runs r ON r.i = m.i + 1)
        SELECT mark, CAST(least(365, greatest(7, DATE '{TODAY}' - mark + 1)) AS INTEGER) AS days FROM marks ORDER BY i DESC LIMIT 1""",
    "profile_status": "SELECT status, count(*) AS n FROM {stocks} GROUP BY status",
    "ingest_headers": "SELECT CAST(s_suppkey AS VARCHAR) AS code, s_name AS name, CAST(CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey + 0.5 WHEN s_suppkey % 2 = 0 THEN 1234.5 END AS DOUBLE) AS per, CAST(2.5 AS DOUBLE) AS dividend_yield, s_nationkey AS other FROM {supplier}",
    "row_hash": """SELECT code, md5(concat_ws('|', code, coalesce(name, 'NaN'), """ + _text("per") + ", 'NaN', " + _text("roe") + ", 'NaN', 'NaN', " + _text("rsi_14") + ", " + _text("quant_score") + """)) AS row_hash FROM {graded} g""",
    "tech_summary": f"""WITH m AS (SELECT *, lag(price) OVER w AS before, count(*) OVER (PARTITION BY code) AS n, row_number() OVER (PARTITION BY code ORDER BY entry_date DESC) AS back FROM {{ind}} WINDOW w AS (PARTITION BY code ORDER BY entry_date)),
        a AS (SELECT code, any_value(n) AS n_rows, avg(greatest(price - before, 0.0)) FILTER (back <= 14) AS up, avg(greatest(before - price, 0.0)) FILTER (back <= 14) AS down, avg(volume) FILTER (back <= 25) AS v,
          stddev_samp(ln(price / before)) * sqrt(252.0) * 100 AS vol FROM m GROUP BY code),
        x AS (SELECT i.*, v, vol, CASE WHEN down = 0 THEN CASE WHEN up = 0 THEN 50.0 ELSE 100.0 END ELSE 100 - 100 / (1 + up / down) END AS rsi FROM (SELECT code, max(entry_date) AS entry_date FROM {{ind}} GROUP BY code) t JOIN {{ind}} i USING (code, entry_date) JOIN a USING (code) WHERE n_rows >= 30),
        y AS (SELECT *, CAST(coalesce(ma25 > ma75, false) AS INT) + CAST(coalesce(price > ma25, false) AS INT) + CAST(coalesce(macd_hist > 0, false) AS INT) + CAST(rsi > 50 AS INT) AS points FROM x)
        SELECT code, entry_date, {r('macd_hist', 4)}, {r('rsi', 4, 'rsi_14')}, CAST(points >= 3 AS INTEGER)::DOUBLE AS trend_up, points AS trend_score, {r('ma_divergence', 4)}, {r('volume / v', 4, 'volume_ratio')}, {r('vol', 4, 'real_volatility')},
          {', '.join(r(f'coalesce(ma25 + {n} * bb_sigma, 0)', 4, name) for name, n in (('bb_p1sig', 1), ('bb_p2sig', 2), ('bb_m1sig', -1), ('bb_m2sig', -2)))} FROM y""",
    "dedup_events": f"""WITH RECURSIVE ev AS (SELECT code, entry_date AS d, min(2.0 + volume % 3) AS ratio FROM {{bars}} WHERE volume % 13 <> 0 GROUP BY code, entry_date),
        kept AS (SELECT code, min(d) AS d FROM ev GROUP BY code UNION ALL SELECT k.code, (SELECT min(e.d) FROM ev e WHERE e.code = k.code AND e.d > k.d + 10) FROM kept k WHERE k.d IS NOT NULL)
        SELECT code, d AS split_date, {r('ratio')} FROM kept JOIN ev USING (code, d)""",
    "dedup_known": f"""WITH RECURSIVE ev AS (SELECT code, entry_date AS d, min(2.0 + volume % 3) AS ratio FROM {{bars}} b WHERE volume % 13 <> 0
          AND NOT EXISTS (SELECT 1 FROM {{splits}} s WHERE s.code = b.code AND s.split_date BETWEEN b.entry_date - 10 AND b.entry_date + 10) GROUP BY code, entry_date),
        kept AS (SELECT code, min(d) AS d FROM ev GROUP BY code UNION ALL SELECT k.code, (SELECT min(e.d) FROM ev e WHERE e.code = k.code AND e.d > k.d + 10) FROM kept k WHERE k.d IS NOT NULL)
        SELECT code, d AS split_date, {r('ratio')} FROM kept JOIN ev USING (code, d)""",
    "master_diff": f"SELECT coalesce(s.code, l.code) AS code, {_CHANGE} AS change FROM {{stocks}} s FULL JOIN (SELECT lpad(CAST(s_suppkey * 2 AS VARCHAR), 8, '0') AS code FROM {{supplier}}) l ON s.code = l.code",
    "master_sync": f"""WITH d AS (SELECT coalesce(s.code, l.code) AS code, {_CHANGE} AS change, s.name AS n0, s.sector AS s0, s.market AS m0, s.status AS st, s.is_active AS ac, s.exclusion_reason AS why, l.name AS n1, l.code IS NOT NULL AS live
          FROM {{stocks}} s FULL JOIN (SELECT code, min(name) AS name FROM ({_LIVE}) GROUP BY code) l ON s.code = l.code),
        o AS (SELECT *, count(*) FILTER (live) OVER () >= 1 AND count(*) FILTER (change = 'gone') OVER () <= 0.1 * count(*) FILTER (change <> 'new') OVER () AS ok FROM d)
        SELECT code, CASE WHEN ok AND live THEN n1 ELSE n0 END AS name, CASE WHEN ok AND live THEN 'Other' ELSE s0 END AS sector, CASE WHEN ok AND live THEN 'Prime' ELSE m0 END AS market,
          CASE WHEN ok AND change = 'gone' THEN 'delisted' WHEN ok AND change IN ('relisted', 'new') THEN 'active' ELSE st END AS status,
          CASE WHEN ok AND change = 'gone' THEN false WHEN ok AND change IN ('relisted', 'new') THEN true ELSE ac END AS is_active,
          CASE WHEN ok AND change = 'gone' THEN '上場廃止 (JPX 上場銘柄一覧に掲載なし)' WHEN ok AND change = 'relisted' THEN NULL ELSE why END AS exclusion_reason, change FROM o WHERE ok OR change <> 'new'""",
    "nodata_tracking": f"""WITH o AS (SELECT *, {_K} % 6 <> 0 AS got, {_K} % 12 = 0 AS hist, avg(CASE WHEN {_K} % 6 <> 0 THEN 1.0 ELSE 0 END) OVER () >= 0.7 AS ok FROM {{stocks}}),
        f AS (SELECT *, ok AND got AND (coalesce(fail_count, 0) > 0 OR excluded_until IS NOT NULL) AS reset, ok AND NOT got AND NOT hist AS failed FROM o),
        n AS (SELECT *, failed AND coalesce(last_fail_date < '{TODAY}', true) AS counted FROM f),
        c AS (SELECT *, CASE WHEN reset THEN 0 WHEN counted THEN coalesce(fail_count, 0) + 1 ELSE fail_count END AS fails FROM n)
        SELECT code, CAST(fails AS INTEGER) AS fail_count, CASE WHEN reset THEN NULL WHEN counted THEN '{TODAY}' ELSE last_fail_date END AS last_fail_date,
          CASE WHEN reset THEN NULL WHEN failed AND fails >= 3 THEN '2001-12-31' ELSE excluded_until END AS excluded_until,
          CASE WHEN reset AND exclusion_reason = '{_NO_DATA}' THEN NULL WHEN failed AND fails >= 3 THEN '{_NO_DATA}' ELSE exclusion_reason END AS exclusion_reason FROM c""",
    "suspend_codes": "SELECT code, CASE WHEN status = 'delisted' THEN false ELSE is_active END AS is_active, CASE WHEN status = 'delisted' THEN 'suspended' ELSE status END AS status, CASE WHEN status = 'delisted' THEN 'paused' ELSE exclusion_reason END AS exclusion_reason FROM {stocks}",
    "fail_counts": f"SELECT code, CAST(CASE WHEN {_K} % 10 = 0 THEN 0 WHEN {_K} % 2 = 0 THEN fail_count + 1 ELSE fail_count END AS INTEGER) AS fail_count FROM {{stocks}}",
    "legacy_filter": f"SELECT code, {r('price')}, volume, {r('equity_ratio')} FROM {{scored}} t WHERE coalesce(t.price >= 1100, true) AND coalesce(volume >= 20, true) AND coalesce(t.equity_ratio >= 10, true) ORDER BY CASE WHEN {_K} % 4 <> 0 THEN quant_score END DESC NULLS LAST, code LIMIT 50",
    "legacy_dividend": f"SELECT code, {r('CASE WHEN dividend_yield >= 3 AND NOT coalesce(operating_cf < 0, false) THEN CASE WHEN payout_ratio > 100 THEN 0.0 ELSE 20.0 END ELSE 0.0 END', name='dividend_points')} FROM {{inputs}}",
    "legacy_score": f"{_LEGACY} SELECT code, sector, {r('n', name='quant_score_normalized')}, {r('score', name='quant_score')}, {r('rnk', name='rank')}, 'balanced' AS strategy_name FROM legacy",
    "legacy_pass": f"{_LEGACY} SELECT l.code, {r('score', name='quant_score')} FROM legacy l JOIN v ON l.code = v.code WHERE v.roe >= 8 AND v.per <= 15 AND v.po >= 30",
}

#: The scores, written out anew from their definition: value of each part by what the metric is.
_HAND = """SELECT *, CAST(CASE WHEN roe > 0 THEN CASE WHEN roe >= 25 THEN 30 WHEN roe >= 10 THEN roe + 5 WHEN roe >= 5 THEN 2 * roe - 5 ELSE roe END ELSE 0 END AS DOUBLE) AS h_roe,
    CAST(CASE WHEN pbr > 4 OR pbr <= 0 OR pbr IS NULL THEN 0 WHEN pbr > 2 THEN 8 - 2 * pbr WHEN pbr > 1 THEN 16 - 6 * pbr WHEN pbr > 0.6 THEN 17.5 - 7.5 * pbr ELSE 13 END AS DOUBLE) AS h_pbr,
    CAST(CASE WHEN per IS NULL OR per <= 0 THEN 0 WHEN per < 4 AND (coalesce(operating_margin, 1) <= 0 OR (coalesce(net_profit, 0) > 0 AND (coalesce(operating_income, net_profit) <= 0 OR coalesce(operating_income, net_profit) < net_profit / 2))) THEN 0
      WHEN per < 3 THEN 2 WHEN per <= 6 THEN 12 WHEN per <= 10 THEN 18 - per WHEN per <= 15 THEN 16 - 0.8 * per WHEN per <= 25 THEN 10 - 0.4 * per WHEN per > 40 THEN greatest(-3, 4 - 0.1 * per) ELSE 0 END AS DOUBLE) AS h_per,
    CAST(CASE WHEN equity_ratio IS NULL OR equity_ratio <= 0 THEN 0 WHEN equity_ratio < 25 THEN 0.08 * equity_ratio WHEN equity_ratio < 50 THEN 0.24 * equity_ratio - 4 WHEN equity_ratio < 80 THEN 7 * equity_ratio / 30 - 11 / 3 ELSE 15 END AS DOUBLE) AS h_equity,
    CAST(CASE WHEN dividend_yield >= 5 THEN 10 WHEN dividend_yield >= 3 THEN 2.5 * dividend_yield - 2.5 WHEN dividend_yield >= 1.5 THEN 8 * dividend_yield / 3 - 3 ELSE 0 END AS DOUBLE) AS h_dividend,
    CAST(CASE WHEN macd_hist > 0 THEN 6 + least(2, macd_hist) WHEN macd_hist < 0 THEN greatest(0, 2 + macd_hist / 2) ELSE 3 END AS DOUBLE) AS h_macd,
    CAST(CASE WHEN rsi_14 IS NULL THEN 0 WHEN rsi_14 > 75 THEN greatest(-3, 15 - rsi_14 / 5) WHEN rsi_14 > 65 THEN 18.75 - rsi_14 / 4 WHEN rsi_14 > 50 THEN 9 - rsi_14 / 10 WHEN rsi_14 > 35 THEN 9 - rsi_14 / 10 WHEN rsi_14 > 25 THEN 10.75 - 0.15 * rsi_14 ELSE 7 END AS DOUBLE) AS h_rsi,
    CAST(CASE WHEN ma_divergence IS NULL THEN 0 WHEN ma_divergence > 25 THEN greatest(-4, 10 - 0.4 * ma_divergence) WHEN ma_divergence > 15 THEN 5 - ma_divergence / 5 WHEN ma_divergence > 5 THEN 3.5 - ma_divergence / 10 WHEN ma_divergence > -5 THEN 3
      WHEN ma_divergence >= -15 THEN 2 - ma_divergence / 5 WHEN ma_divergence >= -25 THEN 12.5 + ma_divergence / 2 ELSE greatest(-3, 5 + ma_divergence / 5) END AS DOUBLE) AS h_div,
    coalesce(abs(rsi_14 - 50) < 0.001 AND abs(ma_divergence) < 0.001, false) AS dead FROM {inputs}"""


def _hand_total(w: tuple[float, ...]) -> str:
    parts = ("h_roe", "h_pbr + h_per", "h_equity", "h_dividend", "h_macd + h_rsi + h_div")
    most = sum(x * m for x, m in zip(w, (30, 25, 15, 10, 20), strict=True))
    share = " + ".join(f"({p}) * {x}" for p, x in zip(parts, w, strict=True))
    return f"CAST(CASE WHEN dead THEN 45.0 ELSE round(greatest(15.0, least(98.0, ({share}) * 100 / {most})) + 1e-7, 1) END AS DOUBLE)"


def _hand_grade(score: str, names: str) -> str:
    """names: a SQL list, the worst first."""
    bear = "coalesce(macd_hist < 0, false)"
    rank = f"least(CASE WHEN {score} < 50 THEN 1 WHEN {score} < 65 THEN 2 WHEN {score} < 80 THEN 3 ELSE 4 END, CASE WHEN roe < 0 OR operating_margin <= 0 OR operating_income <= 0 OR ({bear} AND ma_divergence < -10) THEN 2 WHEN {bear} THEN 3 ELSE 4 END)"
    return f"CASE WHEN dead THEN 'PASS' ELSE ({names})[{rank}] END"


_GRADE_NAMES, _OLD_NAMES = "['Grade C', 'Grade B', 'Grade A', 'Grade S']", "['PASS', 'WATCH', 'BUY', 'STRONG_BUY']"
MORE |= {
    "hand": _HAND,
    "hand_scored": f"SELECT *, {_hand_total((1, 1, 1, 1, 1))} AS total FROM {{hand}}",
    "hand_graded": f"SELECT *, {_hand_grade('total', _GRADE_NAMES)} AS grade, {_hand_grade('total', _OLD_NAMES)} AS old_grade FROM {{hand_scored}}",
}
_SQL |= {
    "score_roe": f"SELECT code, {r('h_roe', name='score_roe')} FROM {{hand}}",
    "score_value": f"SELECT code, {r('h_pbr', name='score_pbr')}, {r('h_per', name='score_per')} FROM {{hand}}",
    "score_safety": f"SELECT code, {r('h_equity', name='score_equity')} FROM {{hand}}",
    "score_dividend": f"SELECT code, {r('h_dividend', name='score_dividend')} FROM {{hand}}",
    "score_tech": f"SELECT code, {r('h_macd', name='score_macd')}, {r('h_rsi', name='score_rsi')}, {r('h_div', name='score_divergence')} FROM {{hand}}",
    "quant_score": f"SELECT code, {r('total', name='quant_score')} FROM {{hand_scored}}",
    "grade": "SELECT code, grade AS verdict, old_grade AS legacy_verdict FROM {hand_graded}",
    "grade_counts": "SELECT grade AS verdict, count(*) AS n FROM {hand_graded} GROUP BY grade",
    "score_by_preset": " UNION ALL ".join(
        f"SELECT code, preset, {r('t', name='quant_score')}, {_hand_grade('t', _GRADE_NAMES)} AS verdict FROM (SELECT *, '{k}' AS preset, {_hand_total(w)} AS t FROM {{hand}})"
        for k, w in (("balanced", (1, 1, 1, 1, 1)), ("dividend_focus", (1, 0.8, 1.2, 2.5, 0.5)), ("deep_value", (0.8, 2.5, 1.2, 0.8, 0.5)), ("growth_quality", (2.5, 0.5, 1, 0.5, 1)))
    ),
}
_num = lambda x, d: f"coalesce(printf('%.{d}f', round(CAST({x} AS DOUBLE) + 1e-7, {d})), '-')"
_src = lambda v, c, rel, add: f"CASE WHEN {v} > 0 THEN CASE WHEN abs({v} - {c}) <= abs({c}) * {rel} + {add} THEN 'calc' ELSE 'stored' END WHEN {c} IS NOT NULL THEN 'calc' ELSE '-' END"
_REPORT = f"""WITH v AS (SELECT h.* REPLACE (CASE WHEN {_K} % 7 = 0 THEN NULL ELSE market_cap END AS market_cap) FROM {{hand_graded}} h),
    w AS (SELECT *, CASE WHEN eps > 0 THEN nullif(price, 0) / eps END AS c1, CASE WHEN bps > 0 THEN nullif(price, 0) / bps END AS c2, CASE WHEN price > 0 THEN dps / price * 100 END AS c3, CASE WHEN shares_outstanding > 0 THEN price * shares_outstanding END AS c4 FROM v),
    report AS (SELECT CAST(row_number() OVER (ORDER BY total DESC, code) AS INTEGER) AS "Rank", code AS "Code", name AS "Name", sector AS "Sector", market AS "Market", {_src('market_cap', 'c4', 0.001, 1)} AS "Market_Cap_Src",
      coalesce(CAST(CAST(trunc(round(CASE WHEN market_cap > 0 THEN market_cap ELSE c4 END + 1e-7, 3)) AS BIGINT) AS VARCHAR), '-') AS "Market_Cap", grade AS "Verdict", {_num('total', 2)} AS "Score", {_num('price', 4)} AS "Price", coalesce(CAST(entry_date AS VARCHAR), '-') AS "Price_Date",
      {_src('per', 'c1', 0.01, 0.01)} AS "PER_Src", {_num('CASE WHEN per > 0 THEN per ELSE c1 END', 2)} AS "PER", {_src('pbr', 'c2', 0.01, 0.01)} AS "PBR_Src", {_num('CASE WHEN pbr > 0 THEN pbr ELSE c2 END', 2)} AS "PBR",
      CASE WHEN dividend_yield IS NOT NULL THEN CASE WHEN abs(dividend_yield - c3) <= abs(c3) * 0.01 + 0.01 THEN 'calc' ELSE 'stored' END WHEN c3 IS NOT NULL THEN 'calc' ELSE '-' END AS "Div_Yield_Src", {_num('coalesce(dividend_yield, c3)', 2)} AS "Div_Yield",
      'stored' AS "ROE_Src", {_num('roe', 2)} AS "ROE", {_num('sales_growth', 4)} AS "Sales_Growth", {_num('coalesce(profit_growth_raw, 7.25)', 4)} AS "Profit_Growth", {_num('operating_margin', 4)} AS "Operating_Margin", {_num('equity_ratio', 4)} AS "Equity_Ratio",
      {_num('rsi_14', 1)} AS "RSI", CAST({_K} % 5 AS VARCHAR) AS "Trend", '2001-12-01 16:00:00' AS "Report_Timestamp" FROM w)"""
_SQL |= {
    "report_rows": f"{_REPORT} SELECT * FROM report",
    "src_report_csv": f"""{_REPORT} SELECT CAST("Rank" AS VARCHAR) AS "Rank", "Code", "Market", nullif("Market_Cap", '-') AS "Market_Cap", nullif("PER", '-') AS "PER", nullif("Profit_Growth", '-') AS "Profit_Growth", nullif("RSI", '-') AS "RSI", "Trend" FROM report""",
}


_GOING_ON = f"code, entry_date, {rs('ma25, ma75, bb_sigma, macd, macd_signal, macd_hist', 4)}, macd_status, {r('rsi_14', 4)}"


def _rounds(bars: str, events: str, out: str) -> str:
    """Two recursive relations: the bars of codes with events, after each event in its order; out has the last ones and the
    bars of all other codes. The k-th round looks for the jump of the k-th event in what the rounds before left."""
    jumps = _JUMPS.replace("{bars}", f"{out}_r")
    return f"""{out}_e AS (SELECT code, split_date, CAST(ratio AS DOUBLE) AS ratio, row_number() OVER (PARTITION BY code ORDER BY split_date, ratio) AS k FROM {events} WHERE ratio BETWEEN 0.02 AND 100 AND ratio <> 1 AND abs(ln(ratio)) >= ln(1.9)),
      {out}_r AS (SELECT 0 AS k, code, entry_date, price, CAST(volume AS DOUBLE) AS volume FROM {bars} WHERE code IN (SELECT code FROM {out}_e)
        UNION ALL SELECT k, code, entry_date, price / f, volume * f FROM (
          SELECT k + 1 AS k, code, entry_date, price, volume, CASE WHEN entry_date < (min(fit) OVER (PARTITION BY code)).d THEN ratio ELSE 1.0 END AS f FROM (
            SELECT j.*, e.ratio, CASE WHEN impossible AND entry_date BETWEEN e.split_date - 14 AND e.split_date + 5 AND abs(ln(p1 / price) - ln(e.ratio)) <= 0.12 THEN {{'err': abs(ln(p1 / price) - ln(e.ratio)), 'd': entry_date}} END AS fit
            FROM ({jumps}) j LEFT JOIN {out}_e e ON e.code = j.code AND e.k = j.k + 1)) WHERE k <= (SELECT coalesce(max(k), 0) FROM {out}_e)),
      {out} AS MATERIALIZED (SELECT code, entry_date, price, volume FROM {out}_r WHERE k = (SELECT coalesce(max(k), 0) FROM {out}_e)
        UNION ALL SELECT code, entry_date, price, CAST(volume AS DOUBLE) FROM {bars} WHERE code NOT IN (SELECT code FROM {out}_e))"""


MORE |= {
    "changed_bars": "SELECT * REPLACE (CASE WHEN entry_date >= DATE '2001-06-01' AND entry_date < DATE '2001-06-20' AND CAST(code AS BIGINT) % 7 = 3 THEN price * 1.5 ELSE price END AS price) FROM {bars}",
    "changed_ind": _indicators("{changed_bars}"),
    "s_judged": f"SELECT f.*, l.* EXCLUDE (code), {_REASONS} AS filter_reason FROM {{s_fixed}} f LEFT JOIN {{liq}} l ON f.code = l.code",
    "hand_s": _HAND.replace("{inputs}", "{s_judged}"),
    "hand_s_scored": f"SELECT *, {_hand_total((1, 1, 1, 1, 1))} AS total FROM {{hand_s}}",
}
_TARGETS = "coalesce(market, 'None') NOT IN ('ASIA', 'EUROPE')"
_SQL |= {
    "indicators_resumed": f"SELECT {_GOING_ON} FROM {{ind}} WHERE isodow(entry_date) < 6 AND entry_date >= DATE '2001-03-01'",
    "indicators_renewed": f"""SELECT {_GOING_ON} FROM {{changed_ind}} WHERE isodow(entry_date) < 6 AND (entry_date >= DATE '2001-03-01'
        OR code IN (SELECT code FROM {{bars}} WHERE entry_date >= DATE '2001-06-01' AND entry_date < DATE '2001-06-20' AND CAST(code AS BIGINT) % 7 = 3))""",
    "stored_bars_rsi": _SQL["tech_rsi"],
    "stored_bars_recent": f"SELECT code, entry_date, {r('price')}, volume FROM {{bars}} WHERE entry_date >= DATE '2001-05-15' AND code IN (SELECT code FROM {{stocks}} WHERE market = 'ASIA')",
    "monthly_merge": _SQL["merge_history"],
    "monthly_partial": f"""SELECT coalesce(o.code, n.code) AS code, coalesce(o.entry_date, n.entry_date) AS entry_date, {r('CASE WHEN n.code IS NOT NULL THEN n.price * 2 ELSE o.price END', name='price')}, o.volume AS volume
        FROM {{old_bars}} o FULL JOIN (SELECT * FROM {{new_bars}} WHERE volume % 3 = 0) n ON o.code = n.code AND o.entry_date = n.entry_date""",
    "prefilter_markets": f"""SELECT code, coalesce(filter_reason, CASE WHEN {_TARGETS} THEN '対象外市場' END) AS filter_reason,
        coalesce(filter_detail, CASE WHEN {_TARGETS} THEN '指定対象市場 ([''ASIA'', ''EUROPE'']) に含まれない市場 (' || coalesce(market, 'None') || ')' END) AS filter_detail FROM {{filtered}}""",
    "repair_scaled": f"""SELECT code, {r('CASE WHEN abs(x) > 0 AND abs(x) < 0.5 THEN x * 100 ELSE x END', name='roe')}, {r('greatest(0, least(100, CASE WHEN abs(y) > 0 AND abs(y) < 0.5 THEN y * 100 ELSE y END))', name='equity_ratio')}
        FROM (SELECT code, roe / 50 AS x, equity_ratio AS y FROM {{fundamentals}}) WHERE y IS NOT NULL
        UNION ALL SELECT code, {r('CASE WHEN abs(roe / 50) > 0 AND abs(roe / 50) < 0.5 THEN roe / 50 * 100 ELSE roe / 50 END', name='roe')}, NULL FROM {{fundamentals}} WHERE equity_ratio IS NULL""",
    "report_top": f"SELECT CAST(row_number() OVER (ORDER BY g.total DESC NULLS LAST, code) AS INTEGER) AS rank, code, {r('total', name='quant_score')}, grade AS verdict FROM {{hand_graded}} g QUALIFY rank <= 25",
    "report_ranks": f"SELECT CAST(row_number() OVER (ORDER BY g.total DESC NULLS LAST, code) AS INTEGER) AS rank, code, {r('total', name='quant_score')}, grade AS verdict FROM {{hand_graded}} g",
    "top_candidates": f"""SELECT code, {r('total', name='quant_score')}, grade AS verdict FROM {{hand_graded}} WHERE grade IN ('Grade S', 'Grade A') OR NOT (SELECT coalesce(bool_or(grade IN ('Grade S', 'Grade A')), false) FROM {{hand_graded}})
        ORDER BY total DESC, code LIMIT 10""",
    "grade_map": "SELECT code, CASE old_grade WHEN 'STRONG_BUY' THEN 'Grade S' WHEN 'BUY' THEN 'Grade A' WHEN 'WATCH' THEN 'Grade B' WHEN 'PASS' THEN 'Grade C' END AS grade FROM {hand_graded}",
    "contract_check": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({x} IS NULL OR {n}) AS n_bad FROM {{hand_graded}}" for c, x, n in (("code", "code", "false"), ("price", "price", "isnan(price)"), ("verdict", "grade", "false"), ("equity_ratio", "equity_ratio", "isnan(equity_ratio)"))) + " UNION ALL SELECT 'not_there', count(*) FROM {hand_graded}",
    "screen": f"""SELECT code, {r('price', 4)}, filter_reason, {r('CASE WHEN filter_reason IS NULL THEN total END', 4, 'quant_score')},
        CASE WHEN filter_reason IS NULL THEN {_hand_grade('total', _GRADE_NAMES)} END AS verdict FROM {{hand_s_scored}}""",
    "legacy_categories": f"""{_LEGACY.split(chr(10) + '    p AS')[0].rstrip(',')},
        p AS (SELECT *, greatest(0, least(100, (50 + CASE WHEN eq >= 40 THEN 8 ELSE 0 END + CASE WHEN de <= 150 THEN 5 ELSE 0 END + CASE WHEN ts = 'turnaround_black' THEN 6 ELSE 0 END) / 92.0 * 100)) AS fund,
          greatest(0, least(100, (50 + 10 * CASE WHEN roe <= 5 THEN 0 WHEN roe >= 15 THEN 1 ELSE (roe - 5) / 10 END + CASE WHEN mh > 0 THEN 5 + least(5, mh * 2) WHEN mh < 0 THEN -5 + greatest(-5, mh * 2) ELSE 0 END + greatest(-15, least(15, (50 - rsi) * 0.5))) / 45.0 * 100)) AS trend,
          CASE WHEN pbr >= 1 THEN 6 ELSE 0 END + CASE ts WHEN 'turnaround_black' THEN 6 WHEN 'turnaround_white' THEN -8 ELSE 0 END AS adj, CASE WHEN cap >= 100 THEN 1.0 WHEN cap >= 30 THEN 0.8 ELSE 0.5 END AS size FROM v),
        q AS (SELECT code, rsi, CAST(greatest(0, least(100, (fund * 0.7 + trend * 0.3 + adj) * size)) AS DOUBLE) AS n FROM p)
        SELECT code, {r('n', name='quant_score_normalized')}, {r('CASE WHEN abs(rsi - 50) < 0.1 THEN least(50.0, round(n + 1e-9, 2)) ELSE round(n + 1e-9, 2) END', name='quant_score')} FROM q""",
    "apply_splits": f"WITH RECURSIVE {_rounds('{bars}', '{events_split}', 'applied')} SELECT code, entry_date, {r('price')}, {r('volume')} FROM applied",
}

_SQL["adjust_history_log"] = f"""WITH RECURSIVE dated AS (SELECT code, split_date, ratio, row_number() OVER (PARTITION BY code ORDER BY split_date, ratio) AS i FROM {{events_split}} WHERE ratio BETWEEN 0.02 AND 100 AND ratio <> 1),
    judged AS (SELECT code, i, split_date AS kept_on, true AS kept, split_date, ratio FROM dated WHERE i = 1
      UNION ALL SELECT d.code, d.i, CASE WHEN d.split_date - j.kept_on > 10 THEN d.split_date ELSE j.kept_on END, d.split_date - j.kept_on > 10, d.split_date, d.ratio FROM judged j JOIN dated d ON d.code = j.code AND d.i = j.i + 1),
    recorded AS (SELECT code, split_date, ratio FROM judged WHERE kept),
    {_rounds('{bars}', 'recorded', 'adjusted')},
    guessed AS MATERIALIZED ({MORE['inferred'].replace('{jumps}', '(' + _JUMPS.replace('{bars}', 'adjusted') + ')')}),
    {_rounds('adjusted', 'guessed', 'again')}
    SELECT a.code, a.entry_date, {r('ln(a.price)', name='log_price')}, {r('ln(a.volume)', name='log_volume')}, bool_or(coalesce(abs(a.price / b.price - 1) > 1e-12, false)) OVER (PARTITION BY a.code) AS changed
    FROM again a JOIN {{bars}} b ON a.code = b.code AND a.entry_date = b.entry_date"""

_SQL["stream_distinct_splits"] = _SQL["dedup_events"]
_SQL["src_results_versions"] = f"""SELECT code, v AS parser_version, kind, period_end, {r('sales', 2)}, CASE WHEN v = 2 AND {_K} % 2 = 0 THEN NULL ELSE {r('eps', 2, 'eps').removesuffix(' AS eps')} END AS eps,
    CASE WHEN v = 3 THEN {r('bps', 2, 'bps').removesuffix(' AS bps')} END AS bps FROM (SELECT *, CAST({_K} % 3 + 1 AS INTEGER) AS v FROM {{results}}) WHERE v > 1"""
_SQL["screen_observed"] = (
    "SELECT 'n' AS metric, count(*) AS n FROM {s_judged} UNION ALL SELECT 'missing code', count(*) FILTER (code IS NULL) FROM {s_judged} UNION ALL SELECT 'missing price', count(*) FILTER (price IS NULL) FROM {s_judged}"
    " UNION ALL SELECT 'missing filter_reason', count(*) FILTER (filter_reason IS NULL) FROM {s_judged} UNION ALL "
    + " UNION ALL ".join(f"SELECT 'count {x}', count(*) FILTER (filter_reason IS NULL AND {_hand_grade('total', _GRADE_NAMES)} = '{x}') FROM {{hand_s_scored}}" for x in ("Grade S", "Grade A", "Grade B", "Grade C"))
)

ORACLE_SQL = {k: oracle(v, MORE) for k, v in _SQL.items()}
