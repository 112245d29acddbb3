"""The engine's input tables, derived from the relational tables.

Each view is SQL that both Spark and DuckDB read, with {name} for a table or an earlier view, so a query and its oracle
start from the same rows. view(spark, sf_dir, name) is lazy.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    # Daily bars of a supplier's items: the price is the volume-weighted mean.
    "bars": """SELECT lpad(CAST(l_suppkey AS STRING), 8, '0') AS code, CAST(l_shipdate AS DATE) AS entry_date,
        sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_extendedprice) / sum(l_quantity) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        CAST(sum(l_quantity) AS BIGINT) AS volume, sum(l_extendedprice) AS trading_value
        FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "bars_ev": """SELECT lpad(CAST(user_id AS STRING), 8, '0') AS code, CAST(ts AS DATE) AS entry_date, avg(value) AS price,
        CAST(count(*) AS BIGINT) AS volume, CASE WHEN user_id % 9 = 0 THEN NULL ELSE sum(value) END AS trading_value
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "stocks": """SELECT lpad(CAST(s_suppkey AS STRING), 8, '0') AS code, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_name END AS name,
        CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN n_nationkey = 3 THEN '銀行業' ELSE n_name END AS sector, r_name AS market,
        CASE WHEN s_acctbal < -500 THEN 'delisted' ELSE 'active' END AS status,
        CASE WHEN s_suppkey % 11 = 0 THEN CAST(NULL AS BOOLEAN) ELSE s_acctbal > -300 END AS is_active,
        CASE WHEN s_suppkey % 19 = 0 THEN '市場データ提供なし' END AS exclusion_reason,
        CASE WHEN s_suppkey % 7 = 0 THEN '2001-10-15' WHEN s_suppkey % 7 = 1 THEN '2002-01-15' END AS excluded_until,
        CAST(s_suppkey % 4 AS INT) AS fail_count, CASE WHEN s_suppkey % 3 = 0 THEN '2001-11-01' END AS last_fail_date
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "sums": """SELECT l_suppkey AS k, sum(l_extendedprice) AS sales,
        sum(CASE WHEN l_shipdate >= CAST('2000-01-01' AS TIMESTAMP) THEN l_extendedprice * (l_discount - l_tax) ELSE 0 END) AS np,
        sum(CASE WHEN l_shipdate < CAST('2000-01-01' AS TIMESTAMP) THEN l_extendedprice * (l_discount - l_tax) ELSE 0 END) AS pnp
        FROM {lineitem} GROUP BY l_suppkey""",
    "fundamentals": """SELECT lpad(CAST(s_suppkey AS STRING), 8, '0') AS code,
        CAST(NULL AS DOUBLE) AS per, CASE WHEN s_suppkey % 6 = 0 THEN 0.4 + s_suppkey % 10 ELSE CAST(NULL AS DOUBLE) END AS pbr,
        CASE WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE (s_suppkey * 7 % 60) - 12.5 END AS roe, CAST(NULL AS DOUBLE) AS dividend_yield,
        CASE WHEN s_suppkey % 4 = 0 THEN CAST(NULL AS DOUBLE) ELSE (s_suppkey * 13 % 110) - 5.0 END AS equity_ratio,
        CAST(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 11 % 300 END AS DOUBLE) AS debt_equity_ratio,
        sales, np AS net_profit, CASE WHEN s_suppkey % 10 = 0 THEN 0.0 ELSE pnp END AS prev_net_profit,
        sales * 0.1 * (1 - 2 * CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS operating_income,
        CAST(10.0 * (1 - 2 * CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS operating_margin,
        sales * 0.2 * (1 - 2 * CASE WHEN s_suppkey % 8 = 0 THEN 1 ELSE 0 END) AS operating_cf,
        s_acctbal * 1000.0 AS net_assets, CASE WHEN s_suppkey % 9 = 0 THEN 0.0 ELSE abs(s_acctbal) * 1000.0 * (1 + s_suppkey % 5) + 1 END AS total_assets,
        CAST(1000 * (1 + s_suppkey % 50) AS DOUBLE) AS shares_outstanding, CASE WHEN s_suppkey % 12 = 0 THEN 15.0 + s_suppkey ELSE CAST(NULL AS DOUBLE) END AS eps,
        CAST(NULL AS DOUBLE) AS bps, CASE WHEN s_suppkey % 7 = 6 THEN CAST(NULL AS DOUBLE) ELSE s_suppkey % 7 * 60.0 END AS dps,
        CAST(s_suppkey % 140 AS DOUBLE) AS payout_ratio, CAST(NULL AS DOUBLE) AS market_cap, CAST(CASE WHEN s_suppkey % 4 = 1 THEN 5.5 END AS DOUBLE) AS sales_growth,
        CASE WHEN s_suppkey % 8 = 7 THEN CAST(NULL AS STRING) ELSE concat('199', CAST(5 + s_suppkey % 5 AS STRING), '-03-31') END AS period_end,
        CASE WHEN s_suppkey % 8 = 7 THEN CAST(NULL AS STRING) ELSE concat('199', CAST(5 + s_suppkey % 5 AS STRING), '-06-25') END AS submitted_at,
        concat('199', CAST(5 + s_suppkey % 5 AS STRING), '-09-30') AS bs_period_end, concat('199', CAST(5 + s_suppkey % 5 AS STRING), '-11-10') AS bs_submitted_at
        FROM {supplier} JOIN {sums} ON s_suppkey = k""",
    # Two split events for each fifth supplier, at dates spread over the bars.
    "splits": """SELECT lpad(CAST(s_suppkey AS STRING), 8, '0') AS code, e.d AS split_date,
        CAST(CASE WHEN s_suppkey % 15 = 0 THEN 3.0 WHEN s_suppkey % 15 = 5 THEN 0.5 ELSE 2.0 END + CASE WHEN s_suppkey % 20 = 0 THEN 1000.0 ELSE 0 END AS DOUBLE) AS ratio
        FROM {supplier} JOIN (SELECT CAST('1997-06-10' AS DATE) AS d UNION ALL SELECT CAST('1999-03-05' AS DATE)) e ON s_suppkey % 5 = 0""",
    # A jump day of each fifth supplier with the ratio of its own prices, as an event a few days later.
    "events_split": """SELECT code, entry_date AS split_date, prev / price AS ratio FROM (
        SELECT code, entry_date, price, lag(price) OVER (PARTITION BY code ORDER BY entry_date) AS prev,
               row_number() OVER (PARTITION BY code ORDER BY entry_date) AS i FROM {bars}) q
        WHERE i % 97 = 5 AND prev / price >= 1.9 AND prev / price <= 20 AND CAST(code AS BIGINT) % 5 = 0""",
    "new_bars": """SELECT code, CAST(date_add(entry_date, 0) AS DATE) AS entry_date, price * CASE WHEN CAST(code AS BIGINT) % 6 = 0 THEN 0.5 WHEN CAST(code AS BIGINT) % 6 = 1 THEN 1.001 ELSE 1.0 END AS price,
        volume + 1 AS volume FROM {bars} WHERE entry_date >= CAST('2001-06-01' AS DATE)""",
    "old_bars": """SELECT code, entry_date, price, volume FROM {bars} WHERE entry_date < CAST('2001-08-01' AS DATE) AND CAST(code AS BIGINT) % 10 <> 9""",
    # Filings: an index from orders, facts from line items.
    "doc_index": """SELECT concat('S', lpad(CAST(o_orderkey AS STRING), 8, '0')) AS doc_id,
        CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN '00000' ELSE concat(lpad(CAST(o_custkey % 9000 AS STRING), 4, '0'), '0') END AS sec_code,
        CAST(CASE o_orderkey % 5 WHEN 0 THEN 120 WHEN 1 THEN 130 WHEN 2 THEN 160 WHEN 3 THEN 170 ELSE 140 END AS STRING) AS doc_type,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 00:00') END AS period_end,
        concat('report (', replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/'), '-', replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/'), ')') AS description,
        concat(CAST(CAST(o_orderdate AS DATE) AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN ' 09:00' ELSE ' 15:30' END) AS submitted
        FROM {orders}""",
    "facts": """SELECT concat('D', CAST(l_orderkey AS STRING)) AS doc_id,
        CASE l_partkey % 9 WHEN 0 THEN 'NetSalesSummaryOfBusinessResults' WHEN 1 THEN 'RevenueIFRSSummaryOfBusinessResults' WHEN 2 THEN 'NetAssetsSummaryOfBusinessResults'
          WHEN 3 THEN 'TotalAssetsSummaryOfBusinessResults' WHEN 4 THEN 'EquityToAssetRatioSummaryOfBusinessResults' WHEN 5 THEN 'DividendPaidPerShareSummaryOfBusinessResults'
          WHEN 6 THEN 'TotalNumberOfIssuedSharesSummaryOfBusinessResults' WHEN 7 THEN 'OperatingIncome' ELSE 'NetIncomeLossSummaryOfBusinessResults' END AS element,
        concat(CASE WHEN l_orderkey % 4 = 0 THEN 'Interim' WHEN l_orderkey % 4 = 1 AND l_partkey % 9 = 8 THEN 'Prior1Year' ELSE 'CurrentYear' END,
          CASE WHEN l_partkey % 9 IN (2, 3, 4, 6) THEN 'Instant' ELSE 'Duration' END,
          CASE WHEN l_orderkey % 3 = 0 OR l_suppkey % 7 = 0 THEN '_NonConsolidatedMember' ELSE '' END) AS context,
        max(CASE WHEN l_partkey % 9 = 4 THEN l_discount * 10 ELSE l_extendedprice END) AS value
        FROM {lineitem} GROUP BY 1, 2, 3""",
    "results": """SELECT lpad(CAST(s_suppkey AS STRING), 8, '0') AS code, CASE WHEN s_suppkey % 3 = 2 THEN 'interim' ELSE 'annual' END AS kind,
        concat('199', CAST(5 + s_suppkey * 3 % 5 AS STRING), CASE WHEN s_suppkey % 3 = 2 THEN '-09-30' ELSE '-03-31' END) AS period_end,
        concat('199', CAST(5 + s_suppkey * 3 % 5 AS STRING), CASE WHEN s_suppkey % 3 = 2 THEN '-11-12' ELSE '-06-26' END) AS submit_date,
        sales * CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 1.1 END AS sales, np AS net_profit, sales * 0.07 AS operating_income,
        s_acctbal * 900.0 AS net_assets, abs(s_acctbal) * 2000.0 AS total_assets, CAST(CASE WHEN s_suppkey % 4 = 0 THEN 250.0 * (s_suppkey % 3) - 20 END AS DOUBLE) AS equity_ratio,
        CAST(CASE WHEN s_suppkey % 14 = 0 THEN 12 ELSE 5000 + s_suppkey END AS DOUBLE) AS shares_outstanding, CAST(10 + s_suppkey AS DOUBLE) AS eps,
        CAST(CASE WHEN s_suppkey % 10 = 0 THEN 1e9 ELSE 150.0 END AS DOUBLE) AS bps, CAST(7 AS DOUBLE) AS dps, CAST(CASE WHEN s_suppkey % 6 = 0 THEN 8.25 END AS DOUBLE) AS roe
        FROM {supplier} JOIN {sums} ON s_suppkey = k""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL whose {names} are tables or views."""
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs(text)})


def oracle(text: str, more: dict[str, str] | None = None) -> str:
    """The same text for DuckDB: the views it needs, and those of more, come before it."""
    order: list[str] = []
    views = VIEWS | (more or {})

    def add(name: str) -> None:
        if name in views and name not in order:
            for n in needs(views[name]):
                add(n)
            order.append(name)

    for n in needs(text):
        add(n)
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s)
    head = ",\n".join(f"{n} AS MATERIALIZED ({plain(views[n])})" for n in order)
    body = plain(text).strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head}{',' + re.sub('^WITH (RECURSIVE )?', ' ', body) if body.startswith('WITH') else ' ' + body}"
