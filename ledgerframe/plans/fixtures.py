"""Ledger-shaped views over the TPC-H-like tables; each statement runs in Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NOW = "2001-08-02 12:00:00"
TODAY = "2001-08-02"

VIEWS = {
    "fx_accounts": """
SELECT c_custkey % 100 AS user_id, c_custkey AS id, c_nationkey AS user_site_id, n_regionkey AS site_id, c_name AS external_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'CURRENT_ACCOUNT' WHEN 'BUILDING' THEN 'SAVINGS_ACCOUNT'
            WHEN 'FURNITURE' THEN 'CREDIT_CARD' WHEN 'HOUSEHOLD' THEN 'PREPAID_ACCOUNT' ELSE 'INVESTMENT' END AS type,
       CASE WHEN c_custkey % 4 = 0 THEN 'GBP' ELSE 'EUR' END AS currency,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_acctbal AS DECIMAL(18,2)) END AS balance,
       CASE WHEN c_custkey % 13 = 0 THEN 'DELETED' ELSE 'ENABLED' END AS status,
       'NL' || LPAD(CAST(c_custkey AS STRING), 8, '0') AS iban, CASE WHEN c_custkey % 17 = 0 THEN TRUE ELSE FALSE END AS hidden,
       CASE WHEN c_custkey % 10 = 0 THEN '' END AS sort_code, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS DECIMAL(18,2)) END AS credit_limit,
       CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2000-01-01 00:00:00' END AS created_at
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_stored": """
SELECT o_custkey % 100 AS user_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'E' || CAST(o_orderkey AS STRING) END AS external_id,
       CASE WHEN o_orderstatus = 'P' AND o_orderdate >= TIMESTAMP '2001-01-01 00:00:00' THEN 'PENDING' ELSE 'BOOKED' END AS status,
       CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)) AS amount,
       o_orderpriority AS description, CAST(o_orderdate AS DATE) AS booking_date, o_orderdate AS ts
FROM orders WHERE o_orderkey % 10 <> 1""",
    "fx_upstream": """
SELECT *, ROW_NUMBER() OVER (PARTITION BY account_id ORDER BY date, order_no, copy_no) - 1 AS pos FROM (
  SELECT o_custkey % 100 AS user_id, o_custkey AS account_id, CAST(o_orderdate AS DATE) AS date, o_orderkey AS order_no, copy_no,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'E' || CAST(o_orderkey AS STRING) END AS external_id,
         'BOOKED' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderpriority AS description, CAST(o_orderdate AS DATE) AS booking_date, o_orderdate AS ts
  FROM orders CROSS JOIN (SELECT 0 AS copy_no UNION ALL SELECT 1 AS copy_no) d
  WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND NOT (o_custkey % 7 = 0 AND o_orderkey % 6 = 0)
    AND (copy_no = 0 OR (o_custkey % 9 = 0 AND o_orderkey % 12 = 0))) u""",
    "fx_analytics": """
SELECT user_id, account_id, date, id AS transaction_id, CASE status WHEN 'BOOKED' THEN 1 ELSE 2 END AS pending, status, amount
FROM fx_stored WHERE NOT (status = 'PENDING' AND CAST(id AS BIGINT) % 3 = 0)""",
    "fx_enrichments": """
SELECT user_id, account_id, date, id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN description END AS category,
       CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'CP-' || CAST(account_id % 20 AS STRING) END AS counterparty_name,
       CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN TRUE WHEN CAST(id AS BIGINT) % 3 = 0 THEN FALSE END AS known_merchant,
       CASE WHEN CAST(id AS BIGINT) % 7 = 0 THEN CAST(account_id % 50 AS STRING) END AS cycle_id
FROM fx_stored WHERE CAST(id AS BIGINT) % 4 <> 3""",
    "fx_messages": """
SELECT event_id AS message_id, ts, user_id, user_id * 100 + EXTRACT(DAY FROM ts) AS activity_id, user_id % 10 AS account_id,
       CASE event_type WHEN 'view' THEN 'CATEGORIES' WHEN 'click' THEN 'COUNTER_PARTIES' WHEN 'purchase' THEN 'TRANSACTION_CYCLES'
            WHEN 'signup' THEN 'LABELS' ELSE 'PREPROCESSING' END AS domain, CAST(ts AS DATE) AS date, props
FROM events""",
    "fx_user_client": "SELECT DISTINCT user_id, user_id % 3 AS client_id FROM fx_accounts WHERE user_id % 10 <> 9",
    "fx_merchants": "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN 'NL' ELSE 'GB' END AS country, p_name AS merchant_name, LOWER(p_name) AS search_term FROM part",
    "fx_cycles": """
SELECT user_id, CAST(account_id % 50 AS STRING) AS cycle_id, MIN(amount) AS amount, 'EUR' AS currency, 'P1M' AS period, FALSE AS expired
FROM fx_stored GROUP BY user_id, CAST(account_id % 50 AS STRING)""",
    "fx_cycles_new": """
SELECT user_id, CAST(CAST(cycle_id AS BIGINT) + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS STRING) AS cycle_id, amount + 1 AS amount, currency, period, expired
FROM fx_cycles WHERE user_id % 3 <> 0""",
}


def used_views(sql: str) -> list[str]:
    """Views that a statement needs, those they need before them."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in found:
                visit(VIEWS[name])
                found.append(name)

    visit(sql)
    return found


def with_views(sql: str) -> str:
    """A statement with the views it uses as common table expressions."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in used_views(sql)]
    if not parts:
        return sql
    body = sql.strip()
    rest = f", {body[5:]}" if body[:5].upper() == "WITH " else f" {body}"
    return "WITH " + ", ".join(parts) + rest


class Fixtures:
    """The views as DataFrames over one data folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """A statement over tables and views."""
        whole = with_views(text)
        frames = {t: self.table(t) for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+{t}\b", whole)}
        for t in frames:
            whole = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", whole)
        return self.spark.sql(whole, **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.sql(f"SELECT * FROM fx_{name}")
