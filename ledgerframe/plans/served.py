"""Queries of searches, reports with samples and percentiles, and jobs in limited runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import matching, merges, reads, reports
from .catalog import _ONE_STAGE, _ORACLES, STAGE, _sides, j6, query
from .fixtures import NOW


@query("j9_prefix_index", """
WITH spelled AS (SELECT country, merchant_name, search_term AS term, TRUE AS direct FROM fx_merchants
  UNION ALL SELECT country, merchant_name, substr(search_term, 3), FALSE FROM fx_merchants),
t AS (SELECT * FROM spelled WHERE term IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country, term ORDER BY direct DESC, merchant_name) = 1),
q AS (SELECT DISTINCT country, substr(search_term, 1, n) AS prefix FROM fx_merchants CROSS JOIN (VALUES (1), (2), (3), (6), (12)) x(n)),
h AS (SELECT q.country, prefix, merchant_name, min(term) AS term FROM q JOIN t ON t.country = q.country AND starts_with(term, prefix) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY country, prefix ORDER BY term, merchant_name) AS n FROM h),
names AS (SELECT DISTINCT user_id, counterparty_name AS name FROM fx_enrichments WHERE counterparty_name IS NOT NULL)
SELECT country || ':' || prefix AS query_id, CAST(row_number() OVER (PARTITION BY country, prefix ORDER BY merchant_name) AS INTEGER) AS rank, merchant_name FROM f WHERE n <= 10
UNION ALL SELECT 'user:' || user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY name DESC) AS INTEGER), name FROM names""")
def j9_index(fx):
    """Prefixes of several lengths over terms and other spellings; users who ask for nothing get their own names."""
    merchants = fx.merchants.withColumn("direct", F.lit(True))
    spelled = merchants.unionByName(fx.merchants.select("country", "merchant_name", F.substring("search_term", 3, 1000).alias("search_term"), F.lit(False).alias("direct")))
    lengths = F.explode(F.array(*map(F.lit, (1, 2, 3, 6, 12)))).alias("n")
    texts = fx.merchants.select("country", "search_term", lengths).select("country", F.upper(F.col("search_term").substr(F.lit(1), F.col("n"))).alias("text")).distinct()
    asked = texts.select(F.concat_ws(":", "country", F.lower("text")).alias("query_id"), "country", "text", F.lit(None).cast("long").alias("user_id"))
    names = fx.enrichments.where("counterparty_name IS NOT NULL").select("user_id", "counterparty_name").distinct()
    users = names.select("user_id").distinct().select(F.concat(F.lit("user:"), "user_id").alias("query_id"), F.lit("NL").alias("country"), F.lit("").alias("text"), F.col("user_id").cast("long"))
    own = names.withColumn("nth", -F.conv(F.hex(F.substring("counterparty_name", 4, 1)), 16, 10).cast("long") * 1000 - F.coalesce(F.conv(F.hex(F.substring("counterparty_name", 5, 1)), 16, 10).cast("long"), F.lit(0)))
    return reads.merchant_suggest(asked.unionByName(users), reads.prefix_index(spelled, block_terms=500), adjusted=own)


@query("a12_pending_percentiles", f"""
WITH d AS (SELECT a.site_id, a.type, greatest(1, least(90, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(p.t)) / 86400) AS BIGINT))) AS days
  FROM (SELECT user_id, account_id, min(ts) AS t FROM fx_stored WHERE status = 'PENDING' GROUP BY ALL) p JOIN fx_accounts a ON a.user_id = p.user_id AND a.id = p.account_id)
SELECT site_id, type, count(*) AS accounts, quantile_disc(days, 0.5) AS p50, quantile_disc(days, 0.9) AS p90, quantile_disc(days, 0.99) AS p99, sum(days) / count(*)::DOUBLE AS mean, max(days) AS oldest FROM d GROUP BY ALL""")
def a12_percentiles(fx):
    return reports.pending_age_percentiles(fx.stored, fx.accounts, NOW, k=4096)


@query("u3_match_report_samples", _ONE_STAGE + """, h AS (SELECT *, CAST('0x' || substr(md5('42:' || row), 1, 15) AS BIGINT) AS h FROM r),
k AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY user_id, account_id, side, reason ORDER BY h, row) AS place FROM h WINDOW g AS (PARTITION BY user_id, account_id, side, reason))
SELECT user_id, account_id, 'ExternalIdAmountStrict' AS matcher, side, reason, n, place - 1 AS place, row FROM k WHERE place <= 5""")
def u3_samples(fx):
    found = matching.match_report_samples(matching.match_on_equality(_sides(fx), STAGE))
    return found.select("user_id", "account_id", "matcher", "side", "reason", "n", F.posexplode("sample").alias("place", "s")).withColumn("place", F.col("place").cast("long")).select(
        "user_id", "account_id", "matcher", "side", "reason", "n", "place", "s.row"
    )


@query("e6_sync_in_runs", """
WITH p AS (SELECT user_id, account_id, id FROM fx_stored WHERE status = 'PENDING'), x AS (SELECT * FROM p WHERE (user_id, account_id, id) NOT IN (SELECT user_id, account_id, transaction_id FROM fx_analytics)),
g AS (SELECT account_id, (SELECT count(*) FROM x WHERE x.account_id = p.account_id) AS e, count(*) AS a, (SELECT count(*) FROM fx_analytics z WHERE z.account_id = p.account_id AND pending = 2) AS b FROM p GROUP BY account_id)
SELECT 'deleted' AS kind, account_id, id FROM x WHERE account_id IN (SELECT account_id FROM g WHERE a > b AND e = a - b) AND account_id IN (SELECT account_id FROM fx_analytics)
UNION ALL SELECT DISTINCT 'user', user_id, NULL FROM fx_analytics""")
def e6_runs(fx):
    """Three runs of 40 users each, of at most 100: what they delete and whom they pass."""
    b = fx.analytics.withColumnRenamed("transaction_id", "id")
    done, gone = b.select("user_id").limit(0), []
    for _ in range(3):
        deleted, users = merges.sync_run(fx.stored, b, done, limit=40)
        done = done.unionByName(users)
        gone.append(deleted.select(F.lit("deleted").alias("kind"), "account_id", "id"))
    return reduce(lambda x, y: x.unionByName(y), gone).unionByName(done.select(F.lit("user").alias("kind"), F.col("user_id").alias("account_id"), F.lit(None).cast("string").alias("id")))


@query("a7_account_details", """
SELECT user_id, id AS account_id, CASE WHEN id % 3 = 0 THEN 'EXPECTED,' ELSE '' END || 'CLOSING_BOOKED' AS balance_types,
       CASE WHEN balance IS NOT NULL THEN CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'EXPECTED' ELSE 'CLOSING_BOOKED' END WHEN credit_limit IS NOT NULL THEN NULL END AS main_balance_type,
       iban IS NOT NULL AS has_account_number, id % 4 = 0 AS has_account_holder_name, CASE WHEN iban IS NOT NULL AND id % 4 = 0 THEN 'ok' ELSE 'nok' END AS account_quality
FROM fx_accounts""")
def a7_details(fx):
    """Up to two typed balances and one without a type; every second expected balance equals the booked one."""
    one = lambda kind, amount: F.struct(F.lit(kind).cast("string").alias("type"), amount.cast("decimal(18,2)").alias("amount"))
    balance, id_ = F.col("balance"), F.col("id")
    expected = one("EXPECTED", F.when(id_ % 2 == 0, balance).otherwise(balance + 1))
    balances = F.concat(F.when(id_ % 3 == 0, F.array(expected)).otherwise(F.array().cast("array<struct<type:string,amount:decimal(18,2)>>")), F.array(one("CLOSING_BOOKED", balance), one(None, F.lit(0))))
    accounts = fx.accounts.select(
        "user_id", id_.alias("account_id"), balances.alias("balances"), balance.alias("current_balance"), F.lit(None).cast("decimal(18,2)").alias("available_balance"), F.col("iban").alias("number"),
        F.when(id_ % 4 == 0, "holder").alias("holder"),
    )
    return reports.account_details(accounts)


@query("a11_account_matches", f"""
SELECT user_site_id, match_type, match_type <> 'NONE' AND is_normalized AS normalized, count(*) AS n FROM ({_ORACLES["j6_match_accounts"]}) j GROUP BY ALL""")
def a11_matches(fx):
    return reports.account_match_counters(j6(fx), ["user_site_id"])
