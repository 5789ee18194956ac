"""Queries of whole flows: ingestion, cycle and deletion batches, the feed of instructions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingestion, merges
from ..sources import messages, sinks
from ..streaming import ledger, tables
from .catalog import _DEFAULT, _INSTRUCTIONS, _instructions, query
from .fixtures import NOW


def _shaped(df: DataFrame, schema: str, **values) -> DataFrame:
    """The columns of a schema: the given ones, the frame's own by name, else null."""
    of = lambda f: values[f.name] if f.name in values else F.col(f.name) if f.name in df.columns else F.lit(None)
    return df.select(*(of(f).cast(f.dataType).alias(f.name) for f in df.sparkSession.createDataFrame([], schema).schema))


def _refreshes(fx) -> DataFrame:
    """One refresh a user-site, with all its accounts by id and their upstream rows by position."""
    row = F.struct(
        "pos", F.col("external_id").alias("externalId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime"), "amount", "status", "type", "description",
        F.struct(F.col("booking_date").cast("string").alias("bookingDate")).alias("extendedTransaction"),
    )
    rows = fx.upstream.groupBy("account_id").agg(F.array_sort(F.collect_list(row)).alias("transactions"))
    entry = F.struct(
        "id", F.col("external_id").alias("accountId"), F.col("external_id").alias("name"), F.col("type").alias("accountType"), "currency", F.col("balance").alias("currentBalance"), F.coalesce("transactions", F.array()).alias("transactions"),
    )
    sites = fx.accounts.join(rows.withColumnRenamed("account_id", "id"), "id", "left").groupBy("user_id", "user_site_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    text = lambda c: F.col(c).cast("string")
    return sites.select(
        F.concat_ws("-", "user_id", "user_site_id").alias("activityId"), text("user_id").alias("userId"), text("user_site_id").alias("userSiteId"), F.lit("1").alias("siteId"), F.lit("OTHER").alias("provider"),
        F.from_json(F.to_json("entries"), f"array<{messages.ACCOUNT}>").alias("ingestionAccounts"), F.lit(0).alias("offset"),
    )


def _ingested(fx) -> tuple[dict, DataFrame, DataFrame]:
    """What the refreshes change, and the ledger before: one account in five is new, one in fifty has another currency."""
    known = fx.accounts.where("id % 5 <> 0")
    currency = F.when(F.col("id") % 50 == 1, "USD").otherwise(F.col("currency"))
    accounts = _shaped(known.drop("balance", "status", "sort_code", "iban"), ingestion.ACCOUNTS, currency=currency)
    stored = _shaped(fx.stored.where("account_id % 5 <> 0"), ingestion.TRANSACTIONS)
    return ledger.ingest(_refreshes(fx), accounts, stored, NOW), accounts, stored


#: Accounts that the refreshes reach: those in front of the first of their user-site with another currency.
_REACHED = """
listed AS (SELECT *, row_number() OVER (PARTITION BY user_id, user_site_id ORDER BY id) - 1 AS place, user_id || '-' || user_site_id AS activity FROM fx_accounts),
reached AS (SELECT *, CASE WHEN id % 5 <> 0 THEN CAST(id AS VARCHAR) ELSE md5(activity || ':' || user_site_id || ':' || place) END AS own
  FROM listed l WHERE NOT EXISTS (SELECT 1 FROM fx_accounts s WHERE s.id % 50 = 1 AND s.user_id = l.user_id AND s.user_site_id = l.user_site_id AND s.id <= l.id))"""


@query("t1_ingest", f"""
WITH {_DEFAULT}, {_REACHED},
d AS (SELECT done.*, r.activity FROM done JOIN reached r ON r.id = done.account_id WHERE r.id % 5 <> 0),
u AS (SELECT account_id, CAST(pos AS VARCHAR) AS row, external_id, date, CASE WHEN type = 'DEBIT' THEN -amount ELSE amount END AS amount FROM fx_upstream)
SELECT CAST(account_id AS VARCHAR) AS account_id, id, external_id, CAST(date AS VARCHAR) AS date, CAST(amount AS DECIMAL(18,2)) AS amount FROM fx_stored s
WHERE account_id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.account_id = s.account_id AND d.stored_row = s.id AND d.action IN ('DELETE', 'UPDATE'))
UNION ALL SELECT CAST(d.account_id AS VARCHAR), CASE WHEN d.action = 'UPDATE' THEN stored_row ELSE md5(d.account_id || ':' || activity || ':' || upstream_row) END, u.external_id, CAST(u.date AS VARCHAR), u.amount
  FROM d JOIN u ON u.account_id = d.account_id AND u.row = d.upstream_row WHERE d.action IN ('INSERT', 'UPDATE')
UNION ALL SELECT own, md5(own || ':' || activity || ':' || u.row), u.external_id, CAST(u.date AS VARCHAR), u.amount FROM reached r JOIN u ON u.account_id = r.id WHERE r.id % 5 = 0""")
def t1(fx):
    done, _, stored = _ingested(fx)
    left = tables.after(stored, done["transactions"], ledger.TABLES["transactions"].keys)
    return left.select("account_id", "id", "external_id", F.col("date").cast("string").alias("date"), "amount")


@query("t1_ingest_accounts", f"""
WITH {_REACHED}
SELECT own AS id, external_id, currency, balance, TRUE AS fetched FROM reached
UNION ALL SELECT CAST(id AS VARCHAR), external_id, CASE WHEN id % 50 = 1 THEN 'USD' ELSE currency END, NULL, FALSE FROM fx_accounts WHERE id % 5 <> 0 AND id NOT IN (SELECT id FROM reached)""")
def t1_accounts(fx):
    done, accounts, _ = _ingested(fx)
    return tables.after(accounts, done["accounts"], ledger.ACCOUNT_KEYS).select("id", "external_id", "currency", "balance", F.col("last_fetch").isNotNull().alias("fetched"))


@query("t2_latest_cycles", """
WITH last AS (SELECT *, user_id % 2 = 1 OR CAST(cycle_id AS BIGINT) % 2 = 0 AS live FROM fx_cycles_new)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.cycle_id, n.cycle_id) AS cycle_id,
       CAST(CASE WHEN n.user_id % 2 = 0 AND live THEN n.amount + 1 WHEN n.user_id IS NOT NULL THEN n.amount ELSE o.amount END AS DECIMAL(19,2)) AS amount, NOT coalesce(live, FALSE) AS expired
FROM (SELECT * FROM fx_cycles WHERE user_id IN (SELECT user_id FROM fx_cycles_new)) o FULL JOIN last n ON o.user_id = n.user_id AND o.cycle_id = n.cycle_id""")
def t2_cycles(fx):
    """Two messages a user: all new cycles, then (even users) the even ones with another amount."""
    one = F.struct("cycle_id", F.col("amount").cast("decimal(19,2)").alias("amount"), "currency", "period")
    first = fx.cycles_new.groupBy("user_id").agg(F.collect_list(one).alias("cycles")).withColumn("n", F.lit(1))
    even = F.filter("cycles", lambda c: c["cycle_id"].cast("long") % 2 == 0)
    second = first.where("user_id % 2 = 0").select("user_id", F.transform(even, lambda c: c.withField("amount", (c["amount"] + 1).cast("decimal(19,2)"))).alias("cycles"), F.lit(2).alias("n"))
    local = fx.cycles.withColumn("amount", F.col("amount").cast("decimal(19,2)"))
    return merges.latest_cycles(local, first.unionByName(second), ["n"]).select("user_id", "cycle_id", "amount", "expired")


@query("t5_forget_user_sites", """
WITH g AS (SELECT user_id, id FROM fx_accounts WHERE user_site_id % 5 = 0 AND user_id % 2 = 0),
e AS (SELECT * FROM fx_enrichments WHERE (user_id, account_id) IN (SELECT user_id, id FROM g))
SELECT 'accounts' AS part, CAST(id AS VARCHAR) AS key FROM fx_accounts WHERE (user_id, id) NOT IN (SELECT user_id, id FROM g)
UNION ALL SELECT 'transactions', id FROM fx_stored WHERE (user_id, account_id) NOT IN (SELECT user_id, id FROM g)
UNION ALL SELECT 'enrichments', id FROM fx_enrichments WHERE (user_id, account_id) NOT IN (SELECT user_id, id FROM g)
UNION ALL SELECT 'cycles', user_id || ':' || cycle_id FROM fx_cycles WHERE (user_id, cycle_id) NOT IN (SELECT user_id, cycle_id FROM e WHERE cycle_id IS NOT NULL)
UNION ALL SELECT 'feed', CAST(id AS VARCHAR) FROM g UNION ALL SELECT 'feed', user_id || ':' || account_id || ':' || CAST(date AS VARCHAR) || ':' || id FROM fx_stored WHERE (user_id, account_id) IN (SELECT user_id, id FROM g)""")
def t5(fx):
    parts = {"accounts": fx.accounts, "transactions": fx.stored, "enrichments": fx.enrichments, "cycles": fx.cycles}
    done = ledger.forget(fx.accounts.where("user_site_id % 5 = 0 AND user_id % 2 = 0").select("user_id", "user_site_id"), *parts.values())
    out = done["feed"].select(F.lit("feed").alias("part"), F.get_json_object("value", "$.entity_id").alias("key"))
    for name, df in parts.items():
        key = F.concat_ws(":", "user_id", "cycle_id") if name == "cycles" else F.col("id").cast("string")
        out = out.unionByName(tables.after(df, done[name], ledger.TABLES[name].keys).select(F.lit(name).alias("part"), key.alias("key")))
    return out


def _keyed(fx) -> DataFrame:
    asked = _instructions(fx).withColumns({"id": F.when(F.col("action") == "INSERT", F.concat(F.lit("I"), F.col("id"))).otherwise(F.col("id")), "amount": (F.col("amount") + 1).cast("decimal(18,2)")})
    return merges.keyed_changes(fx.stored, asked)


@query("k1_feed", f"""
WITH {_INSTRUCTIONS} SELECT CAST(user_id AS VARCHAR) AS key, user_id || ':' || account_id || ':' || CAST(date AS VARCHAR) || ':' || CASE WHEN action = 'INSERT' THEN 'I' ELSE '' END || id AS entity_id,
  action = 'DELETE' AS gone, CASE WHEN action <> 'DELETE' THEN CAST(amount + 1 AS DECIMAL(18,2)) END AS amount FROM ins WHERE action <> 'IGNORE'""")
def k1_feed(fx):
    feed = sinks.change_envelopes(_keyed(fx), fx.stored.columns, merges.TXN_KEYS)
    read = lambda path, kind: F.get_json_object("value", path).cast(kind)
    return feed.select("key", read("$.entity_id", "string").alias("entity_id"), read("$.delete", "boolean").alias("gone"), read("$.payload.amount", "decimal(18,2)").alias("amount"))


@query("k1_enrichments_left", f"WITH {_INSTRUCTIONS} SELECT account_id, id FROM fx_enrichments WHERE (account_id, id) NOT IN (SELECT account_id, id FROM ins WHERE action = 'DELETE')")
def k1_enrichments(fx):
    gone = merges.keyed_changes(fx.stored, _instructions(fx)).where("deleted").select(*merges.TXN_KEYS)
    return merges.delete_enrichments(fx.enrichments, gone).select("account_id", "id")
