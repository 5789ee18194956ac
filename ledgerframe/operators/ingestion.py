"""Refreshes as one flow: accounts are found or made, transactions reconciled, and all that follows is derived.

``plan_accounts`` takes messages of which each is its user-site's only one and
finds the account of every entry. ``apply_accounts`` reconciles the entries of a
plan, at most one an account, against the stored rows. A message with a bad row
or an account group that cannot be told apart fails as a whole; one with an
account of another currency than the stored one stops there, and what came
before it in the list stays; an account whose matching fails keeps its new
description, and other accounts go on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.messages import split_invalid, upstream_accounts, upstream_transactions
from ..sources.sinks import change_envelopes, offload_envelopes
from .accounts import account_events, broken_groups, currency_conflicts, dedupe_accounts, match_accounts
from .graph import cut
from .matching import KEYS
from .merges import TXN_KEYS, instruction_change, keyed_changes, sparse_upsert
from .projections import to_stored_account, to_stored_txn
from .reports import month_range
from .router import reconcile

MESSAGE = ["user_id", "user_site_id"]
REQUIRED = ["amount", "type", "date_time", "status"]
ACCOUNTS = (
    "user_id string, id string, user_site_id string, site_id string, external_id string, name string, type string, currency string, balance decimal(18,2), available decimal(18,2), "
    "status string, scheme string, number string, masked string, iban string, sort_code string, created_at timestamp_ntz, last_fetch timestamp_ntz"
)
_PARTIES = ", ".join(f"{p}_{s} string" for p in ("creditor", "debtor") for s in ("name", "bban", "iban", "masked_pan", "pan", "sort_code"))
TRANSACTIONS = (
    "user_id string, account_id string, date date, id string, external_id string, status string, amount decimal(18,2), description string, booking_date date, ts timestamp_ntz, time_zone string, "
    f"end_to_end_id string, {_PARTIES}, fill_type string, created_at timestamp_ntz"
)
FAILURES = "activity_id string, user_id string, user_site_id string, account_id string, reason string"


def new_id(*parts: str) -> Column:
    """An id that a repeated run gives again."""
    return F.md5(F.concat_ws(":", *(F.col(p).cast("string") for p in parts)))


def plan_accounts(messages: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, failures) of messages: the entries to apply, with ``account_id``, ``known`` and ``nth`` (of an account's entries)."""
    everything = upstream_accounts(messages)
    place = ["activity_id", *MESSAGE]
    _, bad = split_invalid(upstream_transactions(everything), place, REQUIRED)
    broken = broken_groups(everything, place)
    failed = bad.select(*place, F.lit("INVALID_TRANSACTION").alias("reason")).unionByName(broken.withColumn("reason", F.lit("AMBIGUOUS_ACCOUNTS"))).groupBy(*place).agg(F.min("reason").alias("reason"))
    entries = dedupe_accounts(everything.join(failed, place, "left_anti"), MESSAGE)
    own = accounts.join(entries.select(*MESSAGE).distinct(), MESSAGE, "left_semi")
    matches = match_accounts(entries, own, MESSAGE)
    stops = currency_conflicts(matches, entries, own, MESSAGE).groupBy(*MESSAGE).agg(F.min("pos").alias("stop"))
    nth = Window.partitionBy("user_id", "account_id").orderBy("pos")
    planned = (
        entries.join(matches, [*MESSAGE, "pos"]).join(stops, MESSAGE, "left")
        .withColumn("account_id", F.coalesce("stored_id", new_id("activity_id", "user_site_id", "pos"))).withColumn("known", F.col("stored_id").isNotNull())
        .withColumn("nth", F.row_number().over(nth))
    )
    stopped = planned.where("pos = stop").select(*place, "account_id", F.lit("CURRENCY_DIFFERS").alias("reason"))
    failures = failed.select(*place, F.lit(None).cast("string").alias("account_id"), "reason").unionByName(stopped)
    return planned.where("stop IS NULL OR pos < stop").withColumn("whole", F.col("stop").isNull()), failures


def account_rows(entries: DataFrame, now: str | Column) -> DataFrame:
    """Stored accounts of planned entries, as a patch: null keeps what is stored."""
    references = F.array().cast("array<struct<type:string,value:string>>")
    keep = entries.select("user_id", F.col("account_id").alias("id"), "user_site_id", "site_id", "name", "scheme", "number", "masked")
    shaped = to_stored_account(entries.withColumnRenamed("account_id", "id").withColumn("references", references)).drop("balances")
    return shaped.join(keep, ["user_id", "id"]).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))


def transaction_rows(entries: DataFrame) -> DataFrame:
    """The entries' transactions as stored rows, with what matching needs of the source: ``pos``, ``type``, ``unsigned`` and ``provider``."""
    held = entries.select("activity_id", *MESSAGE, "provider", F.col("account_id").alias("external_id"), F.col("transactions"))
    one = upstream_transactions(held).where("status IS DISTINCT FROM 'HOLD'").withColumnRenamed("account_external_id", "account_id")
    money = lambda m: F.struct(F.col(m)["amount"].alias("amount"), F.col(m)["currency"].alias("currency"))
    rates = F.transform("extended.exchangeRate", lambda r: F.struct(r["currencyFrom"].alias("currency_from"), r["currencyTo"].alias("currency_to"), r["rateFrom"].alias("rate")))
    wide = one.withColumn("details", F.struct(F.col("extended.endToEndId").alias("end_to_end_id"), "pos", "type", F.col("amount").alias("unsigned"), "provider", "activity_id", "user_site_id")).withColumn(
        "extended", F.struct(
            F.to_date(F.substring("extended.bookingDate", 1, 10)).alias("booking_date"), F.col("extended.creditorName").alias("creditor_name"), F.col("extended.debtorName").alias("debtor_name"),
            F.col("extended.creditorAccount").alias("creditor_account"), F.col("extended.debtorAccount").alias("debtor_account"), rates.alias("exchange_rates"), money("extended.originalAmount").alias("original_amount"),
        ),
    )
    # the details ride along as the id, which only the reconciliation can tell
    shaped = to_stored_txn(wide.withColumn("id", F.to_json("details")))
    details = F.from_json("id", wide.select("details").schema["details"].dataType)
    found = shaped.withColumn("d", details).select("*", "d.end_to_end_id", "d.pos", "d.type", "d.unsigned", "d.provider", "d.activity_id", "d.user_site_id").drop("d", "id")
    renamed = {f"{p}_sortcodeaccountnumber": f"{p}_sort_code" for p in ("creditor", "debtor")}
    # the instant in UTC, whatever the session's time zone
    utc = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros("ts") / F.lit(1000000)).cast("decimal(18,6)"))
    return found.withColumnsRenamed(renamed).withColumn("ts", utc)


def as_upstream(rows: DataFrame) -> DataFrame:
    """Transaction rows in the shape that the strategies take."""
    number = lambda p: F.coalesce(*(F.col(f"{p}_{s}") for s in ("bban", "iban", "pan", "masked_pan", "sort_code"))).alias(f"{p}_account")
    return rows.select(
        *KEYS, "pos", "external_id", F.col("unsigned").alias("amount"), "type", "date", "status", "booking_date", "ts", "description", "provider", "debtor_name", "creditor_name",
        number("debtor"), number("creditor"), "end_to_end_id",
    )


@dataclass(frozen=True)
class Ingested:
    """What a pass over planned entries changes and says."""

    accounts: DataFrame
    puts: DataFrame
    gone: DataFrame
    dead_enrichments: DataFrame
    feed: DataFrame
    events: DataFrame
    failures: DataFrame
    #: Per account that went through: what the finished message tells of it.
    processed: DataFrame


def apply_accounts(entries: DataFrame, accounts: DataFrame, stored: DataFrame, now: str | Column) -> Ingested:
    """Applies planned entries, at most one an account, to the stored accounts and transactions.

    ``stored`` has the columns of ``TRANSACTIONS`` and, where it is kept by month, ``month``.
    """
    columns = [c for c in stored.columns if c not in ("month", "bucket")]
    rows = cut(transaction_rows(entries))
    # one job for both: they share their shuffles
    asked, failed = reconcile(as_upstream(rows), stored)
    both = cut(asked.withColumn("outcome", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True))
    instructions, refused = both.where("outcome IS NULL"), both.where("outcome IS NOT NULL").select(*KEYS, "outcome")
    place = entries.select("activity_id", *MESSAGE, "account_id", "known", "whole", "pos")
    failures = refused.join(place, KEYS).select("activity_id", *MESSAGE, "account_id", F.concat(F.lit("RECONCILIATION_"), "outcome").alias("reason"))
    good = place.join(refused, KEYS, "left_anti")

    source = rows.withColumn("upstream_row", F.col("pos").cast("string")).drop("date", "pos", "type", "unsigned", "provider")
    written = instructions.where("action IN ('INSERT', 'UPDATE')").select(*KEYS, "action", "stored_row", "upstream_row", "date", "fill_type").join(source, [*KEYS, "upstream_row"])
    written = written.withColumn("id", F.coalesce("stored_row", new_id("account_id", "activity_id", "upstream_row"))).withColumn("created_at", F.lit(now).cast("timestamp_ntz"))
    deleted = instructions.where("action = 'DELETE'").select(*KEYS, "date", F.col("stored_row").alias("id"), "action")
    types = {f.name: f.dataType for f in stored.schema.fields}
    value = lambda df, c: (F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c)
    asked = written.select("action", *(value(written, c) for c in columns)).unionByName(deleted.select("action", *(value(deleted, c) for c in columns)))
    changes = cut(keyed_changes(stored.select(*columns), asked, TXN_KEYS))
    puts, gone = instruction_change(changes, columns, TXN_KEYS)

    patch = account_rows(entries, now).join(good.select("user_id", F.col("account_id").alias("id"), F.lit(now).cast("timestamp_ntz").alias("last_fetch")), ["user_id", "id"], "left")
    base = accounts.join(patch.select("user_id", "id"), ["user_id", "id"], "left_semi")
    created = base.select("user_id", "id", F.col("created_at").alias("_created"))
    merged = sparse_upsert(base, patch, ["user_id", "id"]).join(created, ["user_id", "id"], "left").withColumn("created_at", F.coalesce("_created", "created_at")).select(*accounts.columns)

    oldest = instructions.where("action <> 'IGNORE'").groupBy(*KEYS).agg(F.min("date").alias("oldest_change"))
    last = rows.where("external_id IS NOT NULL").groupBy(*KEYS).agg(F.max_by("external_id", "pos").alias("last_external_id"))
    held = rows.groupBy(*KEYS).agg(F.min("date").alias("oldest"), F.max("date").alias("newest"))
    pending = stored.where("status = 'PENDING'").join(place.where("known").select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.min("date").alias("oldest_pending"), F.max("date").alias("newest_pending"))
    processed = place.join(good.select(*KEYS, F.lit(True).alias("done")), KEYS, "left").join(oldest, KEYS, "left").join(last, KEYS, "left").join(held, KEYS, "left").join(pending, KEYS, "left")
    return Ingested(
        accounts=merged, puts=puts, gone=gone, dead_enrichments=changes.where("deleted").select(*TXN_KEYS), feed=offload_envelopes(merged, "account").unionByName(change_envelopes(changes, columns, TXN_KEYS)),
        events=account_events(base, merged), failures=failures, processed=processed,
    )


def finished_messages(processed: DataFrame) -> DataFrame:
    """One row a message that went through to its end: months touched, and by account the last external id and the oldest change.

    A message that stopped at an account tells nothing; accounts that failed are not in the maps but count in the months.
    """
    place = ["activity_id", *MESSAGE]
    dates = processed.select(*place, "whole", F.explode(F.array("oldest", "newest")).alias("date"))
    waiting = processed.select(*place, F.explode(F.array("oldest_pending", "newest_pending")).alias("date"), F.lit("PENDING").alias("status"))
    whole = processed.where("whole").select(*place).distinct()
    # of an account's entries in a message the last one counts
    own = processed.groupBy(*place, "account_id").agg(*(F.max_by(c, "pos").alias(c) for c in ("done", "last_external_id", "oldest_change")))
    entries = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("done") & F.col(value).isNotNull(), F.struct("account_id", value)))))
    told = own.groupBy(*place).agg(entries("last_external_id").alias("last_external_id"), entries("oldest_change").alias("oldest_change"))
    months = month_range(dates.where("date IS NOT NULL"), waiting.where("date IS NOT NULL"), place)
    return whole.join(months, place, "left").join(told, place, "left")
