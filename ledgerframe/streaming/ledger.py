"""Streams that keep a user's ledger on disk: refreshes, enrichments and deletions.

Every micro-batch goes through ``Tables.apply``: all its tables change once, also
if the batch comes again after a crash.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import cut
from ..operators.ingestion import ACCOUNTS, TRANSACTIONS, Ingested, apply_accounts, finished_messages, plan_accounts
from ..operators.merges import TXN_KEYS, delete_cascade, latest_cycles, merge_enrichments
from ..sources.messages import cycle_messages, enrichment_rows, in_order
from ..sources.sinks import delete_envelopes
from .activities import SUBSCRIBED, VERSION, wanted_messages
from .tables import Change, Table, Tables, after, buckets, then

ENRICHMENTS = (
    "user_id string, account_id string, date date, id string, category string, sme_category string, personal_category string, labels array<string>, counterparty_name string, "
    "known_merchant boolean, cycle_id string"
)
CYCLES = (
    "user_id string, cycle_id string, cycle_type string, amount decimal(18,2), currency string, period string, model_amount decimal(18,2), model_currency string, model_period string, "
    "label string, subscription boolean, counterparty string, expired boolean"
)
ACCOUNT_KEYS, CYCLE_KEYS = ("user_id", "id"), ("user_id", "cycle_id")


def _by_user() -> dict:
    return {"bucket": buckets("user_id")}


def _by_month() -> dict:
    return {"month": F.date_format("date", "yyyy-MM"), "bucket": buckets("user_id")}


TABLES = {
    "accounts": Table(ACCOUNTS, ACCOUNT_KEYS, _by_user),
    "transactions": Table(TRANSACTIONS, tuple(TXN_KEYS), _by_month),
    "enrichments": Table(ENRICHMENTS, tuple(TXN_KEYS), _by_month),
    "cycles": Table(CYCLES, CYCLE_KEYS, _by_user),
}


def ledger_tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root, TABLES)


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def _near_users(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the users' buckets (at most as many literals as there are buckets), then of the users."""
    found = sorted(r.b for r in users.select(buckets("user_id").alias("b")).distinct().collect())
    return df.where(F.col("bucket").isin(found)).join(users, "user_id", "left_semi") if found else df.limit(0)


def ingest(batch: DataFrame, accounts: DataFrame, stored: DataFrame, now: str) -> dict[str, Change | DataFrame]:
    """What a batch of refreshes changes in the ledger and writes to its logs.

    Messages of one user-site are applied in their order, and so are entries of
    one message that are the same account; each such step sees what the steps
    before it left. Normally there is one step.
    """
    turns = cut(in_order(batch))
    last = turns.agg(F.max("turn")).first()[0] or 0
    users = turns.select(F.col("userId").alias("user_id")).distinct()
    accounts, stored = (_near_users(df, users) if "bucket" in df.columns else df for df in (accounts, stored))
    accounts = accounts.drop("bucket")
    changes: dict[str, Change | None] = {"accounts": None, "transactions": None}
    dead: DataFrame | None = None
    logs: dict[str, DataFrame] = {}

    def add(name: str, df: DataFrame) -> None:
        logs[name] = df if name not in logs else logs[name].unionByName(df)

    for turn in range(1, last + 1):
        entries, failures = plan_accounts(turns.where(F.col("turn") == turn).drop("turn"), accounts)
        entries, told = cut(entries), None
        add("failures", failures)
        for nth in range(1, (entries.agg(F.max("nth")).first()[0] or 0) + 1):
            done: Ingested = apply_accounts(entries.where(F.col("nth") == nth), accounts, stored, now)
            merged = cut(done.accounts)
            steps = {"accounts": Change(merged, merged.limit(0).select(*ACCOUNT_KEYS)), "transactions": Change(done.puts, done.gone)}
            for name, df in (("feed", done.feed), ("account_events", done.events), ("failures", done.failures)):
                add(name, df)
            told = done.processed if told is None else told.unionByName(done.processed)
            dead = done.dead_enrichments if dead is None else dead.unionByName(done.dead_enrichments)
            changes = {name: then(changes[name], step, TABLES[name].keys) for name, step in steps.items()}
            accounts = after(accounts, steps["accounts"], ACCOUNT_KEYS)
            stored = after(stored.drop("month", "bucket"), steps["transactions"], TXN_KEYS)
        if told is not None:
            add("finished", finished_messages(told))
    if dead is not None:
        spark = batch.sparkSession
        changes["enrichments"] = Change(spark.createDataFrame([], ENRICHMENTS), dead)
    return {name: change for name, change in changes.items() if change is not None} | logs


def ingest_stream(refreshes: DataFrame, tables: Tables, checkpoint: str, trigger: dict | None = None, clock: Callable[[], str] = utc_now):
    """Keeps accounts and transactions by the refreshes (``read_refreshes``), and writes the logs feed, account_events, finished and failures."""
    def run(batch: DataFrame, number: int) -> None:
        tables.apply(f"refresh-{number}", lambda t: ingest(batch, t.read("accounts"), t.read("transactions"), clock()))

    return refreshes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def enrich(batch: DataFrame, enrichments: DataFrame, cycles: DataFrame, clients: tuple[DataFrame, DataFrame] | None = None) -> dict[str, Change | DataFrame]:
    """What a batch of enrichment messages (``read_enrichment_lines``) changes; messages at fault go to the log bad_enrichments."""
    batch = cut(batch)
    known = batch.where("fault IS NULL").where(F.col("domain").isin(*SUBSCRIBED) & (F.col("version") == VERSION))
    if clients is not None:
        known = wanted_messages(known.withColumn("user_id", F.col("key.userId")), *clients)
    rows = cut(enrichment_rows(known))
    touched = rows.select(*TXN_KEYS).distinct()
    side = _near_users(enrichments, touched.select("user_id").distinct()) if "bucket" in enrichments.columns else enrichments
    side = side.join(touched, TXN_KEYS, "left_semi").drop("month", "bucket")
    own = cycle_messages(known)
    mine = _near_users(cycles, own.select("user_id").distinct()) if "bucket" in cycles.columns else cycles
    puts = latest_cycles(mine.drop("bucket"), own, ["time", "message_index"])
    spark = batch.sparkSession
    merged = merge_enrichments(side, rows).select(*spark.createDataFrame([], ENRICHMENTS).columns)
    none = lambda df, keys: df.limit(0).select(*keys)
    return {
        "enrichments": Change(cut(merged), none(merged, TXN_KEYS)), "cycles": Change(cut(puts), none(puts, CYCLE_KEYS)),
        "bad_enrichments": batch.where("fault IS NOT NULL").select("fault", "raw", "arrival"),
    }


def enrich_stream(messages: DataFrame, tables: Tables, checkpoint: str, trigger: dict | None = None, clients: Callable[[], tuple[DataFrame, DataFrame]] | None = None):
    """Keeps enrichments and cycles by enrichment messages."""
    def run(batch: DataFrame, number: int) -> None:
        tables.apply(f"enrichment-{number}", lambda t: enrich(batch, t.read("enrichments"), t.read("cycles"), clients() if clients else None))

    return messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def forget(targets: DataFrame, accounts: DataFrame, stored: DataFrame, enrichments: DataFrame, cycles: DataFrame) -> dict[str, Change | DataFrame]:
    """What the deletion of user-sites (user_id, user_site_id) removes from the four tables, and the feed of it."""
    targets = cut(targets.distinct())
    users = targets.select("user_id").distinct()
    near = [_near_users(df, users) if "bucket" in df.columns else df for df in (accounts, stored, enrichments, cycles)]
    plain = [df.drop("month", "bucket") for df in near]
    gone = {name: cut(df) for name, df in delete_cascade(targets, *plain).items()}
    change = {name: Change(df.limit(0), df.select(*TABLES[name].keys)) for name, df in gone.items()}
    return change | {"feed": delete_envelopes(gone)}


def forget_stream(events: DataFrame, tables: Tables, checkpoint: str, trigger: dict | None = None):
    """Deletes user-sites for DELETE_USER_SITE events (user_id, user_site_id, payload_type); other events mean nothing.

    An event without a user is an error, as it cannot be told whose site it is.
    """
    def run(batch: DataFrame, number: int) -> None:
        wanted = batch.where("payload_type = 'DELETE_USER_SITE'")
        sure = F.when(F.col("user_id").isNull(), F.raise_error(F.lit("deletion of a user-site without a user"))).otherwise(F.col("user_id")).alias("user_id")
        targets = wanted.select(sure, "user_site_id")
        tables.apply(f"deletion-{number}", lambda t: forget(targets, *(t.read(n) for n in ("accounts", "transactions", "enrichments", "cycles"))))

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
