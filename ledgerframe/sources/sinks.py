"""Change feeds and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
ENTITY_KEYS = {"transaction": ["user_id", "account_id", "date", "id"], "account": ["user_id", "id"]}


def offload_envelopes(df: DataFrame, kind: str, delete: Column | bool = False) -> DataFrame:
    """The change feed as (key, value): an envelope in JSON, keyed by user; the payload is left out of deletes."""
    gone = F.lit(delete) if isinstance(delete, bool) else delete
    entity = F.concat_ws(":", *(F.col(c).cast("string") for c in ENTITY_KEYS[kind])) if kind == "transaction" else F.col("id").cast("string")
    payload = F.struct(*df.columns)
    envelope = F.struct(gone.alias("delete"), F.lit(SCHEMA_VERSION).alias("schema_version"), entity.alias("entity_id"), F.when(~gone, payload).alias("payload"))
    return df.select(F.col("user_id").cast("string").alias("key"), F.to_json(envelope).alias("value"))


def change_envelopes(changes: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """The change feed of ``merges.keyed_changes``: a delete for each stored row that goes, then what is written."""
    rows = lambda side, test: changes.where(test).select(*keys, f"{side}.*").select(*columns)
    gone, written = rows("old", "deleted AND old IS NOT NULL"), rows("new", "new IS NOT NULL")
    return offload_envelopes(gone, "transaction", True).unionByName(offload_envelopes(written, "transaction"))


def delete_envelopes(gone: dict[str, DataFrame]) -> DataFrame:
    """The change feed of a cascade of deletes: an envelope for each account and transaction that goes."""
    return offload_envelopes(gone["accounts"], "account", True).unionByName(offload_envelopes(gone["transactions"], "transaction", True))


def backfill_offload(df: DataFrame, kind: str, user_client: DataFrame, dry_run: bool = False) -> DataFrame:
    """The feed of a whole table, accounts only where the user's client is known; counts only on a dry run."""
    chosen = df.join(user_client.select("user_id"), "user_id", "left_semi") if kind == "account" else df
    return chosen.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) if dry_run else offload_envelopes(chosen, kind)


def personal_accounts(accounts: DataFrame) -> DataFrame:
    """Account section of a personal-data export: hashed ids, empty where there is no identification."""
    return accounts.select("user_id", F.sha2(F.col("id").cast("string"), 256).alias("account"), "type", "currency", "balance", F.coalesce("iban", F.lit("")).alias("identification"))


def personal_transactions(txns: DataFrame) -> DataFrame:
    return txns.select("user_id", F.sha2(F.col("account_id").cast("string"), 256).alias("account"), "date", "amount", "description")


def personal_data_export(accounts: DataFrame, txns: DataFrame, path: str) -> None:
    """One folder a user with both sections as CSV."""
    for section, df in (("accounts", personal_accounts(accounts)), ("transactions", personal_transactions(txns))):
        # A user's rows come together first: one file a folder, not one for every task.
        df.repartition("user_id").write.mode("overwrite").partitionBy("user_id").option("header", True).csv(f"{path}/{section}")


def ingestion_finished(upstream: DataFrame, pending: DataFrame, changes: DataFrame, by: list[str]) -> DataFrame:
    """Per message: the range of months, and by account the last external id and the oldest change."""
    from ..operators.reports import last_external_id, month_range, oldest_change

    months = month_range(upstream, pending, by)
    entry = lambda df, value: df.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("account_id").cast("string"), value)))).alias(value))
    last = entry(last_external_id(upstream.where("external_id IS NOT NULL")), "last_external_id")
    oldest = entry(oldest_change(changes), "oldest_change")
    return months.join(last, by, "left").join(oldest, by, "left")
