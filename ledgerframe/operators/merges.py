"""Merges and deletes: every operator returns the next snapshot or the rows that change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut

TXN_KEYS = ["user_id", "account_id", "date", "id"]


def same(left: list[str], prefix: str):
    """Null-safe equality of key columns with their prefixed copies."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in left))


def sparse_upsert(base: DataFrame, patch: DataFrame, keys: list[str], always_overwrite: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both by key; null in the patch keeps the old value, except in ``always_overwrite`` columns."""
    values = [c for c in base.columns if c not in keys]
    new = patch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values if c in patch.columns), F.lit(True).alias("_patched"))

    def merged(c: str):
        if c not in patch.columns:
            return F.col(c)
        return (F.when(F.col("_patched"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in always_overwrite else F.coalesce(f"_new_{c}", c)).alias(c)

    return base.join(new, keys, "full").select(*keys, *(merged(c) for c in values))


def apply_instructions(stored: DataFrame, instructions: DataFrame, keys: list[str] = TXN_KEYS) -> DataFrame:
    """The next snapshot: deletes, then inserts, then updates. Instructions carry action and the stored columns.

    An update keeps the stored ``created_at`` where the table has one.
    """
    deletes = instructions.where("action = 'DELETE'").select(*keys)
    puts = instructions.where("action IN ('INSERT', 'UPDATE')")
    last = puts.groupBy(*keys).agg(F.max_by(F.struct(*(F.col(c) for c in stored.columns if c not in keys)), F.when(F.col("action") == "UPDATE", 1).otherwise(0)).alias("v"))
    new = last.select(*keys, "v.*")
    if "created_at" in stored.columns:
        old = stored.select(*keys, F.col("created_at").alias("_created"))
        new = new.join(old, keys, "left").withColumn("created_at", F.coalesce("_created", "created_at")).drop("_created")
    return stored.join(deletes, keys, "left_anti").join(new.select(*keys), keys, "left_anti").unionByName(new.select(*stored.columns))


def keyed_changes(stored: DataFrame, instructions: DataFrame, keys: list[str] = TXN_KEYS) -> DataFrame:
    """One row a key that instructions touch: (keys, deleted, old, new), from one pass over both sides.

    ``old`` is the stored row and ``new`` the row after an insert or update (an
    update counts over an insert), each a struct of the other columns, or null.
    Everything that follows from the instructions is read off these rows: the
    next snapshot, the change feed, and the enrichments that go.
    """
    values = [c for c in stored.columns if c not in keys]
    row = F.struct(*values)
    put = F.col("action").isin("INSERT", "UPDATE")
    asked = instructions.where("action <> 'IGNORE'").select(
        *keys, row.alias("row"), F.lit(False).alias("_stored"), (F.col("action") == "DELETE").alias("_gone"), F.when(put, F.when(F.col("action") == "UPDATE", 2).otherwise(1)).alias("_put"),
    )
    held = stored.join(asked.select(*keys).distinct(), keys, "left_semi").select(
        *keys, row.alias("row"), F.lit(True).alias("_stored"), F.lit(False).alias("_gone"), F.lit(None).cast("int").alias("_put"),
    )
    found = held.unionByName(asked).groupBy(*keys).agg(
        F.bool_or("_gone").alias("deleted"), F.max_by(F.when(F.col("_stored"), F.col("row")), F.when(F.col("_stored"), F.lit(1))).alias("old"), F.max_by(F.when(F.col("_put").isNotNull(), F.col("row")), "_put").alias("new"),
    )
    if "created_at" in values:
        found = found.withColumn("new", F.when(F.col("new").isNotNull(), F.col("new").withField("created_at", F.coalesce("old.created_at", "new.created_at"))))
    return found


def instruction_change(changes: DataFrame, columns: list[str], keys: list[str] = TXN_KEYS) -> tuple[DataFrame, DataFrame]:
    """(rows to put, keys to remove) of keyed changes; a key that is deleted and written again is put."""
    puts = changes.where("new IS NOT NULL").select(*keys, "new.*").select(*columns)
    return puts, changes.where("deleted AND new IS NULL").select(*keys)


def touched_months(instructions: DataFrame, date_col: str = "date") -> list[str]:
    """The months that inserts, updates and deletes fall in; a handful whatever the number of instructions."""
    changes = instructions.where("action <> 'IGNORE'").select(F.date_format(date_col, "yyyy-MM").alias("month"))
    return sorted(r.month for r in changes.distinct().collect())


def write_touched_months(snapshot: DataFrame, path: str, date_col: str = "date", months: list[str] | None = None) -> None:
    """Overwrites month partitions: those that the snapshot has rows of, or just ``months``.

    Of ``months``, those without a row in the snapshot are emptied: their folders go.
    """
    rows = snapshot.withColumn("month", F.date_format(date_col, "yyyy-MM"))
    if months is not None:
        rows = rows.where(F.col("month").isin(*months)) if months else rows.limit(0)
        left = {r.month for r in rows.select("month").distinct().collect()}
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    for month in sorted(set(months or ()) - (left if months is not None else set())):
        folder = snapshot.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}")
        folder.getFileSystem(snapshot.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_instructions(instructions: DataFrame, path: str, keys: list[str] = TXN_KEYS) -> list[str]:
    """Applies instructions to a table by months: only touched months are read and written; returns them."""
    months = touched_months(instructions)
    if months:
        stored = instructions.sparkSession.read.parquet(path).where(F.col("month").isin(*months)).drop("month")
        write_touched_months(apply_instructions(stored, instructions, keys), path, months=months)
    return months


def cycle_changeset(local: DataFrame, upstream: DataFrame) -> DataFrame:
    """ADDED, UPDATED (the upstream version) and DELETED (the local one) cycles of the users in the batch."""
    keys = ["user_id", "cycle_id"]
    values = [c for c in upstream.columns if c not in keys]
    mine = local.join(upstream.select("user_id").distinct(), "user_id", "left_semi").select(*keys, F.struct(*values).alias("_old"))
    both = mine.join(upstream.select(*keys, F.struct(*values).alias("_new")), keys, "full")
    change = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "DELETED").otherwise("UPDATED")
    return both.select(*keys, change.alias("change"), F.coalesce("_new", "_old").alias("v")).select(*keys, "change", "v.*")


def apply_cycles(local: DataFrame, changes: DataFrame) -> DataFrame:
    """Cycles after a change set: deleted ones stay as expired; an added or updated one must not be expired."""
    keys = ["user_id", "cycle_id"]
    checked = F.when((F.col("change") != "DELETED") & F.col("expired"), F.raise_error(F.lit("an added or updated cycle is expired")).cast("boolean")).otherwise(F.col("change") == "DELETED")
    new = changes.withColumn("expired", checked).select(*local.columns)
    return local.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest_cycles(local: DataFrame, messages: DataFrame, order: list[str]) -> DataFrame:
    """Cycles of the users of a batch of cycle messages, as if the messages were applied one after another.

    ``messages`` has one row a message: user_id, the columns of ``order`` and
    ``cycles``, an array of structs with cycle_id and the other columns of
    ``local``. A message replaces all of its user's cycles: what the last one lists
    is live, everything else known of the user is expired, with the values that
    were seen last. One grouping by user and cycle, whatever the number of messages.
    """
    keys = ["user_id", "cycle_id"]
    values = [c for c in local.columns if c not in (*keys, "expired")]
    place = F.struct(F.lit(1).alias("came"), *order)
    ends = messages.groupBy("user_id").agg(F.max(place).alias("_end"))
    listed = messages.select("user_id", place.alias("_at"), F.explode("cycles").alias("c")).select("user_id", "c.cycle_id", "_at", F.struct(*(F.col(f"c.{c}").alias(c) for c in values)).alias("v"))
    before = F.struct(F.lit(0).alias("came"), *(F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in order))
    mine = local.join(ends.select("user_id"), "user_id", "left_semi").select(*keys, before.alias("_at"), F.struct(*values).alias("v"))
    seen = mine.unionByName(listed).groupBy(*keys).agg(F.max("_at").alias("_last"), F.max_by("v", "_at").alias("v"))
    return seen.join(ends, "user_id").select(*keys, "v.*", (~F.col("_last").eqNullSafe(F.col("_end"))).alias("expired")).select(*local.columns)


def delete_cascade(targets: DataFrame, accounts: DataFrame, txns: DataFrame, enrichments: DataFrame, cycles: DataFrame) -> dict[str, DataFrame]:
    """What goes with accounts (columns of ``targets``: user_id and, as wanted, user_site_id or id): the
    accounts, their transactions and enrichments, and the cycles that those enrichments point at."""
    gone = accounts.join(targets, [c for c in ("user_id", "user_site_id", "id") if c in targets.columns], "left_semi")
    account = gone.select("user_id", F.col("id").alias("account_id"))
    dead = enrichments.join(account, ["user_id", "account_id"], "left_semi")
    return {
        "accounts": gone, "transactions": txns.join(account, ["user_id", "account_id"], "left_semi"), "enrichments": dead,
        "cycles": cycles.join(dead.where("cycle_id IS NOT NULL").select("user_id", "cycle_id"), ["user_id", "cycle_id"], "left_semi"),
    }


def retention_targets(txns: DataFrame, user_client: DataFrame, client, today, days: int = 365) -> DataFrame:
    """Transactions of a client's users that are older than ``days``."""
    users = user_client.where(F.col("client_id") == F.lit(client)).select("user_id")
    return txns.join(users, "user_id", "left_semi").where(F.col("date") < F.date_sub(F.lit(today).cast("date"), days))


def retention_delete(txns: DataFrame, user_client: DataFrame, client, today, days: int = 365, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row of counts: seen, can_delete, did_delete, users, accounts, users without a client."""
    limit = F.date_sub(F.lit(today).cast("date"), days)
    known = txns.join(user_client.select("user_id", "client_id"), "user_id", "left")
    old = (F.col("client_id") == F.lit(client)) & (F.col("date") < limit)
    old = F.coalesce(old, F.lit(False))
    counts = known.agg(
        F.count("*").alias("seen"), F.count_if(old).alias("can_delete"), F.count_if(old & F.lit(not dry_run)).alias("did_delete"), F.count_distinct(F.when(old, F.col("user_id"))).alias("users"),
        F.count_distinct(F.when(old, F.struct("user_id", "account_id"))).alias("accounts"), F.count_distinct(F.when(F.col("client_id").isNull(), F.col("user_id"))).alias("users_without_client"),
    )
    return (txns if dry_run else known.where(~old).select(*txns.columns)), counts


def sync_delete_pending(a: DataFrame, b: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Pending rows of A to delete: not in B, where A has more pending rows than B by exactly their number.

    ``a`` and ``b`` have user_id, account_id, id and status; users in ``done`` are passed over.
    """
    keys = ["user_id", "account_id"]
    if done is not None:
        a = a.join(done.select("user_id"), "user_id", "left_anti")
    pa_, pb = a.where("status = 'PENDING'"), b.where("status = 'PENDING'")
    only = pa_.join(b.select(*keys, "id"), [*keys, "id"], "left_anti")
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    guard = (
        count(only, "extra").join(count(pa_, "n_a"), keys).join(count(pb, "n_b"), keys, "left")
        .where((F.col("n_a") > F.coalesce("n_b", F.lit(0))) & (F.col("extra") == F.col("n_a") - F.coalesce("n_b", F.lit(0))))
    )
    return only.join(guard, keys, "left_semi")


def sync_run(a: DataFrame, b: DataFrame, done: DataFrame, limit: int | None = None, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """One run of the sync job: (pending rows of A to delete, users that are through after it).

    The users of B that ``done`` (user_id) does not have are taken in the order of
    a hash of their ids, at most ``limit``, so that runs cut off anywhere go on
    where the last one ended. A dry run looks at all users, those that are through
    included, and none is through after it; what it returns would be deleted.
    """
    users = b.select("user_id").distinct()
    if not dry_run:
        users = users.join(done.select("user_id"), "user_id", "left_anti")
        if limit is not None:
            users = users.orderBy(F.xxhash64("user_id"), "user_id").limit(limit)
    users = cut(users)
    mine = lambda df: df.join(users, "user_id", "left_semi")
    compared = mine(b).select("user_id", "account_id").distinct()
    gone = sync_delete_pending(mine(a).join(compared, ["user_id", "account_id"], "left_semi"), mine(b))
    return gone, users.limit(0) if dry_run else users


def set_hidden(accounts: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts with the flag set, and the users whose whole request fails for a missing or unknown account id."""
    asked = updates.select("user_id", F.col("account_id").alias("id"), F.col("hidden").alias("_hidden"))
    known = accounts.select("user_id", "id", F.lit(True).alias("_known"))
    failed = asked.join(known, ["user_id", "id"], "left").where("_known IS NULL").select("user_id").distinct()
    good = asked.join(failed, "user_id", "left_anti").groupBy("user_id", "id").agg(F.bool_or("_hidden").alias("_hidden"))
    return accounts.join(good, ["user_id", "id"], "left").withColumn("hidden", F.coalesce("_hidden", "hidden")).select(*accounts.columns), failed


def move_user_site(accounts: DataFrame, moves: DataFrame) -> DataFrame:
    """Accounts (or analytics copies) under their new user-site."""
    to = moves.select("user_id", "id", F.col("new_user_site_id").alias("_to"))
    return accounts.join(to, ["user_id", "id"], "left").withColumn("user_site_id", F.coalesce("_to", "user_site_id")).select(*accounts.columns)


def last_known(patches: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One patch a key: per column the last value in order that is not null."""
    values = [c for c in patches.columns if c not in keys and c not in order]
    place = F.struct(*order)
    return patches.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in values))


def merge_enrichments(side: DataFrame, messages: DataFrame, keys: list[str] = TXN_KEYS) -> DataFrame:
    """The side table after a batch of enrichment messages in any order of domains.

    ``messages`` has the keys, time, message_index, domain and the fields of all
    domains; a counterparty without a name is skipped with its flag; messages on
    one key apply in order of (time, message_index).
    """
    of = lambda domain, c: F.when(F.col("domain") == domain, F.col(c))
    named = F.col("counterparty_name").isNotNull()
    typed = [of("CATEGORIES", c).alias(c) for c in ("sme_category", "personal_category") if c in messages.columns]
    patch = messages.select(
        *keys, "time", "message_index", *typed, of("CATEGORIES", "category").alias("category"), of("LABELS", "labels").alias("labels"),
        F.when(named, of("COUNTER_PARTIES", "counterparty_name")).alias("counterparty_name"), F.when(named, of("COUNTER_PARTIES", "known_merchant")).alias("known_merchant"),
        of("TRANSACTION_CYCLES", "cycle_id").alias("cycle_id"),
    )
    return sparse_upsert(side, last_known(patch, keys, ["time", "message_index"]), keys)


def delete_enrichments(side: DataFrame, gone: DataFrame) -> DataFrame:
    """The side table without the rows of deleted transactions or accounts, by the columns of ``gone``."""
    return side.join(gone, [c for c in TXN_KEYS if c in gone.columns], "left_anti")
