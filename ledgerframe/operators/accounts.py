"""Accounts: de-duplication of what came in and matching with what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import is_normal_identification, normal_identification

IDENTITY = ["external_id", "scheme", "number", "currency"]


def dedupe_accounts(upstream: DataFrame, by: list[str]) -> DataFrame:
    """The first account by position of those equal in external id, account number and currency.

    A group of two or more accounts in which one lacks an id or a currency is an
    error, raised when the row is read.
    """
    group = Window.partitionBy(*by)
    first = Window.partitionBy(*by, *IDENTITY).orderBy("pos")
    broken = (F.count("*").over(group) >= 2) & (F.col("external_id").isNull() | F.col("currency").isNull())
    return (
        upstream.withColumn("_broken", broken).withColumn("_nth", F.row_number().over(first))
        .where(F.when(F.col("_broken"), F.raise_error(F.lit("account without external id or currency")).cast("boolean")).otherwise(F.col("_nth") == 1)).drop("_broken", "_nth")
    )


def broken_groups(upstream: DataFrame, by: list[str]) -> DataFrame:
    """Groups that ``dedupe_accounts`` would raise on: two or more accounts, one without an external id or a currency."""
    lacking = F.col("external_id").isNull() | F.col("currency").isNull()
    return upstream.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if(lacking).alias("_lacking")).where("_n >= 2 AND _lacking > 0").select(*by)


def match_accounts(upstream: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """Every upstream account with the stored one it is, if any: rows of (by, pos, stored_id, match_type, is_normalized).

    First rule that hits: equal external id; equal scheme, normal number and
    currency; for credit cards equal normal masked number and currency. Ties go to
    the latest fetch, then the smallest id. A match by external id may be of
    another currency: see ``currency_conflicts``.
    """
    u = upstream.select(*by, "pos", F.col("external_id").alias("u_ext"), F.col("scheme").alias("u_scheme"), F.col("number").alias("u_number"), F.col("currency").alias("u_currency"), F.col("masked").alias("u_masked"), F.col("type").alias("u_type"))
    s = stored.select(*by, F.col("id").alias("stored_id"), "external_id", "scheme", "number", "currency", "masked", "type", "last_fetch")
    un, sn = normal_identification("u_number"), normal_identification("number")
    um, sm = normal_identification("u_masked"), normal_identification("masked")
    rules = [
        (1, "EXTERNAL_ID", u.withColumn("k", F.col("u_ext")), s.withColumn("k", F.col("external_id"))),
        (2, "ACCOUNT_NUMBER", u.withColumn("k", F.concat_ws("|", "u_scheme", un, "u_currency")).where(F.col("u_scheme").isNotNull() & un.isNotNull() & F.col("u_currency").isNotNull()),
         s.withColumn("k", F.concat_ws("|", "scheme", sn, "currency")).where(F.col("scheme").isNotNull() & sn.isNotNull() & F.col("currency").isNotNull())),
        (3, "MASKED_NUMBER", u.withColumn("k", F.concat_ws("|", um, "u_currency")).where((F.col("u_type") == "CREDIT_CARD") & um.isNotNull() & F.col("u_currency").isNotNull()),
         s.withColumn("k", F.concat_ws("|", sm, "currency")).where((F.col("type") == "CREDIT_CARD") & sm.isNotNull() & F.col("currency").isNotNull())),
    ]
    hits = None
    for rank, name, left, right in rules:
        found = left.join(right, [*by, "k"]).select(*by, "pos", "stored_id", "last_fetch", F.lit(rank).alias("rank"), F.lit(name).alias("match_type"))
        hits = found if hits is None else hits.unionByName(found)
    best = Window.partitionBy(*by, "pos").orderBy("rank", F.coalesce("last_fetch", F.lit("1970-01-01").cast("timestamp_ntz")).desc(), "stored_id")
    top = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*by, "pos", "stored_id", "match_type")
    return u.join(top, [*by, "pos"], "left").select(*by, "pos", "stored_id", F.coalesce("match_type", F.lit("NONE")).alias("match_type"), F.coalesce(is_normal_identification("u_scheme", "u_number"), F.lit(False)).alias("is_normalized"))


def currency_conflicts(matches: DataFrame, upstream: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """Matched accounts whose stored currency is another: rows of (by, pos). Their message fails at that place of its list."""
    new = upstream.select(*by, "pos", F.col("currency").alias("_new"))
    old = stored.select(*by, F.col("id").alias("stored_id"), F.col("currency").alias("_old"))
    return matches.join(new, [*by, "pos"]).join(old, [*by, "stored_id"]).where(~F.col("_new").eqNullSafe(F.col("_old"))).select(*by, "pos")


def user_sites_of(accounts: DataFrame, ids: DataFrame) -> DataFrame:
    """User-sites of accounts, for finished events."""
    return ids.join(accounts.select("user_id", F.col("id").alias("account_id"), "user_site_id"), ["user_id", "account_id"])


def accounts_of(accounts: DataFrame, user, user_site=None) -> DataFrame:
    own = accounts.where(F.col("user_id") == F.lit(user))
    return own if user_site is None else own.where(F.col("user_site_id") == F.lit(user_site))


def account_events(before: DataFrame, after: DataFrame) -> DataFrame:
    """CREATED for accounts that were not there before, UPDATED for the others."""
    old = before.select("user_id", "id", F.lit(True).alias("_old")).distinct()
    return after.join(old, ["user_id", "id"], "left").select("user_id", F.col("id").alias("account_id"), F.when(F.col("_old"), "UPDATED").otherwise("CREATED").alias("event"))
