"""Aggregated reports over all users and accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

KEYS = ["user_id", "account_id"]
# The order of account groups.
GROUP_ORDER = ("CURRENT_ACCOUNT", "CREDIT_CARD", "SAVINGS_ACCOUNT", "PREPAID_ACCOUNT", "PENSION", "INVESTMENT", "FOREIGN_CURRENCY", "UNKNOWN")


def retrieval_lower_bound(accounts: DataFrame, txns: DataFrame, now: str, special_site=None, horizon_days: int = 90) -> DataFrame:
    """Per user-site the instant from which transactions are to be fetched again (null: no bound).

    The newest booked instant that precedes every pending one, over all accounts
    of the user-site, less a day; none if some account has pending rows without
    one; the newest booked instant, less a day, if nothing is pending. At the
    special site the bound is no older than a month, and then no day is taken off.
    """
    recent = txns.where((F.col("date") >= F.date_sub(F.lit(now).cast("timestamp_ntz"), horizon_days)) & F.col("ts").isNotNull())
    pending = recent.where("status = 'PENDING'").groupBy(*KEYS).agg(F.min("ts").alias("oldest_pending"))
    booked = recent.where("status = 'BOOKED'").join(pending, KEYS, "left").groupBy(*KEYS).agg(
        F.max("ts").alias("newest_booked"), F.max(F.when(F.col("ts") <= F.col("oldest_pending"), F.col("ts"))).alias("before")
    )
    per_account = accounts.select("user_id", "user_site_id", "site_id", F.col("id").alias("account_id")).join(pending, KEYS, "left").join(booked, KEYS, "left")
    per_site = per_account.groupBy("user_id", "user_site_id").agg(
        F.min("site_id").alias("site_id"), F.min("oldest_pending").alias("oldest_pending"), F.max("newest_booked").alias("newest_booked"),
        F.when(~F.bool_or(F.col("oldest_pending").isNotNull() & F.col("before").isNull()), F.min("before")).alias("before"),
    )
    month_ago = F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL 1 MONTH")
    special = F.lit(False) if special_site is None else F.col("site_id") == F.lit(special_site)
    day = F.expr("INTERVAL 1 DAY")
    bound = (
        F.when(F.col("before").isNotNull() & special & (F.col("before") < month_ago), month_ago).when(F.col("before").isNotNull(), F.col("before") - day)
        .when(F.col("oldest_pending").isNull(), F.col("newest_booked") - day)
    )
    return per_site.select("user_id", "user_site_id", bound.alias("lower_bound"))


def account_groups(accounts: DataFrame, preferred: str = "EUR") -> DataFrame:
    """Totals per user, group and currency over visible accounts; a currency with an unknown balance has no total."""
    kind = F.coalesce("type", F.lit("UNKNOWN"))
    foreign = (kind != "UNKNOWN") & (F.col("currency").isNull() | (F.col("currency") != preferred))
    group = F.when(foreign, "FOREIGN_CURRENCY").otherwise(kind)
    visible = (F.col("status") != "DELETED") & ~F.coalesce("hidden", F.lit(False)) & F.col("currency").isNotNull()
    totals = accounts.withColumn("account_group", group).where(visible).groupBy("user_id", "account_group", "currency").agg(F.sum("balance").alias("total"), F.count_if(F.col("balance").isNull()).alias("unknown"))
    order = F.array_position(F.array(*map(F.lit, GROUP_ORDER)), F.col("account_group"))
    return totals.where("unknown = 0").select("user_id", order.cast("int").alias("group_no"), "account_group", "currency", "total")


def balance_accuracy(accounts: DataFrame, instructions: DataFrame, kinds: tuple[str, ...] = ("current", "available")) -> DataFrame:
    """Per account and balance kind: NOT_PRESENT, CANT_RECONCILE if anything is deleted, else whether the balance before
    (0 for a new account) plus the inserted amounts is the reported one."""
    change = instructions.groupBy(*KEYS).agg(F.count_if(F.col("action") == "DELETE").alias("deletes"), F.coalesce(F.sum(F.when(F.col("action") == "INSERT", F.col("amount"))), F.lit(0)).alias("inserted"))
    both = accounts.join(change, KEYS, "left")

    def verdict(kind: str) -> Column:
        now, before = F.col(f"{kind}_balance"), F.coalesce(f"previous_{kind}_balance", F.lit(0))
        return (
            F.when(now.isNull(), "NOT_PRESENT").when(F.coalesce("deletes", F.lit(0)) > 0, "CANT_RECONCILE")
            .when(before + F.coalesce("inserted", F.lit(0)) == now, "ACCURATE").otherwise("INACCURATE")
        )

    return both.select(*KEYS, *(verdict(k).alias(f"{k}_accuracy") for k in kinds)).unpivot(KEYS, [f"{k}_accuracy" for k in kinds], "kind", "verdict")


def start_balance_check(accounts: DataFrame, instructions: DataFrame, now: str, months: int = 18) -> DataFrame:
    """New accounts with balances and inserts only, none older than ``months``: does a sum of the amounts as given
    equal a balance, for booked or all rows, up to now or to midnight?"""
    usable = instructions.groupBy(*KEYS).agg(F.bool_and(F.col("action") == "INSERT").alias("ok"), F.min("date").alias("oldest"))
    limit = F.expr(f"CAST(TIMESTAMP_NTZ '{now}' - INTERVAL {months} MONTH AS DATE)")
    now_, midnight = F.lit(now).cast("timestamp_ntz"), F.date_trunc("day", F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    sums = instructions.groupBy(*KEYS).agg(*(
        F.coalesce(F.sum(F.when((F.col("ts") <= upto) & ok, F.col("amount"))), F.lit(0).cast("decimal(18,2)")).alias(name)
        for name, upto, ok in (
            ("booked_now", now_, F.col("status") == "BOOKED"), ("all_now", now_, F.lit(True)), ("booked_midnight", midnight, F.col("status") == "BOOKED"), ("all_midnight", midnight, F.lit(True)),
        )
    ))
    chosen = accounts.where("is_new").join(usable.where(F.col("ok") & (F.col("oldest") >= limit)), KEYS).join(sums, KEYS)
    long = chosen.unpivot([*KEYS, "balances"], ["booked_now", "all_now", "booked_midnight", "all_midnight"], "selection", "total")
    return long.select(*KEYS, "selection", "total", F.explode("balances").alias("b")).select(*KEYS, "selection", F.col("b.type").alias("balance_type"), (F.col("total") == F.col("b.amount")).alias("equal"))


def old_pending(txns: DataFrame, accounts: DataFrame, today: str, days: int = 40, no_site=0) -> DataFrame:
    """Pending rows older than ``days``: counts by date, by site (an unknown account has the zero site) and in total."""
    old = txns.where((F.col("status") == "PENDING") & (F.col("date") < F.date_sub(F.lit(today).cast("date"), days)))
    sites = accounts.select("user_id", F.col("id").alias("account_id"), "site_id")
    joined = old.join(sites, KEYS, "left").select(F.col("date").cast("string").alias("d"), F.coalesce("site_id", F.lit(no_site)).cast("string").alias("s"))
    sets = joined.groupingSets([["d"], ["s"], []], "d", "s").agg(F.count("*").alias("n"), F.grouping("d").alias("gd"), F.grouping("s").alias("gs"))
    kind = F.when(F.col("gd") == 0, "date").when(F.col("gs") == 0, "site").otherwise("total")
    return sets.select(kind.alias("kind"), F.coalesce("d", "s", F.lit("")).alias("key"), "n")


def ingestion_report(instructions: DataFrame, today: str, old_days: int = 40) -> DataFrame:
    """Per account what a refresh did, and how well new rows are described.

    Quality is the lesser of the shares of new rows with a counterparty number and
    name, half up to two places, or n/a.
    """
    new = F.col("action") == "INSERT"
    good = lambda c: F.count_if(new & F.col(c).isNotNull() & (F.trim(F.col(c)) != ""))
    out = instructions.groupBy(*KEYS).agg(
        F.count("*").alias("total"), F.min("date").alias("oldest"), F.max("date").alias("newest"), F.count_if(new).alias("new"), F.count_if(F.col("action") == "DELETE").alias("deleted"),
        F.count_if(F.col("action") == "UPDATE").alias("updated"), F.count_if(F.col("action") == "IGNORE").alias("unchanged"), good("counterparty_number").alias("with_number"), good("counterparty_name").alias("with_name"),
        F.count_if(F.col("date") < F.date_sub(F.lit(today).cast("date"), old_days)).alias("older"),
    )
    share = F.round(F.least("with_number", "with_name").cast("decimal(18,4)") / F.col("new"), 2).cast("decimal(5,2)")
    return out.withColumn("quality", F.when(F.col("new") > 0, share.cast("string")).otherwise("n/a"))


def account_details(accounts: DataFrame) -> DataFrame:
    """What a refresh's report says of its accounts: balance types, the type of the main balance, and whether number and holder are known.

    ``balances`` (type, amount) keep their order; the main balance is the current
    one, else the available one, and its type that of the first balance of its amount.
    """
    main = F.coalesce("current_balance", "available_balance")
    typed = F.filter("balances", lambda b: b["type"].isNotNull())
    equal = F.filter("balances", lambda b: b["amount"] == main)
    has = lambda c: F.col(c).isNotNull()
    return accounts.select(
        *KEYS, F.array_join(F.coalesce(F.transform(typed, lambda b: b["type"]), F.array()), ",").alias("balance_types"), F.get(equal, 0)["type"].alias("main_balance_type"),
        has("number").alias("has_account_number"), has("holder").alias("has_account_holder_name"), F.when(has("number") & has("holder"), "ok").otherwise("nok").alias("account_quality"),
    )


def account_match_counters(matches: DataFrame, by: list[str]) -> DataFrame:
    """How incoming accounts found their stored ones: counts by match type and whether the number was in normal form (never so without a match)."""
    normal = (F.col("match_type") != "NONE") & F.col("is_normalized")
    return matches.groupBy(*by, "match_type", normal.alias("normalized")).agg(F.count("*").alias("n"))


def month_range(upstream: DataFrame, pending: DataFrame, by: list[str]) -> DataFrame:
    """First and last month over upstream dates and stored pending dates of the accounts."""
    both = upstream.select(*by, "date").unionByName(pending.where("status = 'PENDING'").select(*by, "date"))
    return both.groupBy(*by).agg(F.date_format(F.min("date"), "yyyy-MM").alias("first_month"), F.date_format(F.max("date"), "yyyy-MM").alias("last_month"))


def last_external_id(upstream: DataFrame) -> DataFrame:
    """External id of the last row in list order; accounts without rows are left out."""
    return upstream.groupBy(*KEYS).agg(F.max_by("external_id", "pos").alias("last_external_id"))


def oldest_change(instructions: DataFrame) -> DataFrame:
    return instructions.where("action <> 'IGNORE'").groupBy(*KEYS).agg(F.min("date").alias("oldest_change"))


def balance_presence(accounts: DataFrame, by: list[str]) -> DataFrame:
    """Accounts by balance type they report; NONE for those without."""
    kinds = F.when(F.size("balances") > 0, F.transform("balances", lambda b: b["type"])).otherwise(F.array(F.lit("NONE")))
    return accounts.select(*by, F.explode(F.array_distinct(kinds)).alias("balance_type")).groupBy(*by, "balance_type").agg(F.count("*").alias("n"))


def quality_counters(rows: DataFrame, by: list[str], today: str) -> DataFrame:
    """Presence and quality of incoming transactions in long form."""
    day = F.lit(today).cast("date")
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    counters = {
        "future_booked": (F.col("date") > day) & (F.col("status") == "BOOKED"), "future_pending": (F.col("date") > day) & (F.col("status") == "PENDING"),
        "remittance_both": ~blank("description") & ~blank("structured"), "remittance_none": blank("description") & blank("structured"),
        "debtor_on_credit": (F.col("amount") >= 0) & ~blank("debtor_name"), "creditor_on_debit": (F.col("amount") < 0) & ~blank("creditor_name"),
    }
    return rows.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in counters.items())).unpivot(by, list(counters), "counter", "n")


def pending_age_distribution(txns: DataFrame, accounts: DataFrame, now: str) -> DataFrame:
    """Accounts by site, type and whole days of their oldest pending row, in buckets of 1 to 90 days."""
    oldest = txns.where("status = 'PENDING' AND ts IS NOT NULL").groupBy(*KEYS).agg(F.min("ts").alias("oldest"))
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))) / 86400)
    known = accounts.select("user_id", F.col("id").alias("account_id"), "site_id", "type")
    return oldest.join(known, KEYS).groupBy("site_id", "type", F.greatest(F.lit(1), F.least(F.lit(90), age)).cast("int").alias("days")).agg(F.count("*").alias("n"))


#: Size of the quantile sketches: a rank is off by about 1.3 per cent at most, with 99 % certainty.
SKETCH_K = 200


def pending_age_percentiles(txns: DataFrame, accounts: DataFrame, now: str, ranks: tuple[float, ...] = (0.5, 0.9, 0.99), k: int = SKETCH_K) -> DataFrame:
    """Percentiles of the ages that ``pending_age_distribution`` counts, by site and type, with the accounts, the mean and the oldest.

    Ages go into a mergeable quantile sketch, one small state a group in each
    task, so a site of any size is one aggregate; up to ``k`` accounts it is exact.
    """
    oldest = txns.where("status = 'PENDING' AND ts IS NOT NULL").groupBy(*KEYS).agg(F.min("ts").alias("oldest"))
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))) / 86400)
    known = accounts.select("user_id", F.col("id").alias("account_id"), "site_id", "type")
    days = oldest.join(known, KEYS).withColumn("days", F.greatest(F.lit(1), F.least(F.lit(90), age)).cast("long"))
    sketched = days.groupBy("site_id", "type").agg(F.kll_sketch_agg_bigint("days", F.lit(k)).alias("s"), F.count("*").alias("accounts"), F.sum("days").alias("total"), F.max("days").alias("oldest"))
    return sketched.select(
        "site_id", "type", "accounts", *(F.kll_sketch_get_quantile_bigint("s", F.lit(r)).alias(f"p{round(r * 100)}") for r in ranks), (F.col("total") / F.col("accounts")).alias("mean"), "oldest"
    )


def json_absence(messages: DataFrame, by: list[str], json_col: str = "value") -> DataFrame:
    """Per leaf path (root.a.[].b) the share of explicit nulls among its occurrences, where above zero.

    JSON is read as variants and opened level by level, each checkpointed, until no object or array is left.
    """
    level = messages.select(*by, F.lit("root").alias("path"), F.try_parse_json(json_col).alias("v")).where("v IS NOT NULL")
    leaves = None
    while leaves is None or not level.isEmpty():
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        here = level.where(~nested).select(*by, "path", F.is_variant_null("v").alias("absent"))
        leaves = here if leaves is None else leaves.unionByName(here)
        opened = level.where(nested).lateralJoin(level.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = cut(opened.select(*by, F.concat_ws(".", "path", F.coalesce("key", F.lit("[]"))).alias("path"), F.col("value").alias("v")))
    return leaves.groupBy(*by, "path").agg(F.count_if("absent").alias("nulls"), F.count("*").alias("n")).where("nulls > 0").select(*by, "path", "nulls", (F.col("nulls") / F.col("n")).alias("share"))


def sync_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per account of B the pending and booked rows of either side and their differences.

    ``a`` and ``b`` have user_id, account_id and status.
    """
    def counts(df, p):
        return df.groupBy(*KEYS).agg(F.count_if(F.col("status") == "PENDING").alias(f"{p}_pending"), F.count_if(F.col("status") == "BOOKED").alias(f"{p}_booked"))

    both = counts(b, "b").join(counts(a, "a"), KEYS, "left").na.fill(0, ["a_pending", "a_booked"])
    return both.withColumns({
        "pending_delta": F.col("a_pending") - F.col("b_pending"), "booked_delta": F.col("a_booked") - F.col("b_booked"),
    }).withColumn("perfect", (F.col("pending_delta") == 0) & (F.col("booked_delta") == 0))


def sync_totals(compared: DataFrame) -> DataFrame:
    """Totals of a comparison run."""
    return compared.agg(F.count("*").alias("accounts"), F.count_if("perfect").alias("perfect"), F.count_if(F.col("pending_delta") != 0).alias("pending_off"), F.count_if(F.col("booked_delta") != 0).alias("booked_off"))
