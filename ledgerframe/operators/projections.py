"""Projections between the upstream, stored, analytics and served shapes of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import balance_of, blank_to_null, col, signed

# Schemes of account references.
REFERENCE_SCHEMES = ("BBAN", "IBAN", "MASKED_PAN", "PAN", "SORTCODEACCOUNTNUMBER")
ANALYTICS_PENDING = {"BOOKED": 1, "PENDING": 2}


def _reference(account: str, scheme: str) -> Column:
    return F.when(F.col(f"{account}.type") == scheme, F.col(f"{account}.value"))


def to_stored_txn(upstream: DataFrame) -> DataFrame:
    """Stored transactions from upstream ones (P1).

    The amount gets its sign; the local date is taken at the source's offset
    before the instant goes to UTC; account references are spread by scheme; only
    the first exchange rate counts, an unparsable one as null.
    """
    ext = "extended"
    parties = [
        _reference(f"{ext}.{party}_account", scheme).alias(f"{party}_{scheme.lower()}") for party in ("creditor", "debtor") for scheme in REFERENCE_SCHEMES
    ]
    rate = F.get(F.col(f"{ext}.exchange_rates"), 0)
    return upstream.select(
        "user_id", "account_id", F.col("date_time").substr(1, 10).cast("date").alias("date"), F.col("id").cast("string").alias("id"), "external_id", "status",
        F.when(F.col("amount").isNull() | F.col("type").isNull(), F.raise_error(F.lit("transaction without amount or type")).cast("decimal(18,2)")).otherwise(signed("amount", "type")).alias("amount"),
        F.date_trunc("millisecond", F.to_timestamp("date_time")).alias("ts"), F.regexp_extract("date_time", r"([+-]\d\d:\d\d|Z)$", 1).alias("time_zone"), "description",
        F.col(f"{ext}.booking_date").alias("booking_date"), F.col(f"{ext}.creditor_name").alias("creditor_name"), F.col(f"{ext}.debtor_name").alias("debtor_name"), *parties,
        rate["currency_from"].alias("rate_from"), F.expr("try_cast(get(extended.exchange_rates, 0).rate AS DECIMAL(38,10))").alias("rate"), F.col(f"{ext}.original_amount.amount").alias("original_amount"),
        F.col(f"{ext}.original_amount.currency").alias("original_currency"),
    )


def to_stored_account(upstream: DataFrame) -> DataFrame:
    """Stored accounts from upstream ones (P3): current balance before available, status, references by scheme, valid balances only."""
    number = lambda scheme, ref: F.coalesce(F.when(F.col("scheme") == scheme, F.col("number")), F.get(F.filter("references", lambda r: r["type"] == ref), 0)["value"])
    return upstream.select(
        "user_id", "id", "external_id", "type", "currency", F.coalesce("current_balance", "available_balance").alias("balance"),
        F.when(F.coalesce("closed", F.lit(False)), "DELETED").when(F.col("extended_status") == "BLOCKED", "BLOCKED").otherwise("ENABLED").alias("status"),
        number("IBAN", "IBAN").alias("iban"), number("SORTCODEACCOUNTNUMBER", "SORTCODEACCOUNTNUMBER").alias("sort_code"),
        F.filter("balances", lambda b: b["type"].isNotNull() & b["amount"].isNotNull()).alias("balances"), balance_of("balances", "AVAILABLE").alias("available"),
    )


def to_analytics_txn(stored: DataFrame) -> DataFrame:
    """The analytics copy of transactions (P4): pending code, unsigned amount with direction, the other party."""
    credit = F.col("amount") >= 0
    code = F.lit(None).cast("int")
    for status, value in ANALYTICS_PENDING.items():
        code = F.when(F.col("status") == status, value).otherwise(code)
    other = F.when(credit, F.col("debtor_name")).otherwise(F.col("creditor_name")) if {"debtor_name", "creditor_name"} <= set(stored.columns) else F.lit(None).cast("string")
    return stored.select(
        "user_id", "account_id", code.alias("pending"), "date", F.col("id").alias("transaction_id"), F.abs("amount").alias("amount"),
        F.when(credit, "credit").otherwise("debit").alias("transaction_type"), "description", other.alias("counterparty"),
    )


def to_analytics_account(accounts: DataFrame) -> DataFrame:
    """The analytics copy of accounts (P5)."""
    return accounts.select("user_id", F.col("id").alias("account_id"), "user_site_id", "site_id", "external_id", "type", F.col("currency").alias("currency_code"), F.col("balance").alias("current_balance"),
                           F.lit("PROCESSED").alias("status"), F.lit("0_SUCCESS").alias("status_detail"), F.coalesce(F.col("status") == "DELETED", F.lit(False)).alias("closed"))


def to_analytics_credit_card(accounts: DataFrame) -> DataFrame:
    """The analytics copy of credit cards (P6): only accounts that carry card data."""
    return accounts.where("credit_limit IS NOT NULL").select("user_id", F.col("id").alias("account_id"), "user_site_id", "external_id", F.col("currency").alias("currency_code"), F.col("balance").alias("running_balance"), F.col("credit_limit").alias("total_credit_line"))


def struct_or_null(**parts: Column | str) -> Column:
    """A struct of the parts, null if all of them are."""
    any_set = F.lit(False)
    for part in parts.values():
        any_set = any_set | col(part).isNotNull()
    return F.when(any_set, F.struct(*(col(part).alias(name) for name, part in parts.items())))


def transaction_view(txn: DataFrame) -> DataFrame:
    """Served transactions (P7): parties, exchange rate and original amount nested, null when empty; time at the stored offset."""
    def party(p: str) -> Column:
        scheme = F.coalesce(*(F.when(F.col(f"{p}_{s.lower()}").isNotNull(), F.lit(s)) for s in REFERENCE_SCHEMES))
        return struct_or_null(name=f"{p}_name", scheme=scheme, number=F.coalesce(*(F.col(f"{p}_{s.lower()}") for s in REFERENCE_SCHEMES))).alias(p)

    shown = F.concat(F.date_format(F.convert_timezone(F.lit("UTC"), F.when(F.col("time_zone") == "Z", "UTC").otherwise(F.col("time_zone")), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.col("time_zone"))
    return txn.select(
        "user_id", "account_id", "id", "date", "status", "amount", "description", shown.alias("timestamp"), party("creditor"), party("debtor"),
        struct_or_null(currency_from="rate_from", rate="rate").alias("exchange_rate"), struct_or_null(amount="original_amount", currency="original_currency").alias("original_amount"),
    )


def account_view(accounts: DataFrame) -> DataFrame:
    """Served accounts (P8): a sub-struct by type, references only if one is not blank, created_at from the epoch on."""
    kind = F.col("type")
    return accounts.select(
        "user_id", "id", "external_id", "type", "currency", "balance", "status", struct_or_null(iban=blank_to_null("iban"), sort_code=blank_to_null("sort_code")).alias("account_references"),
        F.when(kind == "CREDIT_CARD", F.struct(F.col("credit_limit").alias("credit_limit"))).alias("credit_card"), F.when(kind == "SAVINGS_ACCOUNT", F.struct(F.col("iban").alias("iban"))).alias("savings"),
        F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp_ntz")).alias("created_at"),
    )


def merchant_name() -> Column:
    """The name shown for an enriched transaction (P13): the counterparty if a known merchant; hidden if known
    not to be; the old column only where name or flag is missing."""
    name, known = F.col("counterparty_name"), F.col("known_merchant")
    old = F.col("merchant_name")
    return F.when(name.isNull() | known.isNull(), old).when(known, name)


def legacy_transaction_view(enriched: DataFrame) -> DataFrame:
    """The old shape of transactions (P11)."""
    return enriched.select(
        "user_id", "account_id", "id", "date", "amount", F.coalesce("category", F.lit("General")).alias("category"), F.coalesce("counterparty_name", "description").alias("short_description"),
        F.when(F.col("known_merchant"), F.col("counterparty_name")).alias("merchant"), F.when(F.col("status") == "PENDING", "PENDING").otherwise("REGULAR").alias("transaction_type"),
    )


def legacy_account_view(accounts: DataFrame) -> DataFrame:
    """The old shape of accounts (P12): reduced status, closed flag, references that are not blank."""
    references = F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).alias("value")) for t, c in (("IBAN", "iban"), ("SORT_CODE", "sort_code"))))
    return accounts.select(
        "user_id", "id", F.when(F.col("status") == "DELETED", "DELETED").otherwise("PROCESSED").alias("status"), (F.col("status") == "DELETED").alias("closed"), F.col("currency").alias("currency_code"), "balance",
        F.filter(references, lambda r: blank_to_null(r["value"]).isNotNull()).alias("references"),
    )


def cycle_view(cycles: DataFrame) -> DataFrame:
    """Served cycles (P14): detected parameters only if amount, currency and period are all known."""
    whole = F.col("model_amount").isNotNull() & F.col("model_currency").isNotNull() & F.col("model_period").isNotNull()
    return cycles.select("user_id", "cycle_id", "cycle_type", "amount", "currency", "period", "expired", F.when(whole, F.struct("model_amount", "model_currency", "model_period")).alias("detected"))


def cycles_from_messages(messages: DataFrame) -> DataFrame:
    """Cycles of cycle messages (P15): credits and debits as one list, typed by the sign of the amount."""
    one = messages.select("user_id", F.explode(F.concat("credits", "debits")).alias("c"))
    return one.select("user_id", F.col("c.id").alias("cycle_id"), F.when(F.col("c.amount") >= 0, "CREDITS").otherwise("DEBITS").alias("cycle_type"), "c.amount", "c.currency", "c.period", F.lit(False).alias("expired"))
