"""Reading refresh and enrichment messages, and setting bad ones apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_REFERENCE = "struct<type:string,value:string>"
_MONEY = "struct<currency:string,amount:decimal(18,2)>"
TRANSACTION = (
    "struct<externalId:string,dateTime:string,amount:decimal(18,2),status:string,type:string,description:string,category:string,merchant:string,"
    f"extendedTransaction:struct<status:string,bookingDate:string,valueDate:string,transactionAmount:{_MONEY},originalAmount:{_MONEY},creditorName:string,creditorAccount:{_REFERENCE},"
    f"debtorName:string,debtorAccount:{_REFERENCE},remittanceInformationUnstructured:string,remittanceInformationStructured:string,endToEndId:string,"
    "exchangeRate:array<struct<currencyFrom:string,currencyTo:string,rateFrom:string>>>,bankSpecific:map<string,string>>"
)
ACCOUNT = (
    "struct<accountId:string,name:string,accountType:string,currency:string,currentBalance:decimal(18,2),availableBalance:decimal(18,2),lastRefreshed:string,closed:boolean,"
    "accountNumber:struct<scheme:string,identification:string,holderName:string>,"
    f"extendedAccount:struct<status:string,balances:array<struct<balanceType:string,balanceAmount:{_MONEY}>>>,"
    "creditCardData:struct<creditLimit:decimal(18,2),maskedNumber:string>,"
    f"transactions:array<{TRANSACTION}>>"
)
REFRESH = f"activityId string, userId string, userSiteId string, siteId string, provider string, ingestionAccounts array<{ACCOUNT}>"

_CYCLE = (
    "struct<id:string,amount:decimal(18,2),currency:string,period:string,modelParameters:struct<amount:decimal(18,2),currency:string,period:string>,"
    "predictedOccurrences:array<date>,label:string,isSubscription:boolean,counterparty:string>"
)
_KEY = "struct<accountId:string,transactionId:string,userId:string,date:date,pending:int>"
ENRICHMENT = (
    "domain string, version int, activityId string, time timestamp, key struct<userId:string,requestTraceId:string>, messageIndex int, messageTotal int, "
    f"transactions array<struct<key:{_KEY},category:string,source:string,categories:map<string,struct<category:string,categorySource:string>>,counterparty:string,isMerchant:boolean,"
    "counterpartySource:string,labels:array<string>,cycleId:string>>, "
    f"transactionCycles struct<credits:array<{_CYCLE}>,debits:array<{_CYCLE}>>"
)
# What the domains are called in messages.
DOMAIN_NAMES = {
    "CategoriesEnrichment": "CATEGORIES", "CounterpartiesEnrichment": "COUNTER_PARTIES", "TransactionCyclesEnrichment": "TRANSACTION_CYCLES", "LabelsEnrichment": "LABELS",
    "PreprocessingEnrichment": "PREPROCESSING",
}


def read_refreshes(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Refresh messages, one JSON document a line, gzip or plain, with where they came from (``arrival``).

    Files are taken in the order of their times and names, the lines of a file in theirs: see ``in_order``.
    """
    reader = spark.readStream if streaming else spark.read
    came = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return reader.schema(REFRESH).json(path).select("*", came.alias("arrival"))


def in_order(messages: DataFrame) -> DataFrame:
    """Messages with ``turn``: 1 for the first message of a user-site, 2 for the next.

    The order is that of arrival, from the source: an ``offset``, or the file and
    the place in it. A source that tells neither is an error, since ids of
    activities are random.
    """
    if "offset" in messages.columns:
        order = ["partition", "offset"] if "partition" in messages.columns else ["offset"]
        placed = messages
    elif "arrival" in messages.columns:
        # Lines of one part of a file are read by one task in their order.
        placed, order = messages.withColumn("_line", F.monotonically_increasing_id()), ["arrival", "_line"]
    else:
        raise ValueError("messages need an offset or an arrival to be taken in order")
    return placed.withColumn("turn", F.row_number().over(Window.partitionBy("userId", "userSiteId").orderBy(*order))).drop("_line")


def read_enrichments(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Enrichment messages of all domains under one schema, their domains by name; unknown fields are left out, unknown domains stay as they are."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(ENRICHMENT).json(path).withColumn("domain", _domain_name())


def _domain_name() -> F.Column:
    domain = F.col("domain")
    for written, name in DOMAIN_NAMES.items():
        domain = F.when(F.col("domain") == written, name).otherwise(domain)
    return domain


def upstream_accounts(messages: DataFrame) -> DataFrame:
    """One row an account, with its position in the message."""
    one = messages.select("activityId", "userId", "userSiteId", "siteId", "provider", F.posexplode("ingestionAccounts").alias("pos", "a"))
    return one.select(
        F.col("activityId").alias("activity_id"), F.col("userId").alias("user_id"), F.col("userSiteId").alias("user_site_id"), F.col("siteId").alias("site_id"), "provider", "pos",
        F.col("a.accountId").alias("external_id"), F.col("a.name").alias("name"), F.col("a.accountType").alias("type"), F.col("a.currency").alias("currency"), F.col("a.currentBalance").alias("current_balance"),
        F.col("a.availableBalance").alias("available_balance"), F.coalesce("a.closed", F.lit(False)).alias("closed"), F.col("a.extendedAccount.status").alias("extended_status"), F.col("a.accountNumber.scheme").alias("scheme"),
        F.col("a.accountNumber.identification").alias("number"), F.col("a.accountNumber.holderName").alias("holder"), F.col("a.creditCardData.maskedNumber").alias("masked"), F.col("a.transactions").alias("transactions"),
        F.transform("a.extendedAccount.balances", lambda b: F.struct(b["balanceType"].alias("type"), b["balanceAmount"]["amount"].alias("amount"))).alias("balances"),
    )


def upstream_transactions(accounts: DataFrame) -> DataFrame:
    """One row a transaction, with its position in the account's list."""
    one = accounts.select("activity_id", "user_id", "user_site_id", "provider", F.col("external_id").alias("account_external_id"), F.posexplode("transactions").alias("pos", "t"))
    return one.select(
        "activity_id", "user_id", "user_site_id", "provider", "account_external_id", "pos", F.col("t.externalId").alias("external_id"), F.col("t.dateTime").alias("date_time"), F.col("t.amount").alias("amount"),
        F.col("t.status").alias("status"), F.col("t.type").alias("type"), F.col("t.description").alias("description"), F.col("t.extendedTransaction").alias("extended"),
    )


def split_invalid(rows: DataFrame, message: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of sound messages, and the messages of which a row lacks a required field.

    HOLD transactions are dropped first; a message is bad as a whole.
    """
    kept = rows.where("status IS DISTINCT FROM 'HOLD'")
    sound = F.lit(True)
    for c in required:
        sound = sound & F.col(c).isNotNull()
    verdict = kept.groupBy(*message).agg(F.bool_and(sound).alias("sound"), F.count("*").alias("rows"))
    return kept.join(verdict.where("sound"), message, "left_semi"), verdict.where("NOT sound").select(*message, "rows")


def read_enrichment_lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Enrichment messages with the line they came as (``raw``), and ``fault``: why a message cannot be used, or null.

    A line that is no JSON object, and a message without a domain, a user, its
    transactions, or (for cycles) one of the two lists, is at fault as a whole.
    """
    reader = spark.readStream if streaming else spark.read
    came = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = reader.text(path).select(F.col("value").alias("raw"), came.alias("arrival")).where(F.trim("raw") != "")
    parsed = lines.withColumn("m", F.from_json("raw", f"{ENRICHMENT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.select("m.*", "raw", "arrival").withColumn("domain", _domain_name()).withColumn("fault", enrichment_fault()).drop("_corrupt")


def enrichment_fault() -> F.Column:
    cycles = F.col("domain") == "TRANSACTION_CYCLES"
    lists = F.col("transactionCycles.credits").isNull() | F.col("transactionCycles.debits").isNull()
    return (
        F.when(F.col("_corrupt").isNotNull(), "NOT_JSON").when(F.col("domain").isNull(), "NO_DOMAIN").when(F.col("key.userId").isNull(), "NO_USER")
        .when(F.col("transactions").isNull(), "NO_TRANSACTIONS").when(cycles & lists, "NO_CYCLES")
    )


def cycle_messages(messages: DataFrame) -> DataFrame:
    """One row a cycle message: user_id, its place, and its cycles typed by the sign of their amounts."""
    one = lambda c: F.struct(
        c["id"].alias("cycle_id"), F.when(c["amount"] >= 0, "CREDITS").otherwise("DEBITS").alias("cycle_type"), c["amount"].alias("amount"), c["currency"].alias("currency"),
        c["period"].alias("period"), c["modelParameters"]["amount"].alias("model_amount"), c["modelParameters"]["currency"].alias("model_currency"), c["modelParameters"]["period"].alias("model_period"),
        c["label"].alias("label"), c["isSubscription"].alias("subscription"), c["counterparty"].alias("counterparty"),
    )
    return messages.where("domain = 'TRANSACTION_CYCLES'").select(
        F.col("key.userId").alias("user_id"), "time", F.coalesce("messageIndex", F.lit(0)).alias("message_index"), F.transform(F.concat("transactionCycles.credits", "transactionCycles.debits"), one).alias("cycles")
    )


def enrichment_rows(messages: DataFrame) -> DataFrame:
    """One row a transaction of an enrichment message, with the fields of all domains.

    A cycle counts only if the message itself lists it.
    """
    cycles = F.coalesce(F.transform(F.concat("transactionCycles.credits", "transactionCycles.debits"), lambda c: c["id"]), F.array().cast("array<string>"))
    one = messages.select("domain", "time", "messageIndex", cycles.alias("cycles"), F.explode("transactions").alias("t"))
    detected = lambda kind: F.element_at("t.categories", kind)["category"]
    return one.select(
        F.col("t.key.userId").alias("user_id"), F.col("t.key.accountId").alias("account_id"), F.col("t.key.date").alias("date"), F.col("t.key.transactionId").alias("id"), "domain", "time",
        F.coalesce("messageIndex", F.lit(0)).alias("message_index"), F.col("t.category").alias("category"), F.col("t.labels").alias("labels"), F.col("t.counterparty").alias("counterparty_name"),
        F.col("t.isMerchant").alias("known_merchant"), F.when(F.array_contains("cycles", F.col("t.cycleId")), F.col("t.cycleId")).alias("cycle_id"),
        detected("sme_categories").alias("sme_category"), detected("personal_categories").alias("personal_category"),
    )
