"""Streams of enrichment merges and of the completion and time-out of activities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.merges import merge_enrichments
from ..sources.messages import enrichment_rows

# Domains in their order, with the weight each adds to an activity's sum.
DOMAIN_WEIGHTS = {"CATEGORIES": 1, "COUNTER_PARTIES": 10, "TRANSACTION_CYCLES": 100, "LABELS": 1000, "PREPROCESSING": 10000}
SUBSCRIBED = ("CATEGORIES", "COUNTER_PARTIES", "TRANSACTION_CYCLES", "LABELS")
# What feedback activities wait for besides the subscriptions.
EXTRA_DOMAIN = {"CATEGORIZATION_FEEDBACK": "CATEGORIES", "COUNTERPARTIES_FEEDBACK": "COUNTER_PARTIES", "TRANSACTION_CYCLES_FEEDBACK": "TRANSACTION_CYCLES"}
VERSION = 1
TIMEOUT_MS = 10 * 60 * 1000


def weight_of(domain):
    found = F.lit(0)
    for name, weight in DOMAIN_WEIGHTS.items():
        found = F.when(F.col(domain) == name, weight).otherwise(found)
    return found


def expected_sum(activities: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Activities (activity_id, client_id, kind) that are registered, with the sum that completes them.

    Registered only if some domain is subscribed to by the client (client_id,
    domains), once per id; a feedback activity's own domain is added once.
    """
    wanted = F.array_intersect("domains", F.array(*map(F.lit, SUBSCRIBED)))
    extra = F.lit(None).cast("string")
    for kind, domain in EXTRA_DOMAIN.items():
        extra = F.when(F.col("kind") == kind, domain).otherwise(extra)
    weights = F.create_map(*(F.lit(x) for pair in DOMAIN_WEIGHTS.items() for x in pair))
    all_domains = F.array_distinct(F.concat(wanted, F.when(extra.isNotNull(), F.array(extra)).otherwise(F.array().cast("array<string>"))))
    total = F.aggregate(all_domains, F.lit(0), lambda acc, d: acc + F.element_at(weights, d))
    known = activities.dropDuplicates(["activity_id"]).join(subscriptions, "client_id").where(F.size(wanted) > 0)
    return known.select("activity_id", "client_id", "kind", total.alias("expected"))


def completed_activities(messages: DataFrame, expected: DataFrame) -> DataFrame:
    """Batch twin of the stream: activities that complete, at which message, and the oldest date by account.

    ``messages``: activity_id, message_id, ts, account_id, domain, date, is_last. The
    weight of a message's domain counts when its last page arrives; an activity
    completes at the first message where the sum is the expected one, and later
    messages do not count.
    """
    arrival = Window.partitionBy("activity_id").orderBy("ts", "message_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = F.when(F.col("is_last") & (F.col("domain") != "PREPROCESSING"), weight_of("domain")).otherwise(0)
    messages = messages.select("activity_id", "message_id", "ts", "account_id", "domain", "date", "is_last")
    running = messages.join(expected.select("activity_id", "expected"), "activity_id").withColumn("sum", F.sum(counted).over(arrival))
    marked = running.withColumn("done", F.max((F.col("sum") == F.col("expected")).cast("int")).over(arrival))
    earlier = Window.partitionBy("activity_id").orderBy("ts", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    until = marked.withColumn("before", F.coalesce(F.max("done").over(earlier), F.lit(0))).withColumn("ever", F.max("done").over(Window.partitionBy("activity_id"))).where("before = 0 AND ever = 1")
    per_account = until.groupBy("activity_id", "account_id").agg(F.min("date").alias("oldest_date"))
    finish = until.groupBy("activity_id").agg(F.max_by("message_id", F.struct("ts", "message_id")).alias("completed_by"))
    return per_account.join(finish, "activity_id")


class ActivityTracker(StatefulProcessor):
    """Per activity: the sum so far, and the oldest date of each account; SUCCESS when the sum is the expected
    one, TIMEOUT when it is not ``timeout_ms`` after the start. Either clears the state, and messages of an
    activity that is not registered are ignored."""

    def __init__(self, timeout_ms: int = TIMEOUT_MS, dedupe_pages: bool = False):
        self.timeout_ms, self.dedupe_pages = timeout_ms, dedupe_pages

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "expected long, sum long, timer long, domains string")
        self.oldest = handle.getMapState("oldest", "account_id string", "oldest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        activity = key[0]
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "message_id"], kind="stable")
        for row in frame.to_dict("records"):
            state = self.progress.get() if self.progress.exists() else None
            if not pd.isna(row["expected"]):
                if state is None:
                    timer = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
                    self.handle.registerTimer(timer)
                    self.progress.update((int(row["expected"]), 0, timer, ""))
                continue
            if state is None:
                continue
            expected, total, timer, domains = state
            account, day = str(row["account_id"]), str(row["date"])
            if not self.oldest.containsKey((account,)) or day < self.oldest.getValue((account,))[0]:
                self.oldest.updateValue((account,), (day,))
            if row["is_last"] and row["domain"] in SUBSCRIBED and not (self.dedupe_pages and row["domain"] in domains.split(",")):
                total, domains = total + DOMAIN_WEIGHTS[row["domain"]], f"{domains},{row['domain']}"
            if total == expected:
                found = sorted((a[0], d[0]) for a, d in self.oldest.iterator())
                yield pd.DataFrame({"activity_id": [activity] * len(found), "status": ["SUCCESS"] * len(found), "account_id": [a for a, _ in found], "oldest_date": [d for _, d in found]})
                self._clear(timer)
            else:
                self.progress.update((expected, total, timer, domains))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        if self.progress.exists():
            self._clear(None)
            yield pd.DataFrame({"activity_id": [key[0]], "status": ["TIMEOUT"], "account_id": [None], "oldest_date": [None]})

    def _clear(self, timer: int | None) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.progress.clear()
        self.oldest.clear()

    def close(self) -> None:
        pass


TRACKER_INPUT = "activity_id long, message_id long, ts timestamp, account_id string, domain string, date string, is_last boolean, expected long"
TRACKER_OUTPUT = "status string, account_id string, oldest_date string"


def track_activities(events: DataFrame, timeout_ms: int = TIMEOUT_MS, dedupe_pages: bool = False) -> DataFrame:
    """Start events (``expected`` set) and messages in one stream, columns as ``TRACKER_INPUT``. Needs the RocksDB state store."""
    kind = events.schema["activity_id"].dataType.simpleString()
    return events.groupBy("activity_id").transformWithStateInPandas(ActivityTracker(timeout_ms, dedupe_pages), f"activity_id {kind}, {TRACKER_OUTPUT}", "Append", "ProcessingTime")


def wanted_messages(messages: DataFrame, user_client: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Enrichment messages of the four domains and the known version that the user's client subscribes to."""
    known = messages.where(F.col("domain").isin(*SUBSCRIBED) & (F.col("version") == VERSION))
    return known.join(user_client, "user_id").join(subscriptions, "client_id").where(F.array_contains("domains", F.col("domain"))).select(*messages.columns)


def enrichment_stream(
    messages: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], checkpoint: str, trigger: dict | None = None,
    clients: Callable[[], tuple[DataFrame, DataFrame]] | None = None,
):
    """Merges enrichment messages into the side table micro-batch by micro-batch.

    ``clients`` gives (user_client, subscriptions); with it, only domains count that the user's client subscribes to.
    """
    def merge(batch: DataFrame, _: int) -> None:
        known = batch.where(F.col("domain").isin(*SUBSCRIBED) & (F.col("version") == VERSION))
        if clients is not None:
            known = wanted_messages(known.withColumn("user_id", F.col("key.userId")), *clients())
        save(merge_enrichments(load(), enrichment_rows(known)))

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
