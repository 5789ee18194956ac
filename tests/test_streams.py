"""Streams over files against their batch twins."""

import json
import time
from datetime import datetime

from pyspark.sql import functions as F

from ledgerframe.operators import merges, reads, reports
from ledgerframe.plans.fixtures import Fixtures
from ledgerframe.sources import messages, sinks
from ledgerframe.streaming import activities

EVENTS = "activity_id long, message_id long, ts timestamp, account_id string, domain string, date string, is_last boolean, expected long"


def at(n):
    return datetime(2021, 3, 1, 12, n)


def run_tracker(spark, tmp_path, rows, **options):
    source = tmp_path / "in"
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(source))
    stream = activities.track_activities(spark.readStream.schema(EVENTS).parquet(str(source)), **options)
    name = "t" + tmp_path.name.replace("-", "_")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a state store and a Python worker for each
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    for _ in range(900):  # a query with processing-time timers does not end by itself
        if query.exception() or sum(p.numInputRows for p in query.recentProgress) >= len(rows):
            break
        time.sleep(0.1)
    query.stop()
    assert query.exception() is None
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return {(r.activity_id, r.status, r.account_id, r.oldest_date) for r in spark.table(name).collect()}


def test_completion_equals_batch_twin(spark, tmp_path):
    rows = [
        (1, 0, at(0), None, None, None, None, 11), (1, 1, at(1), "a", "CATEGORIES", "2021-02-03", False, None), (1, 2, at(2), "a", "CATEGORIES", "2021-02-01", True, None),
        (1, 3, at(3), "b", "COUNTER_PARTIES", "2021-02-09", True, None), (1, 4, at(4), "b", "LABELS", "2020-01-01", True, None),
        (2, 5, at(1), "a", "CATEGORIES", "2021-02-03", True, None), (3, 6, at(0), None, None, None, None, 1), (3, 7, at(1), "c", "PREPROCESSING", "2021-01-01", True, None),
    ]
    got = run_tracker(spark, tmp_path, rows)
    assert got == {(1, "SUCCESS", "a", "2021-02-01"), (1, "SUCCESS", "b", "2021-02-09")}
    frame = spark.createDataFrame(rows, EVENTS)
    expected = frame.where("expected IS NOT NULL").select("activity_id", "expected")
    twin = activities.completed_activities(frame.where("expected IS NULL"), expected)
    assert {(r.activity_id, "SUCCESS", r.account_id, r.oldest_date) for r in twin.collect()} == got


def test_page_delivered_twice_overshoots_unless_deduped(spark, tmp_path):
    rows = [(1, 0, at(0), None, None, None, None, 11)] + [(1, k, at(k), "a", d, "2021-02-01", True, None) for k, d in ((1, "CATEGORIES"), (2, "CATEGORIES"), (3, "COUNTER_PARTIES"))]
    assert run_tracker(spark, tmp_path / "a-x", rows) == set()
    assert {r[1] for r in run_tracker(spark, tmp_path / "b-y", rows, dedupe_pages=True)} == {"SUCCESS"}


MESSAGE = {
    "domain": "CATEGORIES", "version": 1, "activityId": "x", "time": "2021-03-01T10:00:00Z", "unknown": 1,
    "transactions": [{"key": {"accountId": "1", "transactionId": "t1", "userId": "7", "date": "2021-03-01"}, "category": "Food"}],
}


def test_enrichment_stream_merges_files(spark, tmp_path):
    folder = tmp_path / "messages"
    folder.mkdir()
    other = MESSAGE | {"domain": "COUNTER_PARTIES", "transactions": [MESSAGE["transactions"][0] | {"counterparty": "Shop", "isMerchant": True, "category": None}]}
    (folder / "a.json").write_text("\n".join(json.dumps(m) for m in (MESSAGE, other, MESSAGE | {"version": 2, "transactions": []})))
    table, side = str(tmp_path / "side"), "user_id string, account_id string, date date, id string, category string, labels array<string>, counterparty_name string, known_merchant boolean, cycle_id string"
    spark.createDataFrame([], side).write.parquet(table)
    stream = messages.read_enrichments(spark, str(folder), streaming=True)

    def save(df):
        rows = df.collect()
        spark.createDataFrame(rows, side).write.mode("overwrite").parquet(table)

    activities.enrichment_stream(stream, lambda: spark.read.parquet(table), save, str(tmp_path / "check")).awaitTermination(120)
    row = spark.read.parquet(table).first()
    assert (row.user_id, row.category, row.counterparty_name, row.known_merchant) == ("7", "Food", "Shop", True)


def wire(domain, transaction, **more):
    key = {"accountId": "a", "transactionId": "t", "userId": "u", "date": "2020-08-04", "pending": 1}
    return {"domain": domain, "version": 1, "activityId": "7183ea5e", "time": "2000-08-04T16:00:00.000000+02:00", "key": {"userId": "u", "requestTraceId": "r"}, "transactions": [{"key": key} | transaction]} | more


def test_enrichment_stream_on_messages_as_they_are_sent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cycle = {"id": "c1", "amount": 5.0, "currency": "GBP", "period": "P1M", "modelParameters": {"amount": 5.0, "currency": "GBP", "period": "P1M"}, "predictedOccurrences": ["2020-08-04"], "label": "RENT", "isSubscription": True, "counterparty": "S"}
    lines = [
        wire("CategoriesEnrichment", {"category": "Drinks", "source": "Y", "categories": {"sme_categories": {"category": "transport", "categorySource": "X"}, "personal_categories": {"category": "Bar", "categorySource": "X"}}}),
        wire("CounterpartiesEnrichment", {"counterparty": "Ajax", "isMerchant": True, "counterpartySource": "A"}), wire("LabelsEnrichment", {"labels": ["Red", "Yellow"]}),
        wire("TransactionCyclesEnrichment", {"cycleId": "c1"}, transactionCycles={"credits": [cycle], "debits": []}), wire("PreprocessingEnrichment", {}),
    ]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    side = "user_id string, account_id string, date date, id string, category string, sme_category string, personal_category string, labels array<string>, counterparty_name string, known_merchant boolean, cycle_id string"
    empty = spark.createDataFrame([], side)
    user_client = spark.createDataFrame([("u", 1)], "user_id string, client_id long")
    got = {}
    for name, domains in (("all", list(activities.SUBSCRIBED)), ("some", ["LABELS"])):
        subscriptions = spark.createDataFrame([(1, domains)], "client_id long, domains array<string>")
        stream = messages.read_enrichments(spark, str(tmp_path / "in"), streaming=True)
        activities.enrichment_stream(stream, lambda: empty, lambda df, n=name: got.update({n: df.collect()}), str(tmp_path / name), clients=lambda s=subscriptions: (user_client, s)).awaitTermination(120)
    (row,), (some,) = got["all"], got["some"]
    assert (row.category, row.sme_category, row.personal_category, row.labels, row.counterparty_name, row.known_merchant, row.cycle_id) == ("Drinks", "transport", "Bar", ["Red", "Yellow"], "Ajax", True, "c1")
    assert (some.category, some.labels, some.cycle_id) == (None, ["Red", "Yellow"], None)
    unlisted = spark.read.json(spark.sparkContext.parallelize([json.dumps(wire("TransactionCyclesEnrichment", {"cycleId": "c2"}, transactionCycles={"credits": [cycle], "debits": []}))]), schema=messages.ENRICHMENT)
    assert messages.enrichment_rows(unlisted).first().cycle_id is None


def test_time_out_of_an_activity(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("act", 0, at(0), None, None, None, None, 11), ("act", 1, at(1), "a", "CATEGORIES", "2021-02-03", True, None)]
    schema = EVENTS.replace("activity_id long", "activity_id string")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = activities.track_activities(spark.readStream.schema(schema).parquet(str(source)), timeout_ms=200)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    query = stream.writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="1 second").start()
    for _ in range(900):
        if query.exception() or spark.table("late").count():
            break
        time.sleep(0.1)
    query.stop()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert query.exception() is None
    assert [tuple(r) for r in spark.table("late").collect()] == [("act", "TIMEOUT", None, None)]


def test_read_refreshes_flattens_with_positions(spark, tmp_path):
    txn = {"externalId": "e", "dateTime": "2021-03-01T10:00:00+02:00", "amount": 1.5, "status": "BOOKED", "type": "DEBIT", "description": "d"}
    message = {"activityId": "a", "userId": "1", "userSiteId": "s", "ingestionAccounts": [{"accountId": "x", "currency": "EUR", "transactions": [txn, txn | {"status": "HOLD"}, txn | {"amount": None}]}]}
    good = message | {"activityId": "b", "ingestionAccounts": [{"accountId": "y", "transactions": [txn]}]}
    (tmp_path / "m.json").write_text(json.dumps(message) + "\n" + json.dumps(good))
    accounts = messages.upstream_accounts(messages.read_refreshes(spark, str(tmp_path / "m.json")))
    rows = messages.upstream_transactions(accounts)
    assert sorted((r.activity_id, r.pos) for r in rows.collect()) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    sound, bad = messages.split_invalid(rows, ["activity_id"], ["amount", "type"])
    assert [r.activity_id for r in sound.collect()] == ["b"] and [(r.activity_id, r.rows) for r in bad.collect()] == [("a", 2)]


def test_intervals():
    from datetime import date

    import pytest

    assert reads.Interval.of("2021-01-31/P1M") == reads.Interval(date(2021, 1, 31), date(2021, 2, 28))
    assert reads.Interval.of("P1Y2M3D/2021-03-04") == reads.Interval(date(2020, 1, 1), date(2021, 3, 4))
    assert reads.Interval.last_month(date(2021, 12, 31)) == reads.Interval(date(2021, 11, 30), date(2021, 12, 31))
    for bad in ("P1M/P1M", "2021-02-01/2021-01-01", "x", "2021-01-01/P"):
        with pytest.raises(ValueError):
            reads.Interval.of(bad)


def test_month_partitions_and_export(spark, tmp_path):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "table")
    quarter = fx.stored.where("date BETWEEN DATE '2000-05-01' AND DATE '2000-07-31'").coalesce(1)
    merges.write_touched_months(quarter, path)
    before = spark.read.parquet(path).count()
    month = quarter.where("date_format(date, 'yyyy-MM') = '2000-06'")
    merges.write_touched_months(month.limit(1), path)
    assert spark.read.parquet(path).count() == before - month.count() + 1
    gone = quarter.where("date_format(date, 'yyyy-MM') = '2000-07'").withColumn("action", F.lit("DELETE"))
    assert merges.write_instructions(gone, path) == ["2000-07"]
    assert {r.month for r in spark.read.parquet(path).select("month").distinct().collect()} == {"2000-05", "2000-06"}
    sinks.personal_data_export(fx.accounts.where("user_id = 1"), fx.stored.where("user_id = 1"), str(tmp_path / "export"))
    assert spark.read.option("header", True).csv(str(tmp_path / "export/accounts/user_id=1")).count() == fx.accounts.where("user_id = 1").count()


def test_pending_without_earlier_booked_has_no_bound(spark):
    accounts = spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 1)], "user_id long, id long, user_site_id long, site_id long")
    ts = lambda d: datetime(2021, 3, d)
    txns = lambda *rows: spark.createDataFrame([(1, a, s, ts(d).date(), ts(d)) for a, s, d in rows], "user_id long, account_id long, status string, date date, ts timestamp_ntz")
    bound = lambda *rows, **k: reports.retrieval_lower_bound(accounts, txns(*rows), "2021-04-20 00:00:00", **k).first().lower_bound
    assert bound((1, "PENDING", 5), (2, "BOOKED", 3)) is None
    assert bound((1, "PENDING", 5), (1, "BOOKED", 3), (2, "BOOKED", 9)) == ts(2)
    assert bound((1, "BOOKED", 3), (2, "BOOKED", 9)) == ts(8)
    assert bound((1, "PENDING", 5), (1, "BOOKED", 3), special_site=1) == ts(20)


def test_sparse_upsert_keeps_old_values(spark):
    schema = "k long, a string, b string"
    base, patch = spark.createDataFrame([(1, "x", "y"), (2, "x", "y")], schema), spark.createDataFrame([(1, None, None), (3, "n", None)], schema)
    got = {tuple(r) for r in merges.sparse_upsert(base, patch, ["k"], always_overwrite=("b",)).collect()}
    assert got == {(1, "x", None), (2, "x", "y"), (3, "n", None)}
    last = merges.last_known(spark.createDataFrame([(1, 1, "a", "p"), (1, 2, None, "q")], "k long, t long, a string, b string"), ["k"], ["t"])
    assert [tuple(r) for r in last.select("k", "a", "b").collect()] == [(1, "a", "q")]


def test_duplicate_account_without_currency_is_an_error(spark):
    import pytest

    from ledgerframe.operators.accounts import dedupe_accounts

    schema = "user_id long, pos int, external_id string, scheme string, number string, currency string"
    one = spark.createDataFrame([(1, 0, "a", None, None, None)], schema)
    assert dedupe_accounts(one, ["user_id"]).count() == 1
    two = spark.createDataFrame([(1, 0, "a", None, None, None), (1, 1, "a", None, None, "EUR")], schema)
    with pytest.raises(Exception, match="without external id or currency"):
        dedupe_accounts(two, ["user_id"]).collect()
