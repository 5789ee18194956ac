"""The ledger's streams on tables on disk: order, replays, crashes, failures of one account, deletions."""

import json
import os
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import ingestion, merges
from ledgerframe.sources import messages
from ledgerframe.streaming import ledger, tables

NOW = "2021-04-01 08:00:00"


def txn(ext, day="2021-03-01", amount=5.0, kind="DEBIT", status="BOOKED", **more):
    return {"externalId": ext, "dateTime": f"{day}T10:00:00+01:00", "amount": amount, "status": status, "type": kind, "description": "d"} | more


def account(ext, *rows, currency="EUR", number=None, **more):
    numbered = {"accountNumber": {"scheme": "IBAN", "identification": number}} if number else {}
    return {"accountId": ext, "name": ext, "accountType": "CURRENT_ACCOUNT", "currency": currency, "currentBalance": 1.0, "transactions": list(rows)} | numbered | more


def refresh(activity, *accounts, user="u", site="s", provider="OTHER"):
    return {"activityId": activity, "userId": user, "userSiteId": site, "siteId": "bank", "provider": provider, "ingestionAccounts": list(accounts)}


def write(folder, name, *lines, at=None):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(json.dumps(x) if isinstance(x, dict) else x for x in lines))
    at = at or time.time()
    os.utime(path, (at, at))


def run(spark, tmp_path, root="tables", check="check", source="in", **options):
    kept = ledger.ledger_tables(spark, str(tmp_path / root))
    stream = messages.read_refreshes(spark, str(tmp_path / source), streaming=True)
    ledger.ingest_stream(stream, kept, str(tmp_path / check), clock=lambda: NOW, **options).awaitTermination(300)
    return kept


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_refreshes_in_their_order_and_once(spark, tmp_path):
    # activity ids fall while the files' times rise: order is that of arrival
    write(tmp_path / "in", "b.json", refresh("9", account("a", txn("1"), txn("2", "2021-03-02", status="PENDING"))), at=1000)
    write(tmp_path / "in", "a.json", refresh("5", account("a", txn("1", amount=6.0), txn("2", "2021-03-02"), txn("3", "2021-03-05"))), at=2000)
    kept = run(spark, tmp_path)
    got = rows(kept.rows("transactions"), "external_id", "date", "status", F.col("amount").cast("double"))
    assert got == [("1", date(2021, 3, 1), "BOOKED", -6.0), ("2", date(2021, 3, 2), "BOOKED", -5.0), ("3", date(2021, 3, 5), "BOOKED", -5.0)]
    assert kept.rows("accounts").count() == 1
    assert {r[0] for r in rows(kept.log("account_events"), "event")} == {"CREATED", "UPDATED"}
    finished = {r.activity_id: r for r in kept.log("finished").collect()}
    assert finished["9"].first_month == "2021-03" and list(finished["5"].last_external_id.values()) == ["3"] and list(finished["5"].oldest_change.values()) == [date(2021, 3, 1)]
    feed = [json.loads(r.value) for r in kept.log("feed").collect()]
    assert sum(x["delete"] for x in feed) == 1 and all(x["payload"] is not None for x in feed if not x["delete"]) and all("payload" not in x for x in feed if x["delete"])
    # the same messages again, by a stream that has forgotten what it read: nothing changes, as the batch is done
    before, logs = rows(kept.rows("transactions"), "*"), kept.log("feed").count()
    run(spark, tmp_path, check="other")
    assert rows(kept.rows("transactions"), "*") == before and kept.log("feed").count() == logs
    # a batch for each file, with a restart in between, has the same outcome
    for name in ("b.json", "a.json"):
        write(tmp_path / "single", name, (tmp_path / "in" / name).read_text())
        one = run(spark, tmp_path, root="apart", check="apart", source="single")
    assert rows(one.rows("transactions"), "external_id", "date", "status", "amount") == rows(kept.rows("transactions"), "external_id", "date", "status", "amount")


def test_one_account_fails_and_others_go_on(spark, tmp_path):
    write(tmp_path / "in", "a.json",
          refresh("1", account("fine", txn("1")), account("odd", txn("2", amount=1.0)), user="u1"),
          refresh("2", account("x", txn("1") | {"amount": None}), account("y", txn("1")), user="u2"),
          refresh("3", account("x", txn("1")), account("x", txn("2"), currency=None), user="u3"),
          refresh("4", account("only", txn("1"), txn("1")), user="u4", provider="ASN_BANK"), at=1000)
    kept = run(spark, tmp_path)
    # the second refresh of u1 comes with another currency at its second place: the first place stays applied
    write(tmp_path / "in", "b.json",
          refresh("5", account("fine", txn("1"), txn("7", "2021-03-09")), account("odd", txn("2"), txn("8"), currency="GBP"), account("late", txn("9")), user="u1"),
          refresh("6", account("only", txn("1"), txn("1"), txn("4", "2021-03-04")), user="u4", provider="ASN_BANK"), at=2000)
    run(spark, tmp_path)
    assert rows(kept.log("failures"), "activity_id", "reason") == [("2", "INVALID_TRANSACTION"), ("3", "AMBIGUOUS_ACCOUNTS"), ("5", "CURRENCY_DIFFERS"), ("6", "RECONCILIATION_FATAL_STORED_DUPLICATE")]
    held = kept.rows("transactions").join(kept.rows("accounts").select("user_id", F.col("id").alias("account_id"), F.col("external_id").alias("account")), ["user_id", "account_id"])
    assert rows(held, "user_id", "account", "external_id") == [("u1", "fine", "1"), ("u1", "fine", "7"), ("u1", "odd", "2"), ("u4", "only", "1"), ("u4", "only", "1")]
    assert {r[0] for r in rows(kept.log("finished"), "activity_id")} == {"1", "4", "6"}
    assert kept.log("finished").where("activity_id = '6'").first().last_external_id == {}


def test_two_entries_of_one_account_are_applied_in_turn(spark, tmp_path):
    write(tmp_path / "in", "a.json", refresh("1", account("a", txn("1"), number="NL01 BANK 0001")), at=1000)
    kept = run(spark, tmp_path)
    write(tmp_path / "in", "b.json", refresh("2", account("a", txn("1"), txn("2"), number="NL01 BANK 0001"), account("z", txn("1"), txn("2"), txn("3"), number="NL01BANK0001")), at=2000)
    run(spark, tmp_path)
    assert kept.rows("accounts").count() == 1 and rows(kept.rows("transactions"), "external_id") == [("1",), ("2",), ("3",)]


def test_messages_without_an_order_are_refused(spark):
    with pytest.raises(ValueError, match="in order"):
        messages.in_order(spark.createDataFrame([("u", "s")], "userId string, userSiteId string"))
    offsets = spark.createDataFrame([("u", "s", 9), ("u", "s", 3), ("v", "s", 5)], "userId string, userSiteId string, offset long")
    assert rows(messages.in_order(offsets), "userId", "offset", "turn") == [("u", 3, 1), ("u", 9, 2), ("v", 5, 1)]


def test_a_crash_before_and_within_publication(spark, tmp_path, monkeypatch):
    kept = ledger.ledger_tables(spark, str(tmp_path / "t"))
    put = lambda *ids: tables.Change(spark.createDataFrame([("u", i, "1", 1.0, False) for i in ids], "user_id string, cycle_id string, period string, amount double, expired boolean").select(
        *(F.col(c.name).cast(c.dataType).alias(c.name) if c.name in ("user_id", "cycle_id", "period", "amount", "expired") else F.lit(None).cast(c.dataType).alias(c.name) for c in spark.createDataFrame([], ledger.CYCLES).schema)
    ), spark.createDataFrame([("u", "a")], "user_id string, cycle_id string"))
    assert kept.apply(1, lambda t: {"cycles": put("a", "b"), "feed": spark.range(2)})
    assert not kept.apply(1, lambda t: pytest.fail("a done batch is computed again"))

    def fail(*_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        kept.apply(2, fail)
    assert rows(kept.rows("cycles"), "cycle_id") == [("a",), ("b",)]
    with monkeypatch.context() as m:
        m.setattr(tables.Tables, "_publish", fail)
        with pytest.raises(RuntimeError):
            kept.apply(2, lambda t: {"cycles": put("c"), "feed": spark.range(3)})
    assert kept.apply(2, lambda t: pytest.fail("a staged batch is computed again"))
    assert rows(kept.rows("cycles"), "cycle_id") == [("b",), ("c",)] and kept.log("feed").count() == 5


CYCLE = {"id": "c1", "amount": 5.0, "currency": "GBP", "period": "P1M", "modelParameters": {"amount": 5.0, "currency": "GBP", "period": "P1M"}, "predictedOccurrences": [], "label": "RENT", "isSubscription": True, "counterparty": "S"}


def wire(domain, at, transactions, **more):
    key = {"accountId": "a", "userId": "u", "date": "2020-08-04", "pending": 1}
    return {"domain": domain, "version": 1, "activityId": "x", "time": f"2020-08-04T{at}:00:00Z", "key": {"userId": "u", "requestTraceId": "r"}, "transactions": [{"key": key | {"transactionId": t}} | v for t, v in transactions.items()]} | more


def test_cycles_and_enrichments_of_one_batch(spark, tmp_path):
    cycles = lambda *ids, **more: {"credits": [CYCLE | {"id": i} | more for i in ids], "debits": [CYCLE | {"id": "neg", "amount": -2.0}]}
    lines = [
        wire("TransactionCyclesEnrichment", 11, {"t1": {"cycleId": "c2"}, "t2": {"cycleId": "c3"}}, transactionCycles=cycles("c2", "c3", period="P1W")),
        wire("TransactionCyclesEnrichment", 10, {"t1": {"cycleId": "c1"}}, transactionCycles=cycles("c1", "c2")),
        wire("CategoriesEnrichment", 10, {"t1": {"category": "Drinks"}}), '{"domain": "LabelsEnrichment", "key": {"userId": "u"}', wire("LabelsEnrichment", 10, {}, key=None), wire("LabelsEnrichment", 10, {}) | {"transactions": None},
        wire("TransactionCyclesEnrichment", 12, {"t1": {"cycleId": "c1"}}, transactionCycles={"credits": [CYCLE]}), wire("TransactionCyclesEnrichment", 13, {}), {"no": "domain"},
    ]
    write(tmp_path / "in", "a.json", *lines)
    kept = ledger.ledger_tables(spark, str(tmp_path / "t"))
    go = lambda check: ledger.enrich_stream(messages.read_enrichment_lines(spark, str(tmp_path / "in"), streaming=True), kept, str(tmp_path / check)).awaitTermination(300)
    go("c")
    assert rows(kept.rows("cycles"), "cycle_id", "cycle_type", "period", "expired") == [("c1", "CREDITS", "P1M", True), ("c2", "CREDITS", "P1W", False), ("c3", "CREDITS", "P1W", False), ("neg", "DEBITS", "P1M", False)]
    assert rows(kept.rows("enrichments"), "id", "category", "cycle_id") == [("t1", "Drinks", "c2"), ("t2", None, "c3")]
    bad = kept.log("bad_enrichments").collect()
    assert sorted(r.fault for r in bad) == ["NOT_JSON", "NO_CYCLES", "NO_CYCLES", "NO_DOMAIN", "NO_TRANSACTIONS", "NO_USER"] and all(r.raw for r in bad)
    before = rows(kept.rows("cycles"), "*")
    go("again")
    assert rows(kept.rows("cycles"), "*") == before and kept.log("bad_enrichments").count() == 6


def test_cycle_messages_one_by_one_give_the_same(spark):
    local = spark.createDataFrame([("u", "a", 1, False), ("u", "b", 1, True), ("v", "a", 1, False)], "user_id string, cycle_id string, amount long, expired boolean")
    made = lambda n, *ids: ("u", n, [(i, n) for i in ids])
    schema = "user_id string, n long, cycles array<struct<cycle_id:string,amount:long>>"
    steps = [made(10, "b", "c"), made(11, "a", "d"), made(12, "c", "d"), ("w", 10, [("z", 10)]), made(13), made(14, "e", "a")]
    slow = local
    for step in steps:
        new = spark.createDataFrame([step], schema).select("user_id", F.explode("cycles").alias("c")).select("user_id", "c.*", F.lit(False).alias("expired"))
        if step[2]:
            slow = merges.apply_cycles(slow, merges.cycle_changeset(slow, new))
        else:
            slow = slow.withColumn("expired", F.col("expired") | (F.col("user_id") == step[0]))
        slow = spark.createDataFrame(slow.collect(), local.schema)
    whole = merges.latest_cycles(local, spark.createDataFrame(steps, schema), ["n"]).unionByName(local.where("user_id = 'v'"))
    assert rows(whole, "*") == rows(slow, "*")


def test_deletion_removes_a_site_from_all_tables(spark, tmp_path):
    write(tmp_path / "in", "a.json", refresh("1", account("a", txn("1", "2021-01-01"), txn("2", "2021-02-01"))), refresh("2", account("b", txn("3")), site="other"), refresh("3", account("c", txn("4")), user="v"))
    kept = run(spark, tmp_path)
    side = kept.rows("transactions").select("user_id", "account_id", "date", "id", F.col("external_id").alias("cycle_id"))
    wide = side.select(*(F.col(f.name) if f.name in side.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], ledger.ENRICHMENTS).schema))
    cycles = side.select(*(F.col(f.name) if f.name in ("user_id", "cycle_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], ledger.CYCLES).schema))
    none = lambda df, n: df.limit(0).select(*ledger.TABLES[n].keys)
    kept.apply("side", lambda t: {"enrichments": tables.Change(wide, none(wide, "enrichments")), "cycles": tables.Change(cycles, none(cycles, "cycles"))})
    events = str(tmp_path / "events")
    schema = "user_id string, user_site_id string, payload_type string"
    spark.createDataFrame([("u", "s", "DELETE_USER_SITE"), ("v", "s", "UPDATED"), ("x", "s", "DELETE_USER_SITE")], schema).write.parquet(events)
    feed = kept.log("feed").count()
    for check in ("c1", "c2"):
        ledger.forget_stream(spark.readStream.schema(schema).parquet(events), kept, str(tmp_path / check)).awaitTermination(300)
        assert [rows(kept.rows(n), c) for n, c in (("accounts", "external_id"), ("transactions", "external_id"), ("enrichments", "cycle_id"), ("cycles", "cycle_id"))] == [[("b",), ("c",)]] + [[("3",), ("4",)]] * 3
        assert kept.log("feed").count() == feed + 3
    assert not {r.month for r in kept.read("transactions").select("month").collect()} & {"2021-01", "2021-02"}
    assert not (tmp_path / "tables" / "transactions" / "month=2021-01").exists() or not list((tmp_path / "tables" / "transactions" / "month=2021-01").iterdir())


def test_keyed_changes_in_one_pass(spark):
    schema = "k long, v string, created_at string"
    stored = spark.createDataFrame([(k, f"old{k}", "then") for k in range(5)], schema)
    asked = spark.createDataFrame([(0, None, None, "DELETE"), (1, "u1", "now", "UPDATE"), (2, None, None, "DELETE"), (2, "i2", "now", "INSERT"), (9, None, None, "DELETE"), (8, "i8", "now", "INSERT"), (3, "x", "x", "IGNORE")], schema + ", action string")
    changes = merges.keyed_changes(stored, asked, ["k"])
    puts, gone = merges.instruction_change(changes, stored.columns, ["k"])
    assert rows(puts, "*") == [(1, "u1", "then"), (2, "i2", "then"), (8, "i8", "now")] and rows(gone, "k") == [(0,), (9,)]
    assert rows(tables.after(stored, tables.Change(puts, gone), ["k"]), "*") == rows(merges.apply_instructions(stored, asked, ["k"]), "*")


def test_transaction_rows_keep_instants_in_any_session_zone(spark):
    schema = messages.REFRESH
    line = json.dumps(refresh("1", account("a", txn("1", "2021-10-31") | {"dateTime": "2021-10-31T02:30:00+01:00"})))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        entries = messages.upstream_accounts(spark.read.json(spark.sparkContext.parallelize([line]), schema=schema)).withColumn("account_id", F.lit("x"))
        row = ingestion.transaction_rows(entries).select("date", F.col("ts").cast("string").alias("ts"), "time_zone", "pos", "unsigned").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.date, row.ts, row.time_zone, row.pos, float(row.unsigned)) == (date(2021, 10, 31), "2021-10-31 01:30:00", "+01:00", 0, 5.0)
