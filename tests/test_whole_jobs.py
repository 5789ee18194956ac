"""Reports and groups cover every row, level and counter."""

import json
from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F
from test_matching import ST, UP, day, st, up

from ledgerframe.operators import accounts, greedy, matching, reports, router
from ledgerframe.plans import catalog
from ledgerframe.plans.fixtures import Fixtures

SF_DIR = "/root/testdata/sf0.001"


def test_no_account_is_left_out(spark):
    stored = Fixtures(spark, SF_DIR).stored
    accounts = lambda df: {r.account_id for r in df.select("account_id").distinct().collect()}
    found = lambda name: accounts(catalog.queries()[name](spark, SF_DIR))
    assert found("j7_group_similar_all") == accounts(stored)
    assert found("a5_start_balance_check_all") == accounts(stored.where("status = 'BOOKED'"))
    assert any(a % 9 == 0 for a in found("j2_collision_free_all"))


def test_json_absence_at_any_depth(spark):
    deep = None
    for name in "gfedcba":
        deep = {name: deep}
    rows = [("m", json.dumps({"accounts": [{"transactions": [{"amount": None}, {"amount": 1}]}], "x": deep}))]
    got = {(r.path, r.nulls, r.share) for r in reports.json_absence(spark.createDataFrame(rows, "kind string, value string"), ["kind"]).collect()}
    assert got == {("root.accounts.[].transactions.[].amount", 1, 0.5), ("root.x.a.b.c.d.e.f.g", 1, 1.0)}


def test_all_fourteen_counters(spark):
    u = up(
        spark, ("a", day(5), "BOOKED", "CREDIT", D("1"), "x"), ("b", day(6), "PENDING", "CREDIT", D("2"), "x"), ("d", day(7), "BOOKED", "CREDIT", D("3"), "x"), ("d", day(8), "BOOKED", "CREDIT", D("4"), "x"),
        (None, day(9), "BOOKED", "CREDIT", D("5"), "x"), ("", day(10), "BOOKED", "CREDIT", D("6"), "x"), ("same", day(11), "BOOKED", "CREDIT", D("7"), "x"),
    )
    s = st(
        spark, ("1", "a", day(5), "PENDING", D("1"), "x"), ("2", "b", day(6), "BOOKED", D("2"), "x"), ("3", "gone", day(12), "BOOKED", D("8"), "x"), ("4", "lost", day(13), "PENDING", D("9"), "x"),
        ("5", None, day(9), "BOOKED", D("5"), "x"), ("6", "same", day(11), "BOOKED", D("7"), "x"),
    )
    done = greedy.reconcile_default(u, s)
    got = {r.counter: r.value for r in greedy.reconciliation_counters(done, u, s, ["user_id"]).collect()}
    assert got == {
        "upstream_total": 7, "upstream_new": 3, "upstream_update": 2, "upstream_unchanged": 2, "stored_total": 6, "stored_match_extid": 3, "stored_match_uniq_attrs": 1, "stored_match_attrs": 0,
        "stored_no_match_booked": 1, "stored_no_match_pending": 1, "stored_pending_to_booked": 1, "stored_booked_to_pending": 1, "quality_extid_missing": 2, "quality_extid_dupes": 2,
    }


def test_start_balances_of_recent_accounts_only(spark):
    accounts = spark.createDataFrame([(1, a, True, [("CURRENT", D("3"))]) for a in (1, 2)], "user_id long, account_id long, is_new boolean, balances array<struct<type:string,amount:decimal(18,2)>>")
    rows = [(1, a, "INSERT", datetime(y, 3, 1).date(), "BOOKED", datetime(y, 3, 1), D("3")) for a, y in ((1, 2021), (2, 2018))]
    ins = spark.createDataFrame(rows, "user_id long, account_id long, action string, date date, status string, ts timestamp_ntz, amount decimal(18,2)")
    assert {(r.account_id, r.equal) for r in reports.start_balance_check(accounts, ins, "2021-04-01 00:00:00").collect()} == {(1, True)}


def test_router_runs_each_provider_by_its_own_rules(spark):
    def rows(account, provider, ids, amounts=None):
        return [(1, account, k, e, day(5 + k), "BOOKED", "CREDIT", (amounts or {}).get(k, D(k + 1)), "x", day(5 + k), datetime(2021, 3, 5 + k), provider) for k, e in enumerate(ids)]

    made = rows(1, "RABOBANK", ["7", "8"]) + rows(2, "RABOBANK", ["7", "x"]) + rows(3, "BUDGET_INSIGHT", ["a"]) + rows(4, None, ["a"]) + rows(5, "SOME_BANK", ["a", "b"], {1: D("1.005")}) + rows(6, "KNAB_BANK_NL", ["n"]) + rows(7, "ING_NL", [None])
    upstream = spark.createDataFrame(made, UP.replace("amount decimal(18,2)", "amount decimal(18,3)") + ", provider string")
    old = [(1, 1, "low", "6", day(5)), (1, 1, "kept", "7", day(5)), (1, 4, "s", "a", day(5)), (1, 6, "gone", "z", day(5)), (1, 7, "t", None, day(5))]
    stored = spark.createDataFrame([(*x, "BOOKED", D("1"), "x", d, datetime(2021, 3, d.day, 9 if i == "t" else 0)) for *x, d in old for i in [x[2]] for x in [(*x, d)]], ST)
    done, failed = router.reconcile(upstream, stored)
    got = {(r.account_id, r.strategy, r.action, r.stored_row, r.upstream_row) for r in done.collect()}
    assert got == {(1, "attributes", "INSERT", None, "1"), (3, "delta", "INSERT", None, "0"), (4, "default", "IGNORE", "s", "0"), (6, "attributes", "INSERT", None, "0")}
    assert {(r.account_id, r.outcome) for r in failed.collect()} == {(2, "FATAL_EXTERNAL_ID"), (5, "FATAL_AMOUNT_SCALE")}


def test_old_months_never_reach_the_window(spark, tmp_path):
    stored = Fixtures(spark, SF_DIR).stored.withColumn("month", F.date_format("date", "yyyy-MM"))
    stored.repartition("month").write.partitionBy("month").parquet(str(tmp_path / "t"))
    table, upstream = spark.read.parquet(str(tmp_path / "t")), Fixtures(spark, SF_DIR).upstream
    found = matching.stored_in_window(upstream, table)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "GreaterThanOrEqual(date" in plan
    assert found.count() == matching.stored_in_window(upstream, stored).count()


def test_a_matched_account_of_another_currency_is_a_conflict(spark):
    shape = "user_id long, pos long, id long, external_id string, scheme string, number string, currency string, masked string, type string, last_fetch timestamp_ntz"
    row = lambda k, ext, currency: (1, k, 10 + k, ext, None, None, currency, None, "CURRENT_ACCOUNT", None)
    upstream = spark.createDataFrame([row(0, "a", "EUR"), row(1, "b", "EUR"), row(2, "new", "EUR")], shape).drop("id", "last_fetch")
    stored = spark.createDataFrame([row(0, "a", "EUR"), row(1, "b", "GBP")], shape).drop("pos")
    matches = accounts.match_accounts(upstream, stored, ["user_id"])
    assert [tuple(r) for r in accounts.currency_conflicts(matches, upstream, stored, ["user_id"]).collect()] == [(1, 1)]
