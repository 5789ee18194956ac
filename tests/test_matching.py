"""Literal cases of the matchers and strategies."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerframe.operators import greedy, matching

UP = "user_id long, account_id long, pos int, external_id string, date date, status string, type string, amount decimal(18,2), description string, booking_date date, ts timestamp_ntz"
ST = "user_id long, account_id long, id string, external_id string, date date, status string, amount decimal(18,2), description string, booking_date date, ts timestamp_ntz"


def day(n):
    return date(2021, 3, n)


def up(spark, *rows):
    return spark.createDataFrame([(1, 1, i, e, d, s, t, a, x, d, datetime(d.year, d.month, d.day)) for i, (e, d, s, t, a, x) in enumerate(rows)], UP)


def st(spark, *rows):
    return spark.createDataFrame([(1, 1, i, e, d, s, a, x, d, datetime(d.year, d.month, d.day)) for i, e, d, s, a, x in rows], ST)


def stage(spark, u, s, stages=(matching.EXTERNAL_ID_AMOUNT,)):
    rows = matching.unmatched(matching.generalize(u, "upstream"), matching.generalize(s, "stored"))
    for one in stages:
        rows = matching.match_on_equality(rows, one)
    return {(r.side, r.row): (r.reason, r.matcher, r.partner) for r in rows.collect()}


def test_scale_and_sign(spark):
    u = up(spark, ("a", day(1), "BOOKED", "CREDIT", D("1.0"), "x"), ("b", day(1), "BOOKED", "CREDIT", D("2"), "x"))
    s = st(spark, ("1", "a", day(1), "BOOKED", D("1.00"), "x"), ("2", "b", day(1), "BOOKED", D("-2.00"), "x"))
    found = stage(spark, u, s)
    assert found["upstream", "0"] == ("MATCHED", "ExternalIdAmountStrict", "1")
    assert found["upstream", "1"][0] == "PEERLESS" and found["stored", "2"][0] == "PEERLESS"


def test_reject_duplicate_and_precedence(spark):
    u = up(spark, ("a", day(1), "BOOKED", "CREDIT", D("1"), "x"), ("a", day(1), "BOOKED", "CREDIT", D("1"), "x"), (None, day(2), "BOOKED", "CREDIT", D("3"), "y"), (" ", day(3), "BOOKED", "CREDIT", D("4"), "z"))
    s = st(spark, ("1", "a", day(1), "BOOKED", D("1"), "x"), ("2", None, day(2), "BOOKED", D("3"), "y"))
    first = stage(spark, u, s)
    assert len(first) == 6
    assert first["upstream", "0"][0] == first["upstream", "1"][0] == "DUPLICATE"
    assert first["stored", "1"][0] == "PEERLESS" and first["upstream", "3"][0] == "REJECTED"
    both = stage(spark, u, s, (matching.EXTERNAL_ID_AMOUNT, matching.BOOKING_DATE_AMOUNT))
    assert both["upstream", "2"] == ("MATCHED", "BookingDateAmountStrict", "2")
    assert both["stored", "1"][:2] == ("PEERLESS", "BookingDateAmountStrict")
    assert both["upstream", "3"][0] == "PEERLESS"


@pytest.mark.parametrize(("stored_day", "outcome"), [(2, "OK"), (3, "FATAL_STORED_PEERLESS")])
def test_peerless_stored_only_on_oldest_day(spark, stored_day, outcome):
    u = up(spark, ("a", day(2), "BOOKED", "CREDIT", D("1"), "x"), ("b", day(9), "BOOKED", "CREDIT", D("2"), "x"))
    s = st(spark, ("1", "a", day(2), "BOOKED", D("1"), "x"), ("9", "gone", day(stored_day), "BOOKED", D("7"), "x"))
    rows = matching.match_attributes(u, s, [matching.EXTERNAL_ID_AMOUNT]).collect()
    assert {r.outcome for r in rows} == {outcome}
    assert len(rows) == 4


def test_backfill_fresh_and_pending(spark):
    u = up(spark, ("old", day(1), "BOOKED", "CREDIT", D("1"), "x"), ("new", day(20), "BOOKED", "CREDIT", D("2"), "x"), ("k", day(18), "BOOKED", "CREDIT", D("3"), "x"))
    s = st(spark, ("1", "k", day(18), "BOOKED", D("3"), "x"), ("2", "p", day(19), "PENDING", D("4"), "x"))
    got = {(r.action, r.row): r.fill_type for r in matching.reconcile_attributes(u, s, [matching.EXTERNAL_ID_AMOUNT]).collect()}
    assert got == {("INSERT", "0"): "BACKFILLED", ("INSERT", "1"): "REGULAR", ("DELETE", "2"): None}
    fresh = matching.reconcile_attributes(u, s.limit(0), [matching.EXTERNAL_ID_AMOUNT])
    assert {r.fill_type for r in fresh.collect()} == {"REGULAR"} and fresh.count() == 3


def greedy_actions(spark, u, s):
    return {(r.action, r.stored_row, r.upstream_row) for r in greedy.reconcile_default(u, s).collect()}


def test_moved_row_keeps_its_id(spark):
    u = up(spark, ("a", day(5), "BOOKED", "CREDIT", D("1"), "x"))
    s = st(spark, ("1", "a", day(6), "BOOKED", D("1"), "x"))
    assert greedy_actions(spark, u, s) == {("DELETE", "1", "0"), ("UPDATE", "1", "0")}


def test_one_id_for_all_rows(spark):
    u = up(spark, ("x", day(5), "BOOKED", "CREDIT", D("1"), "a"), ("x", day(6), "BOOKED", "CREDIT", D("2"), "b"))
    s = st(spark, ("2", "x", day(6), "BOOKED", D("2"), "b"), ("1", "x", day(5), "BOOKED", D("1"), "a"))
    assert greedy_actions(spark, u, s) == {("IGNORE", "1", "0"), ("IGNORE", "2", "1")}


def test_attributes_when_ids_are_missing(spark):
    u = up(spark, (None, day(5), "PENDING", "DEBIT", D("1"), "a"), (None, day(5), "BOOKED", "DEBIT", D("1"), "b"), (None, day(5), "BOOKED", "DEBIT", D("1"), "c"))
    s = st(spark, ("1", None, day(5), "BOOKED", D("-1"), "c"), ("2", "lost", day(7), "BOOKED", D("9"), "z"))
    assert greedy_actions(spark, u, s) == {("IGNORE", "1", "2"), ("DELETE", "2", None), ("INSERT", None, "0"), ("INSERT", None, "1")}


@pytest.mark.parametrize(("upstream", "stored", "relation", "lower"), [
    ((5, 5), (5, 9), "MEETS", None), ((9, 9), (5, 9), "MET_BY", 9), ((5, 7), (5, 9), "STARTS", 6), ((7, 9), (5, 9), "FINISHES", 8), ((5, 9), (5, 9), "EQUAL", 6), ((1, 3), (5, 9), "PRECEDES", None), ((11, 12), (5, 9), "PRECEDED_BY", 11),
    ((9, 12), (5, 9), "MET_BY", 9), ((7, 12), (5, 9), "OVERLAPPED_BY", 8), ((6, 8), (5, 9), "DURING", 7), ((1, 12), (5, 9), "CONTAINS", None), ((1, 7), (5, 9), "OVERLAPS", None),
])
def test_sync_bounds(spark, upstream, stored, relation, lower):
    frame = lambda ends: spark.createDataFrame([(1, 1, day(e)) for e in ends], "user_id long, account_id long, booking_date date")
    row = matching.sync_bounds(frame(upstream), frame(stored)).first()
    assert (row.relation, row.lower) == (relation, day(lower) if lower else None)


def test_refresh_twice_changes_nothing(spark):
    u = up(spark, ("a", day(2), "BOOKED", "CREDIT", D("1"), "x"), ("b", day(9), "BOOKED", "DEBIT", D("2"), "y"))
    s = u.select("user_id", "account_id", F.concat(F.lit("s"), "pos").alias("id"), "external_id", "date", "status", F.when(F.col("type") == "DEBIT", -F.col("amount")).otherwise(F.col("amount")).cast("decimal(18,2)").alias("amount"), "description", "booking_date", "ts")
    s = spark.createDataFrame(s.collect(), ST)
    assert matching.reconcile_attributes(u, s, [matching.EXTERNAL_ID_AMOUNT]).count() == 0
    assert {a for a, _, _ in greedy_actions(spark, u, s)} == {"IGNORE"}
