"""The default strategy against a plain loop over each account's rows in order."""

import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from test_matching import ST, UP, day, greedy_actions, st, up

from ledgerframe.operators import greedy, matching
from ledgerframe.operators.graph import components


def plain_loop(stored, upstream):
    """(action, stored id, upstream position) of one account; rows as in ``UP`` and ``ST``, nothing indexed."""
    sign = lambda u: -abs(u[7]) if u[6] == "DEBIT" else abs(u[7])
    free, out = list(upstream), []
    for s in sorted(stored, key=lambda s: (-s[4].toordinal(), s[2])):
        ids = [u for u in free if u[3] is not None and u[3] == s[3]]
        hit = None
        if len(ids) == 1:
            hit = ids[0]
        elif ids:
            same_day = [u for u in ids if u[4] == s[4]]
            hit = next((u for u in same_day if u[7] == s[6]), same_day[0] if same_day else None)
        else:
            like = [u for u in free if sign(u) == s[6] and u[4] == s[4] and not (s[5] == "BOOKED" and u[5] == "PENDING")]
            if len(like) > 1:
                like = [u for u in like if u[8] == s[7]]
            hit = like[0] if like else None
        if hit is None:
            out.append(("DELETE", s[2], None))
            continue
        free.remove(hit)
        if (hit[4], hit[5]) != (s[4], s[5]):
            out.append(("DELETE", s[2], str(hit[2])))
        same = (hit[3], hit[4], hit[5], sign(hit), hit[8]) == (s[3], s[4], s[5], s[6], s[7])
        out.append(("IGNORE" if same else "UPDATE", s[2], str(hit[2])))
    return out + [("INSERT", None, str(u[2])) for u in free]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_accounts_equal_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    midnight = lambda d: datetime(d.year, d.month, d.day)
    stored, upstream = [], []
    for account in range(250):
        ids = [None, *(f"e{k}" for k in range(rng.choice((1, 3, 8))))]
        n_up = rng.randint(1, 9)
        for pos in range(n_up):
            d = day(5) if pos == 0 else day(rng.randint(5, 7))
            upstream.append((1, account, pos, rng.choice(ids), d, rng.choice(("BOOKED", "PENDING")), rng.choice(("CREDIT", "DEBIT")), D(rng.randint(1, 3)), rng.choice("xy"), d, midnight(d)))
        for k in range(rng.randint(0, 9)):
            d = day(rng.randint(5, 7))
            stored.append((1, account, f"s{k}", rng.choice([*ids, "gone"]), d, rng.choice(("BOOKED", "PENDING")), D(rng.choice((-3, -2, -1, 1, 2, 3))), rng.choice("xy"), d, midnight(d)))
    found = greedy.reconcile_default(spark.createDataFrame(upstream, UP), spark.createDataFrame(stored, ST)).collect()
    got = sorted((r.account_id, r.action, r.stored_row or "", r.upstream_row or "") for r in found)
    wanted = sorted(
        (a, x, s or "", u or "") for a in range(250) for x, s, u in plain_loop([r for r in stored if r[1] == a], [r for r in upstream if r[1] == a])
    )
    assert got == wanted
    assert {r.how for r in found} >= {"external_id", "unique", "optimistic", "moved"}


def test_a_row_whose_id_is_gone_takes_before_a_later_row_of_the_id(spark):
    u = up(spark, ("b", day(5), "BOOKED", "CREDIT", D("1"), "x"))
    s = st(spark, ("1", "a", day(5), "BOOKED", D("1"), "x"), ("2", "b", day(5), "BOOKED", D("1"), "x"))
    assert greedy_actions(spark, u, s) == {("UPDATE", "1", "0"), ("DELETE", "2", None)}


def test_unsigned_debits_never_pass_the_amount_test(spark):
    u = up(spark, ("x", day(5), "BOOKED", "DEBIT", D("1"), "a"), ("x", day(5), "BOOKED", "DEBIT", D("2"), "b"))
    s = st(spark, ("1", "x", day(5), "BOOKED", D("-2"), "b"))
    assert ("UPDATE", "1", "0") in greedy_actions(spark, u, s)
    by_sign = greedy.reconcile_default(u, s, signed_tiebreak=False)
    assert {(r.action, r.stored_row, r.upstream_row) for r in by_sign.collect()} == {("IGNORE", "1", "1"), ("INSERT", None, "0")}


def test_one_day_and_amount_for_all_rows_is_linear():
    rows = lambda side: [{"row": f"{side}{k}", "external_id": None, "date": day(5), "status": "BOOKED", "cents": 100, "raw": 100, "description": "x"} for k in range(20_000)]
    found = greedy.match_rows(rows("s"), rows("u"))
    assert len(found) == 20_000 and {x[0] for x in found} == {"IGNORE"}


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 99), (101, 99), (7, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(41)} | {99: 99, 100: 99, 101: 99}


def _account(rng, n, ids, days, amounts):
    day = lambda: date(2021, 3, 1) + timedelta(days=rng.randrange(days))
    ext = lambda: rng.choice(ids)
    up = [(1, 7, k, ext(), day(), rng.choice(["BOOKED", "PENDING"]), "CREDIT", rng.randrange(1, amounts), rng.choice("xy")) for k in range(n)]
    st = [(1, 7, f"{k:05d}", ext(), day(), rng.choice(["BOOKED", "BOOKED", "PENDING"]), rng.randrange(1, amounts), rng.choice("xy")) for k in range(rng.randrange(n // 2, n + n // 2))]
    return up, st


def _frames(spark, up, st):
    ts = F.date_trunc("day", F.lit("2021-03-01").cast("timestamp_ntz"))
    upstream = spark.createDataFrame(up, "user_id long, account_id long, pos long, external_id string, date date, status string, type string, amount long, description string").withColumn("ts", ts)
    stored = spark.createDataFrame(st, "user_id long, account_id long, id string, external_id string, date date, status string, amount long, description string").withColumn("ts", F.col("date").cast("timestamp_ntz"))
    money = F.col("amount").cast("decimal(18,2)")
    return upstream.withColumn("amount", money), stored.withColumn("amount", money)


def _looped(upstream, stored):
    up = [r.asDict() for r in greedy._prepared(upstream, "upstream").orderBy("first", "second").collect()]
    st = [r.asDict() for r in greedy._prepared(stored, "stored").orderBy("first", "second").collect()]
    return sorted(map(repr, greedy.match_rows(st, up)))


@pytest.mark.parametrize(("seed", "ids"), [(1, ["a"]), (2, ["a", "b", None]), (3, ["a", "a", "a", "b", "c", None, None]), (4, list("abcdefgh"))])
def test_large_components_in_rounds_give_the_plain_result(spark, monkeypatch, seed, ids):
    monkeypatch.setattr(greedy, "SPLIT_ROWS", 0)
    rng = random.Random(seed)
    upstream, stored = _frames(spark, *_account(rng, 60, ids, 6, 5))
    want = _looped(upstream, stored)
    columns = ["action", "stored_row", "upstream_row", "date", "how"]
    assert sorted(repr(tuple(r)) for r in greedy.reconcile_default(upstream, stored).select(columns).collect()) == want
    monkeypatch.setattr(greedy, "MAX_ROUNDS", 1)
    assert sorted(repr(tuple(r)) for r in greedy.reconcile_default(upstream, stored).select(columns).collect()) == want


def test_one_id_for_a_whole_account_is_matched_in_several_tasks(spark, monkeypatch):
    rng = random.Random(9)
    upstream, stored = _frames(spark, *_account(rng, 12_000, ["same"], 400, 50))
    groups = []
    plain = greedy._matched
    monkeypatch.setattr(greedy, "SPLIT_ROWS", 1000)
    monkeypatch.setattr(greedy, "_matched", lambda rows, group, signed: groups.append((group, rows)) or plain(rows, group, signed))
    got = sorted(repr(tuple(r)) for r in greedy.reconcile_default(upstream, stored).select("action", "stored_row", "upstream_row", "date", "how").collect())
    assert got == _looped(upstream, stored)
    parts = next(rows for group, rows in groups if group == ["part", "sub"])
    sizes = parts.groupBy("sub").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert sizes.n >= 300 and sizes.most < 200


def test_windows_are_pruned_by_account(spark):
    begin = lambda a, year: (1, a, datetime(year, 5, 2))
    upstream = spark.createDataFrame([begin(a, 2021) for a in range(20)] + [begin(99, 2001)], "user_id long, account_id long, ts timestamp_ntz")
    stored = spark.createDataFrame([(1, a, date(y, 6, 1)) for a in [*range(20), 99] for y in (2001, 2011, 2021)], "user_id long, account_id long, date date").withColumn("month", F.date_format("date", "yyyy-MM"))
    got = matching.pruned(stored, upstream)
    assert got.count() == 20 + 3 and {r.account_id for r in got.where("date < DATE '2021-01-01'").collect()} == {99}
    assert matching.pruned(stored, upstream, outliers=0).count() == 63
    assert matching.pruned(stored, upstream.limit(0)).count() == 0
