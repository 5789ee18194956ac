"""Registry of the ledger queries and their SQL oracles, by operator id."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import accounts as acc
from ..operators import greedy, matching, merges, projections, reads, reports, router
from ..sources import messages, sinks
from ..streaming import activities
from .fixtures import NOW, TODAY, Fixtures, with_views

Query = Callable[[Fixtures], DataFrame]
#: Dates and instants leave the queries, and their oracles, as text, and amounts as doubles.
_TEXT = ("date", "timestamp", "timestamp_ntz")
_MONEY = {
    "p1_to_stored_txn": ("amount", "original_amount"), "p3_to_stored_account": ("balance", "available"), "p4_to_analytics_txn": ("amount",), "p5_to_analytics_account": ("current_balance",),
    "p6_to_analytics_credit_card": ("running_balance", "total_credit_line"), "p8_account_view": ("credit_limit",), "p14_cycle_view": ("amount",), "p15_cycles_from_messages": ("amount",), "p9_transactions_between": ("amount",),
    "a2_account_groups": ("total",), "k1_apply_instructions": ("amount",), "k2_sparse_upsert": ("balance",), "k5_personal_accounts": ("balance",), "e2_cycle_changeset": ("amount",), "e3_apply_cycles": ("amount",),
}
#: Queries whose amounts stay decimals, as in their SQL.
_EXACT = ("k1_feed", "t1_ingest", "t1_ingest_accounts", "t2_latest_cycles")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
STAGE = matching.EXTERNAL_ID_AMOUNT
TWO_STAGES = (matching.EXTERNAL_ID_AMOUNT, matching.BOOKING_DATE_AMOUNT)


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _as_text(df: DataFrame, exact: bool = False) -> DataFrame:
    kinds = {kind: "string" for kind in _TEXT}
    to = lambda kind: "double" if kind.startswith("decimal") and not exact else kinds.get(kind, kind)
    return df.select(*(F.col(name).cast(to(kind)).alias(name) if to(kind) != kind else F.col(name) for name, kind in df.dtypes))


def _with_flows() -> None:
    from . import flows, served  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _with_flows()
    return {name: (lambda spark, sf_dir, f=f, exact=name in _EXACT: _as_text(f(Fixtures(spark, sf_dir)), exact)) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _with_flows()

    def plain(name: str, sql: str) -> str:
        money = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _MONEY.get(name, ()))
        return f"SELECT * REPLACE ({money}) FROM ({with_views(sql)}) answer" if money else with_views(sql)

    return {name: plain(name, sql) for name, sql in _ORACLES.items()}


# --- matching -------------------------------------------------------------------------------

_SIDES = """
up AS (SELECT user_id, account_id, CAST(pos AS VARCHAR) AS row, external_id, date, status, booking_date, ts, description,
  CAST(round(CASE WHEN type = 'DEBIT' THEN -amount ELSE amount END, 2) * 100 AS BIGINT) AS cents FROM fx_upstream),
st AS (SELECT user_id, account_id, id AS row, external_id, date, status, booking_date, ts, description, CAST(round(amount, 2) * 100 AS BIGINT) AS cents FROM fx_stored)"""

_ONE_STAGE = f"""
WITH {_SIDES},
u AS (SELECT *, external_id IS NOT NULL AS ok, count(*) OVER (PARTITION BY account_id, external_id, cents) AS n FROM up),
s AS (SELECT *, external_id IS NOT NULL AS ok, count(*) OVER (PARTITION BY account_id, external_id, cents) AS n FROM st),
r AS (
  SELECT u.user_id, u.account_id, 'upstream' AS side, u.row, CASE WHEN NOT u.ok THEN 'REJECTED' WHEN u.n > 1 THEN 'DUPLICATE' WHEN s.row IS NOT NULL THEN 'MATCHED' ELSE 'PEERLESS' END AS reason, s.row AS partner
  FROM u LEFT JOIN s ON u.account_id = s.account_id AND u.external_id = s.external_id AND u.cents = s.cents AND s.n = 1 AND u.n = 1
  UNION ALL
  SELECT s.user_id, s.account_id, 'stored', s.row, CASE WHEN NOT s.ok THEN 'REJECTED' WHEN s.n > 1 THEN 'DUPLICATE' WHEN u.row IS NOT NULL THEN 'MATCHED' ELSE 'PEERLESS' END, u.row
  FROM s LEFT JOIN u ON u.account_id = s.account_id AND u.external_id = s.external_id AND u.cents = s.cents AND s.n = 1 AND u.n = 1)"""


def _sides(fx: Fixtures) -> DataFrame:
    return matching.unmatched(matching.generalize(fx.upstream, "upstream"), matching.generalize(fx.stored, "stored"))


@query("p2_generalize", f"WITH {_SIDES} SELECT 'upstream' AS side, account_id, row, cents, external_id, CAST(booking_date AS VARCHAR) AS booking_date FROM up UNION ALL SELECT 'stored', account_id, row, cents, external_id, CAST(booking_date AS VARCHAR) FROM st")
def p2(fx):
    return _sides(fx).select("side", "account_id", "row", "cents", "external_id", "booking_date")


@query("j3_match_external_id", _ONE_STAGE + " SELECT user_id, account_id, side, reason, count(*) AS n FROM r GROUP BY ALL")
def j3(fx):
    return matching.match_on_equality(_sides(fx), STAGE).groupBy("user_id", "account_id", "side", "reason").agg(F.count("*").alias("n"))


@query("j3_matched_pairs", _ONE_STAGE + " SELECT account_id, row AS upstream_row, partner AS stored_row FROM r WHERE side = 'upstream' AND reason = 'MATCHED'")
def j3_pairs(fx):
    return matching.match_on_equality(_sides(fx), STAGE).where("side = 'upstream' AND partner IS NOT NULL").select("account_id", F.col("row").alias("upstream_row"), F.col("partner").alias("stored_row"))


_WINDOW = """
b AS (SELECT account_id, min(ts) AS t0 FROM fx_upstream GROUP BY account_id),
w AS (SELECT s.* FROM fx_stored s JOIN b USING (account_id) WHERE s.date >= CAST(t0 AS DATE) - INTERVAL 1 DAY AND (s.ts IS NULL AND s.date >= CAST(t0 AS DATE) OR date_trunc('second', s.ts) >= date_trunc('second', t0)))"""


@query("j1_stored_in_window", f"WITH {_WINDOW} SELECT account_id, id, CAST(date AS VARCHAR) AS date FROM w")
def j1(fx):
    return matching.stored_in_window(fx.upstream, fx.stored).select("account_id", "id", "date")


@query("j1_numeric_ids", """
WITH u AS (SELECT account_id, ts, CAST(order_no AS BIGINT) AS n FROM fx_upstream),
b AS (SELECT account_id, min(ts) AS t0, min(n) AS low, count(DISTINCT n) = max(n) - min(n) + 1 AS dense FROM u GROUP BY account_id),
s AS (SELECT account_id, date, ts, CAST(id AS BIGINT) AS n FROM fx_stored)
SELECT s.account_id, s.n AS id FROM s JOIN b USING (account_id)
WHERE s.date >= CAST(t0 AS DATE) - INTERVAL 1 DAY AND (NOT dense OR s.n >= low)
  AND (EXISTS (SELECT 1 FROM u WHERE u.account_id = s.account_id AND u.n = s.n) OR date_trunc('second', s.ts) >= date_trunc('second', t0))""")
def j1_numeric(fx):
    up = fx.upstream.withColumn("external_id", F.col("order_no").cast("string"))
    st = fx.stored.withColumn("external_id", F.col("id"))
    return matching.stored_in_window(up, st, numeric_ids=True).select("account_id", F.col("id").cast("long").alias("id"))


_BOUNDS = """
a AS (SELECT account_id, min(booking_date) AS us, max(booking_date) AS ue FROM fx_upstream GROUP BY account_id),
d AS (SELECT account_id, min(booking_date) AS ss, max(booking_date) AS se FROM fx_stored GROUP BY account_id),
rel AS (SELECT account_id, us, ue, ss, se, CASE WHEN ss IS NULL THEN 'UNBOUNDED' WHEN us = ss AND ue = se THEN 'EQUAL' WHEN ue < ss THEN 'PRECEDES' WHEN us > se THEN 'PRECEDED_BY'
  WHEN ue = ss THEN 'MEETS' WHEN us = se THEN 'MET_BY' WHEN us < ss AND ue < se THEN 'OVERLAPS' WHEN us > ss AND ue > se THEN 'OVERLAPPED_BY' WHEN us = ss AND ue < se THEN 'STARTS'
  WHEN us = ss THEN 'STARTED_BY' WHEN us > ss AND ue < se THEN 'DURING' WHEN us < ss AND ue > se THEN 'CONTAINS' WHEN us > ss THEN 'FINISHES' ELSE 'FINISHED_BY' END AS relation
  FROM a LEFT JOIN d USING (account_id))"""


@query("j5_sync_window", f"""WITH {_BOUNDS}
SELECT account_id, relation, CAST(CAST(CASE WHEN relation IN ('STARTS','DURING') THEN us + CAST(ue > us AS INTEGER) WHEN relation IN ('PRECEDED_BY','MET_BY') THEN us
  WHEN relation IN ('OVERLAPPED_BY','STARTED_BY','FINISHES','EQUAL') THEN us + CAST(us < se AND ue > us AS INTEGER) END AS DATE) AS VARCHAR) AS lower FROM rel""")
def j5(fx):
    return matching.sync_bounds(fx.upstream, fx.stored).select("account_id", "relation", "lower")


_STRATEGY = f"""
WITH {_WINDOW},
u0 AS (SELECT user_id, account_id, CAST(pos AS VARCHAR) AS row, external_id, date, booking_date, ts, description, CAST(round(CASE WHEN type = 'DEBIT' THEN -amount ELSE amount END, 2) * 100 AS BIGINT) AS cents FROM fx_upstream),
s0 AS (SELECT user_id, account_id, id AS row, external_id, date, booking_date, ts, description, CAST(round(amount, 2) * 100 AS BIGINT) AS cents FROM w WHERE status = 'BOOKED'),
u1 AS (SELECT *, external_id IS NOT NULL AND count(*) OVER (PARTITION BY account_id, external_id, cents) = 1 AS one FROM u0),
s1 AS (SELECT *, external_id IS NOT NULL AND count(*) OVER (PARTITION BY account_id, external_id, cents) = 1 AS one FROM s0),
m1 AS (SELECT u1.account_id, u1.row AS u, s1.row AS s FROM u1 JOIN s1 USING (account_id, external_id, cents) WHERE u1.one AND s1.one),
u2 AS (SELECT *, count(*) OVER (PARTITION BY account_id, booking_date, cents, description, external_id, ts) AS n FROM u1 WHERE (account_id, row) NOT IN (SELECT account_id, u FROM m1)),
s2 AS (SELECT *, count(*) OVER (PARTITION BY account_id, booking_date, cents, description, external_id, ts) AS n FROM s1 WHERE (account_id, row) NOT IN (SELECT account_id, s FROM m1)),
m2 AS (SELECT u2.account_id, u2.row AS u, s2.row AS s FROM u2 JOIN s2 ON u2.account_id = s2.account_id AND u2.booking_date = s2.booking_date AND u2.cents = s2.cents
  AND u2.description IS NOT DISTINCT FROM s2.description AND u2.external_id IS NOT DISTINCT FROM s2.external_id AND u2.ts IS NOT DISTINCT FROM s2.ts AND u2.n = 1 AND s2.n = 1),
ul AS (SELECT *, CASE WHEN n > 1 THEN 'DUPLICATE' ELSE 'PEERLESS' END AS reason FROM u2 WHERE (account_id, row) NOT IN (SELECT account_id, u FROM m2)),
sl AS (SELECT *, CASE WHEN n > 1 THEN 'DUPLICATE' ELSE 'PEERLESS' END AS reason FROM s2 WHERE (account_id, row) NOT IN (SELECT account_id, s FROM m2)),
acct AS (SELECT user_id, account_id, min(date) AS oldest FROM u0 GROUP BY ALL),
fresh AS (SELECT account_id, max(date) AS newest FROM w GROUP BY account_id),
o AS (SELECT user_id, account_id, oldest, newest, newest IS NULL AS is_fresh, CASE WHEN newest IS NULL THEN 'OK'
  WHEN EXISTS (SELECT 1 FROM sl WHERE sl.account_id = acct.account_id AND reason = 'PEERLESS' AND date <> oldest) THEN 'FATAL_STORED_PEERLESS'
  WHEN EXISTS (SELECT 1 FROM sl WHERE sl.account_id = acct.account_id AND reason = 'DUPLICATE') THEN 'FATAL_STORED_DUPLICATE'
  WHEN EXISTS (SELECT 1 FROM ul WHERE ul.account_id = acct.account_id AND reason = 'DUPLICATE') THEN 'FATAL_UPSTREAM_DUPLICATE' ELSE 'OK' END AS outcome
  FROM acct LEFT JOIN fresh USING (account_id))"""


@query("j4_outcomes", _STRATEGY + " SELECT user_id, account_id, outcome FROM o")
def j4_outcomes(fx):
    return matching.match_attributes(fx.upstream, fx.stored, TWO_STAGES).select("user_id", "account_id", "outcome").distinct()


@query("j4_reconcile_attributes", _STRATEGY + """
SELECT o.user_id, o.account_id, 'INSERT' AS action, u0.row, CAST(u0.date AS VARCHAR) AS date, CASE WHEN is_fresh OR u0.date > newest - 7 THEN 'REGULAR' ELSE 'BACKFILLED' END AS fill_type
FROM o JOIN u0 ON o.account_id = u0.account_id WHERE outcome = 'OK' AND (is_fresh OR (u0.account_id, u0.row) IN (SELECT account_id, row FROM ul WHERE reason = 'PEERLESS'))
UNION ALL SELECT o.user_id, o.account_id, 'DELETE', w.id, CAST(w.date AS VARCHAR), NULL FROM o JOIN w ON o.account_id = w.account_id WHERE outcome = 'OK' AND w.status = 'PENDING'""")
def j4(fx):
    return matching.reconcile_attributes(fx.upstream, fx.stored, TWO_STAGES)


@query("u3_match_report", _ONE_STAGE + " SELECT user_id, account_id, 'ExternalIdAmountStrict' AS matcher, side, reason, count(*) AS n FROM r GROUP BY ALL")
def u3(fx):
    return matching.match_report(matching.match_on_equality(_sides(fx), STAGE))


#: The default strategy where no two orders of an account share day and amount: a stored row takes the first copy of its order.
_DEFAULT = f"""
{_WINDOW},
up1 AS (SELECT *, count(*) OVER (PARTITION BY account_id, order_no) AS copies FROM fx_upstream),
dm AS (SELECT coalesce(u.user_id, s.user_id) AS user_id, coalesce(u.account_id, s.account_id) AS account_id, s.id AS stored_row, CAST(u.pos AS VARCHAR) AS upstream_row,
  s.date AS sd, u.date AS ud, s.status AS ss, u.status AS us, u.external_id, u.copies,
  round(CASE WHEN u.type = 'DEBIT' THEN -u.amount ELSE u.amount END, 2) = round(s.amount, 2) AND u.description IS NOT DISTINCT FROM s.description AS alike
  FROM up1 u FULL JOIN w s ON u.account_id = s.account_id AND CAST(u.order_no AS VARCHAR) = s.id AND u.copy_no = 0),
done AS (SELECT user_id, account_id, 'INSERT' AS action, stored_row, upstream_row, ud AS date, CAST(NULL AS VARCHAR) AS how, ss, us FROM dm WHERE stored_row IS NULL
  UNION ALL SELECT user_id, account_id, 'DELETE', stored_row, upstream_row, sd, NULL, ss, us FROM dm WHERE upstream_row IS NULL
  UNION ALL SELECT user_id, account_id, 'DELETE', stored_row, upstream_row, sd, 'moved', ss, us FROM dm WHERE upstream_row IS NOT NULL AND stored_row IS NOT NULL AND (sd <> ud OR ss <> us)
  UNION ALL SELECT user_id, account_id, CASE WHEN alike AND sd = ud AND ss = us THEN 'IGNORE' ELSE 'UPDATE' END, stored_row, upstream_row, ud,
    CASE WHEN external_id IS NOT NULL THEN 'external_id' WHEN copies = 1 THEN 'unique' ELSE 'optimistic' END, ss, us FROM dm WHERE upstream_row IS NOT NULL AND stored_row IS NOT NULL)"""


@query("j2_reconcile_default", f"WITH {_DEFAULT} SELECT user_id, account_id, action, stored_row, upstream_row, CAST(date AS VARCHAR) AS date, how FROM done")
def j2(fx):
    return greedy.reconcile_default(fx.upstream, fx.stored)


@query("j2_each_row_once", f"""
WITH {_WINDOW} SELECT account_id, 'stored' AS side, id AS row, 1::BIGINT AS n FROM w UNION ALL SELECT account_id, 'upstream', CAST(pos AS VARCHAR), 1 FROM fx_upstream""")
def j2_once(fx):
    done = greedy.reconcile_default(fx.upstream, fx.stored).where("how IS DISTINCT FROM 'moved'")
    sides = (done.where(f"{side}_row IS NOT NULL").select("account_id", F.lit(side).alias("side"), F.col(f"{side}_row").alias("row")) for side in ("stored", "upstream"))
    return next(sides).unionByName(next(sides)).groupBy("account_id", "side", "row").agg(F.count("*").alias("n"))


#: Accounts in which an external id occurs more than once on a side.
_COLLIDING = " UNION ALL ".join(f"SELECT account_id FROM {side} WHERE external_id IS NOT NULL GROUP BY account_id, external_id HAVING count(*) > 1" for side in ("fx_upstream", "fx_stored"))


@query("j2_collision_free", f"""
WITH ub AS (SELECT * FROM fx_upstream WHERE external_id IS NOT NULL AND account_id NOT IN ({_COLLIDING})),
b AS (SELECT account_id, min(ts) AS t0 FROM ub GROUP BY account_id),
sb AS (SELECT s.* FROM fx_stored s JOIN b USING (account_id) WHERE external_id IS NOT NULL AND s.account_id NOT IN ({_COLLIDING}) AND date_trunc('second', s.ts) >= date_trunc('second', t0)),
j AS (SELECT coalesce(u.account_id, s.account_id) AS account_id, CAST(u.pos AS VARCHAR) AS u, s.id AS s, u.date AS ud, s.date AS sd, u.status AS us, s.status AS ss,
  round(CASE WHEN u.type = 'DEBIT' THEN -u.amount ELSE u.amount END, 2) = round(s.amount, 2) AND u.description IS NOT DISTINCT FROM s.description AS same
  FROM ub u FULL JOIN sb s ON u.account_id = s.account_id AND u.external_id = s.external_id)
SELECT account_id, 'INSERT' AS action, NULL AS stored_row, u AS upstream_row FROM j WHERE s IS NULL
UNION ALL SELECT account_id, 'DELETE', s, NULL FROM j WHERE u IS NULL
UNION ALL SELECT account_id, 'DELETE', s, u FROM j WHERE u IS NOT NULL AND s IS NOT NULL AND (ud <> sd OR us <> ss)
UNION ALL SELECT account_id, CASE WHEN same AND ud = sd AND us = ss THEN 'IGNORE' ELSE 'UPDATE' END, s, u FROM j WHERE u IS NOT NULL AND s IS NOT NULL""")
def j2_free(fx):
    known = lambda df: df.where("external_id IS NOT NULL")
    twice = lambda df: known(df).groupBy("account_id", "external_id").count().where("count > 1").select("account_id")
    colliding = twice(fx.upstream).unionByName(twice(fx.stored)).distinct()
    free = lambda df: known(df).join(colliding, "account_id", "left_anti")
    return greedy.reconcile_default(free(fx.upstream), free(fx.stored)).select("account_id", "action", "stored_row", "upstream_row")


query("j2_collision_free_all", _ORACLES["j2_collision_free"])(j2_free)


@query("a3_reconciliation_counters", f"""
WITH {_DEFAULT},
p AS (SELECT DISTINCT CAST(account_id % 5 AS VARCHAR) AS provider FROM fx_upstream),
d AS (SELECT CAST(account_id % 5 AS VARCHAR) AS provider, count(*) FILTER (action = 'INSERT') AS upstream_new, count(*) FILTER (how = 'moved') AS upstream_update, count(*) FILTER (action = 'IGNORE') AS upstream_unchanged,
  count(*) FILTER (how = 'external_id') AS stored_match_extid, count(*) FILTER (how = 'unique') AS stored_match_uniq_attrs, count(*) FILTER (how = 'optimistic') AS stored_match_attrs,
  count(*) FILTER (action = 'DELETE' AND how IS NULL AND ss = 'BOOKED') AS stored_no_match_booked, count(*) FILTER (action = 'DELETE' AND how IS NULL AND ss = 'PENDING') AS stored_no_match_pending,
  count(*) FILTER (action IN ('UPDATE', 'IGNORE') AND ss = 'PENDING' AND us = 'BOOKED') AS stored_pending_to_booked, count(*) FILTER (action IN ('UPDATE', 'IGNORE') AND ss = 'BOOKED' AND us = 'PENDING') AS stored_booked_to_pending
  FROM done GROUP BY 1),
i AS (SELECT CAST(account_id % 5 AS VARCHAR) AS provider, sum(n) AS upstream_total, sum(n) FILTER (external_id IS NULL) AS quality_extid_missing, coalesce(sum(n) FILTER (external_id IS NOT NULL AND n > 1), 0) AS quality_extid_dupes
  FROM (SELECT account_id, external_id, count(*) AS n FROM fx_upstream GROUP BY ALL) x GROUP BY 1),
t AS (SELECT CAST(account_id % 5 AS VARCHAR) AS provider, count(*) AS stored_total FROM w GROUP BY 1),
wide AS (SELECT provider, * EXCLUDE (provider) FROM p LEFT JOIN d USING (provider) LEFT JOIN i USING (provider) LEFT JOIN t USING (provider))
SELECT provider, counter, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT provider, COLUMNS(* EXCLUDE (provider))::BIGINT FROM wide) ON * EXCLUDE (provider) INTO NAME counter VALUE value)""")
def a3(fx):
    of = lambda df: df.withColumn("provider", (F.col("account_id") % 5).cast("string"))
    done = greedy.reconcile_default(fx.upstream, fx.stored)
    return greedy.reconciliation_counters(of(done), of(fx.upstream), of(fx.stored), ["provider"])


@query("u1_reconcile_delta", "SELECT user_id, account_id, 'INSERT' AS action, external_id AS row, CAST(date AS VARCHAR) AS date, 'REGULAR' AS fill_type FROM fx_upstream WHERE status = 'BOOKED'")
def u1(fx):
    return greedy.reconcile_delta(fx.upstream)


_INSERTS = """passive AS (SELECT o.user_id, o.account_id, u0.row, u0.date, CASE WHEN is_fresh OR u0.date > newest - 7 THEN 'REGULAR' ELSE 'BACKFILLED' END AS fill_type
  FROM o JOIN u0 ON o.account_id = u0.account_id WHERE outcome = 'OK' AND (is_fresh OR (u0.account_id, u0.row) IN (SELECT account_id, row FROM ul WHERE reason = 'PEERLESS')))"""
_BOTH_STRATEGIES = f"{_STRATEGY}, {_INSERTS}, {_DEFAULT.replace(_WINDOW + ',', '', 1)}"


@query("u2_shadow_compare", f"""{_BOTH_STRATEGIES}
SELECT coalesce(d.account_id, p.account_id) AS account_id, coalesce(d.upstream_row, p.row) AS row, d.action AS active_action, CASE WHEN p.row IS NOT NULL THEN 'INSERT' END AS passive_action
FROM (SELECT * FROM done WHERE action = 'INSERT') d FULL JOIN passive p ON d.account_id = p.account_id AND d.upstream_row = p.row WHERE d.upstream_row IS NULL OR p.row IS NULL""")
def u2(fx):
    active = greedy.reconcile_default(fx.upstream, fx.stored).where("action = 'INSERT'").select("account_id", F.col("upstream_row").alias("row"), "action")
    passive = matching.reconcile_attributes(fx.upstream, fx.stored, TWO_STAGES).where("action = 'INSERT'").select("account_id", "row", "action")
    return greedy.shadow_compare(active, passive, ["account_id", "row"])


def _routed(fx: Fixtures) -> DataFrame:
    """Upstream rows with providers of all three strategies."""
    n = F.col("account_id") % 3
    return fx.upstream.withColumn("provider", F.when(n == 0, "TRIODOS_BANK_NL").when(n == 1, matching.DELTA_PROVIDER))


@query("u2_reconcile", f"""{_BOTH_STRATEGIES}
SELECT user_id, account_id, 'attributes' AS strategy, 'INSERT' AS action, CAST(NULL AS VARCHAR) AS stored_row, row AS upstream_row, CAST(date AS VARCHAR) AS date, fill_type FROM passive WHERE account_id % 3 = 0
UNION ALL SELECT o.user_id, o.account_id, 'attributes', 'DELETE', w.id, NULL, CAST(w.date AS VARCHAR), NULL FROM o JOIN w ON o.account_id = w.account_id WHERE outcome = 'OK' AND w.status = 'PENDING' AND o.account_id % 3 = 0
UNION ALL SELECT user_id, account_id, 'delta', 'INSERT', NULL, CAST(pos AS VARCHAR), CAST(date AS VARCHAR), 'REGULAR' FROM fx_upstream WHERE status = 'BOOKED' AND account_id % 3 = 1
UNION ALL SELECT user_id, account_id, 'default', action, stored_row, upstream_row, CAST(date AS VARCHAR), CASE WHEN action = 'INSERT' THEN 'REGULAR' END FROM done WHERE account_id % 3 = 2""")
def u2_reconcile(fx):
    return router.reconcile(_routed(fx), fx.stored)[0]


@query("u2_failures", _STRATEGY + " SELECT user_id, account_id, 'attributes' AS strategy, outcome FROM o WHERE outcome <> 'OK' AND account_id % 3 = 0")
def u2_failures(fx):
    return router.reconcile(_routed(fx), fx.stored)[1]


# --- accounts -------------------------------------------------------------------------------

_UPSTREAM_ACCOUNTS = """
SELECT user_id, user_site_id, id AS pos, CASE WHEN id % 3 = 0 THEN external_id || 'x' ELSE external_id END AS external_id, CASE WHEN id % 5 <> 0 THEN 'IBAN' END AS scheme,
  CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 2 = 0 THEN lower(iban) ELSE iban END END AS number, currency, CASE WHEN type = 'CREDIT_CARD' THEN 'XX-' || CAST(id AS STRING) END AS masked, type
FROM fx_accounts WHERE id % 6 <> 1"""
_STORED_ACCOUNTS = """
SELECT user_id, user_site_id, id, external_id, 'IBAN' AS scheme, iban AS number, currency, CASE WHEN type = 'CREDIT_CARD' THEN 'XX' || CAST(id AS STRING) END AS masked, type, created_at AS last_fetch FROM fx_accounts"""


@query("j6_match_accounts", f"""
WITH u AS ({_UPSTREAM_ACCOUNTS}), s AS ({_STORED_ACCOUNTS}),
n AS (SELECT u.user_id, u.user_site_id, u.pos, s.id, coalesce(s.last_fetch, TIMESTAMP '1970-01-01 00:00:00') AS f,
  CASE WHEN u.external_id = s.external_id THEN 1 WHEN u.scheme = s.scheme AND upper(u.number) = upper(s.number) AND u.currency = s.currency THEN 2
       WHEN u.type = 'CREDIT_CARD' AND s.type = 'CREDIT_CARD' AND regexp_replace(u.masked, '[^A-Za-z0-9]', '', 'g') = s.masked AND u.currency = s.currency THEN 3 END AS rule
  FROM u JOIN s ON u.user_id = s.user_id AND u.user_site_id = s.user_site_id),
best AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY rule, f DESC, id) AS k FROM n WHERE rule IS NOT NULL)
SELECT u.user_id, u.user_site_id, u.pos, b.id AS stored_id, CASE b.rule WHEN 1 THEN 'EXTERNAL_ID' WHEN 2 THEN 'ACCOUNT_NUMBER' WHEN 3 THEN 'MASKED_NUMBER' ELSE 'NONE' END AS match_type,
  coalesce(u.scheme = 'IBAN' AND NOT contains(u.number, ' ') AND regexp_replace(u.number, '[0-9]', '', 'g') <> '' AND regexp_replace(u.number, '[0-9]', '', 'g') = upper(regexp_replace(u.number, '[^A-Za-z]', '', 'g')), FALSE) AS is_normalized
FROM u LEFT JOIN best b ON u.pos = b.pos AND b.k = 1""")
def j6(fx):
    return acc.match_accounts(fx.sql(_UPSTREAM_ACCOUNTS), fx.sql(_STORED_ACCOUNTS), ["user_id", "user_site_id"])


_REPEATED_ACCOUNTS = f"""
SELECT user_id, user_site_id, pos * 2 + k AS pos, external_id, scheme, number, currency FROM ({_UPSTREAM_ACCOUNTS}) a CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) d WHERE k = 0 OR pos % 4 = 0"""


@query("e1_dedupe_accounts", f"SELECT user_id, user_site_id, min(pos) AS pos FROM ({_REPEATED_ACCOUNTS}) r GROUP BY user_id, user_site_id, external_id, scheme, number, currency")
def e1(fx):
    return acc.dedupe_accounts(fx.sql(_REPEATED_ACCOUNTS), ["user_id", "user_site_id"]).select("user_id", "user_site_id", "pos")


@query("j10_user_sites", "SELECT DISTINCT s.user_id, s.account_id, a.user_site_id FROM fx_stored s JOIN fx_accounts a ON a.user_id = s.user_id AND a.id = s.account_id WHERE s.status = 'PENDING'")
def j10(fx):
    return acc.user_sites_of(fx.accounts, fx.stored.where("status = 'PENDING'").select("user_id", "account_id").distinct())


@query("p10_accounts_of", "SELECT id, external_id FROM fx_accounts WHERE user_id = 7")
def p10(fx):
    return acc.accounts_of(fx.accounts, 7).select("id", "external_id")


@query("k6_account_events", "SELECT user_id, id AS account_id, CASE WHEN id % 3 = 0 THEN 'CREATED' ELSE 'UPDATED' END AS event FROM fx_accounts")
def k6(fx):
    return acc.account_events(fx.accounts.where("id % 3 <> 0"), fx.accounts)


# --- projections ----------------------------------------------------------------------------

def _upstream_ext(fx: Fixtures) -> DataFrame:
    """Upstream transactions with the nested part, made from orders."""
    key = F.col("order_no")
    ref = lambda kind: F.struct(F.when(key % 3 == 0, "IBAN").when(key % 3 == 1, "PAN").otherwise("BBAN").alias("type"), F.concat(F.lit(kind), key.cast("string")).alias("value"))
    rates = F.when(key % 4 == 0, F.array(F.struct(F.lit("USD").alias("currency_from"), F.when(key % 8 == 0, "1.25").otherwise("n/a").alias("rate"))))
    ext = F.struct(
        "booking_date", F.when(key % 2 == 0, F.concat(F.lit("C"), key.cast("string"))).alias("creditor_name"), F.concat(F.lit("D"), key.cast("string")).alias("debtor_name"), ref("c").alias("creditor_account"),
        F.when(key % 5 == 0, ref("d")).alias("debtor_account"), rates.alias("exchange_rates"), F.when(key % 6 == 0, F.struct(F.col("amount").alias("amount"), F.lit("USD").alias("currency"))).alias("original_amount"),
    )
    return fx.upstream.select("user_id", "account_id", key.alias("id"), "external_id", "status", "type", "amount", "description", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")).alias("date_time"), ext.alias("extended"))


@query("p1_to_stored_txn", """
SELECT account_id, CAST(order_no AS VARCHAR) AS id, CASE WHEN type = 'DEBIT' THEN -amount ELSE amount END AS amount, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS ts,
  '+02:00' AS time_zone, CASE WHEN order_no % 2 = 0 THEN 'C' || CAST(order_no AS VARCHAR) END AS creditor_name, CASE WHEN order_no % 3 = 0 THEN 'c' || CAST(order_no AS VARCHAR) END AS creditor_iban,
  CASE WHEN order_no % 3 = 1 THEN 'c' || CAST(order_no AS VARCHAR) END AS creditor_pan, CASE WHEN order_no % 5 = 0 AND order_no % 3 = 2 THEN 'd' || CAST(order_no AS VARCHAR) END AS debtor_bban,
  CASE WHEN order_no % 8 = 0 THEN 1.25::DOUBLE END AS rate, CASE WHEN order_no % 6 = 0 THEN amount END AS original_amount FROM fx_upstream""")
def p1(fx):
    out = projections.to_stored_txn(_upstream_ext(fx))
    utc = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("ts").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")
    return out.select("account_id", "id", "amount", "date", utc.alias("ts"), "time_zone", "creditor_name", "creditor_iban", "creditor_pan", "debtor_bban", F.col("rate").cast("double").alias("rate"), "original_amount")


@query("p7_transaction_view", """
SELECT account_id, CAST(order_no AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000+02:00' AS timestamp, CASE WHEN order_no % 2 = 0 THEN 'C' || CAST(order_no AS VARCHAR) END AS creditor_name, 'c' || CAST(order_no AS VARCHAR) AS creditor_number,
  CASE WHEN order_no % 5 = 0 THEN CASE order_no % 3 WHEN 0 THEN 'IBAN' WHEN 1 THEN 'PAN' ELSE 'BBAN' END END AS debtor_scheme, order_no % 4 <> 0 AS no_rate, CASE WHEN order_no % 6 = 0 THEN 'USD' END AS original_currency FROM fx_upstream""")
def p7(fx):
    v = projections.transaction_view(projections.to_stored_txn(_upstream_ext(fx)))
    return v.select("account_id", "id", "timestamp", F.col("creditor.name").alias("creditor_name"), F.col("creditor.number").alias("creditor_number"), F.col("debtor.scheme").alias("debtor_scheme"), F.col("exchange_rate").isNull().alias("no_rate"), F.col("original_amount.currency").alias("original_currency"))


@query("p3_to_stored_account", """
SELECT user_id, id, CASE WHEN id % 7 = 0 THEN 5.00 ELSE balance END AS balance, CASE WHEN id % 13 = 0 THEN 'DELETED' WHEN id % 19 = 0 THEN 'BLOCKED' ELSE 'ENABLED' END AS status,
  CASE WHEN id % 2 = 0 THEN iban WHEN id % 3 = 0 THEN 'R' || CAST(id AS VARCHAR) END AS iban, CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END AS n_balances, CASE WHEN id % 4 = 0 THEN 9.00 END AS available FROM fx_accounts""")
def p3(fx):
    key, money = F.col("id"), lambda x: F.lit(x).cast("decimal(18,2)")
    balance = lambda t, a: F.struct(F.lit(t).alias("type"), a.alias("amount"))
    up = fx.accounts.select(
        "user_id", "id", "external_id", "type", "currency", F.when(key % 7 != 0, F.col("balance")).alias("current_balance"), F.when(key % 7 == 0, money(5)).alias("available_balance"), (F.col("status") == "DELETED").alias("closed"),
        F.when(key % 19 == 0, "BLOCKED").alias("extended_status"), F.when(key % 2 == 0, "IBAN").alias("scheme"), F.when(key % 2 == 0, F.col("iban")).alias("number"),
        F.when(key % 3 == 0, F.array(F.struct(F.lit("IBAN").alias("type"), F.concat(F.lit("R"), key.cast("string")).alias("value")))).otherwise(F.array().cast("array<struct<type:string,value:string>>")).alias("references"),
        F.array(balance("BOOKED", money(1)), balance("AVAILABLE", F.when(key % 4 == 0, money(9)))).alias("balances"),
    )
    out = projections.to_stored_account(up)
    return out.select("user_id", "id", "balance", "status", "iban", F.size("balances").alias("n_balances"), "available")


@query("p4_to_analytics_txn", "SELECT account_id, id AS transaction_id, CASE status WHEN 'BOOKED' THEN 1 WHEN 'PENDING' THEN 2 END AS pending, abs(amount) AS amount, CASE WHEN amount >= 0 THEN 'credit' ELSE 'debit' END AS transaction_type FROM fx_stored")
def p4(fx):
    return projections.to_analytics_txn(fx.stored).select("account_id", "transaction_id", "pending", "amount", "transaction_type")


@query("p5_to_analytics_account", "SELECT user_id, id AS account_id, user_site_id, currency AS currency_code, balance AS current_balance, status = 'DELETED' AS closed FROM fx_accounts")
def p5(fx):
    return projections.to_analytics_account(fx.accounts).select("user_id", "account_id", "user_site_id", "currency_code", "current_balance", "closed")


@query("p6_to_analytics_credit_card", "SELECT user_id, id AS account_id, balance AS running_balance, credit_limit AS total_credit_line FROM fx_accounts WHERE credit_limit IS NOT NULL")
def p6(fx):
    return projections.to_analytics_credit_card(fx.accounts).select("user_id", "account_id", "running_balance", "total_credit_line")


@query("p8_account_view", """
SELECT id, iban, CAST(NULL AS VARCHAR) AS sort_code, CASE WHEN type = 'CREDIT_CARD' THEN credit_limit END AS credit_limit, CASE WHEN type = 'SAVINGS_ACCOUNT' THEN iban END AS savings_iban,
  CAST(CAST(coalesce(created_at, TIMESTAMP '1970-01-01 00:00:00') AS TIMESTAMP) AS VARCHAR) AS created_at FROM fx_accounts""")
def p8(fx):
    v = projections.account_view(fx.accounts)
    return v.select("id", F.col("account_references.iban").alias("iban"), F.col("account_references.sort_code").alias("sort_code"), F.col("credit_card.credit_limit").alias("credit_limit"), F.col("savings.iban").alias("savings_iban"), "created_at")


@query("p11_legacy_transaction_view", """
SELECT s.account_id, s.id, coalesce(e.category, 'General') AS category, coalesce(e.counterparty_name, s.description) AS short_description, CASE WHEN e.known_merchant THEN e.counterparty_name END AS merchant,
  CASE WHEN s.status = 'PENDING' THEN 'PENDING' ELSE 'REGULAR' END AS transaction_type FROM fx_stored s LEFT JOIN fx_enrichments e USING (user_id, account_id, date, id)""")
def p11(fx):
    return projections.legacy_transaction_view(reads.enrich(fx.stored, fx.enrichments)).select("account_id", "id", "category", "short_description", "merchant", "transaction_type")


@query("p12_legacy_account_view", "SELECT id, CASE WHEN status = 'DELETED' THEN 'DELETED' ELSE 'PROCESSED' END AS status, status = 'DELETED' AS closed, 1 AS n_references, iban AS first_reference FROM fx_accounts")
def p12(fx):
    return projections.legacy_account_view(fx.accounts).select("id", "status", "closed", F.size("references").alias("n_references"), F.get("references", F.lit(0))["value"].alias("first_reference"))


@query("p13_merchant_name", """
SELECT account_id, id, CASE WHEN counterparty_name IS NULL OR known_merchant IS NULL THEN category WHEN known_merchant THEN counterparty_name END AS merchant FROM fx_enrichments""")
def p13(fx):
    return fx.enrichments.withColumn("merchant_name", F.col("category")).select("account_id", "id", projections.merchant_name().alias("merchant"))


@query("p14_cycle_view", "SELECT user_id, cycle_id, amount, CAST(cycle_id AS BIGINT) % 4 = 0 AND CAST(cycle_id AS BIGINT) % 3 = 0 AS detected FROM fx_cycles")
def p14(fx):
    n = F.col("cycle_id").cast("long")
    c = fx.cycles.withColumns({"cycle_type": F.lit("CREDITS"), "model_amount": F.when(n % 4 == 0, F.col("amount")), "model_currency": F.lit("EUR"), "model_period": F.when(n % 3 == 0, "P1M")})
    return projections.cycle_view(c).select("user_id", "cycle_id", "amount", F.col("detected").isNotNull().alias("detected"))


@query("p15_cycles_from_messages", "SELECT user_id, cycle_id, CASE WHEN amount >= 0 THEN 'CREDITS' ELSE 'DEBITS' END AS cycle_type, amount, expired FROM fx_cycles")
def p15(fx):
    one = F.struct(F.col("cycle_id").alias("id"), "amount", "currency", "period")
    msg = fx.cycles.groupBy("user_id").agg(F.collect_list(F.when(F.col("amount") >= 0, one)).alias("credits"), F.collect_list(F.when(F.col("amount") < 0, one)).alias("debits"))
    return projections.cycles_from_messages(msg).select("user_id", "cycle_id", "cycle_type", "amount", "expired")


@query("p16_selectors", """
SELECT account_id, row, external_id IS NOT NULL AND trim(external_id) <> '' AS usable_id, lower(trim(description)) <> 'not provided' AS usable_text, CASE WHEN ts >= TIMESTAMP '2000-01-01 00:00:00' THEN description END AS late_text
FROM (SELECT account_id, CAST(pos AS VARCHAR) AS row, external_id, ts, CASE WHEN pos % 3 = 0 THEN ' Not provided' ELSE description END AS description FROM fx_upstream) x""")
def p16(fx):
    rows = fx.upstream.withColumn("description", F.when(F.col("pos") % 3 == 0, " Not provided").otherwise(F.col("description")))
    late = rules.use_after_or_null("description", "2000-01-01 00:00:00")
    return rows.select("account_id", F.col("pos").cast("string").alias("row"), rules.not_blank("external_id").usable().alias("usable_id"), rules.not_placeholder("description").usable().alias("usable_text"), late.value().alias("late_text"))


# --- reads ----------------------------------------------------------------------------------

@query("p9_transactions_between", "SELECT account_id, id, amount FROM fx_stored WHERE date BETWEEN DATE '2001-07-02' AND DATE '2001-08-02'")
def p9(fx):
    return reads.transactions_between(fx.stored, reads.Interval.of("P1M/2001-08-02")).select("account_id", "id", "amount")


@query("o1_page", """SELECT account_id, CAST(date AS VARCHAR) AS date, id FROM fx_stored WHERE account_id > 3 OR (account_id = 3 AND date < DATE '2000-01-01') ORDER BY fx_stored.account_id, fx_stored.date DESC, fx_stored.id LIMIT 100""")
def o1(fx):
    return reads.page(fx.stored, after=(3, F.lit("2000-01-01").cast("date"), "~")).select("account_id", "date", "id")


@query("o1_page_cursors", """
SELECT user_id, page, count(*) AS rows, arg_max(account_id, n) AS account_id, CAST(arg_max(date, n) AS VARCHAR) AS date, arg_max(id, n) AS id
FROM (SELECT *, row_number() OVER w AS n, CAST((row_number() OVER w - 1) // 100 AS BIGINT) AS page FROM fx_stored WINDOW w AS (PARTITION BY user_id ORDER BY account_id, date DESC, id)) x GROUP BY user_id, page""")
def o1_cursors(fx):
    return reads.page_cursors(fx.stored, ["user_id"])


@query("o2_latest_refreshed", "SELECT user_id, arg_max(id, coalesce(created_at, TIMESTAMP '1970-01-01 00:00:00') + to_seconds(-id)) AS id FROM fx_accounts GROUP BY user_id")
def o2(fx):
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return fx.accounts.groupBy("user_id").agg(F.max_by("id", F.struct(F.coalesce("created_at", epoch), -F.col("id"))).alias("id"))


@query("j8_enrich", "SELECT s.account_id, s.id, e.category, e.counterparty_name FROM fx_stored s LEFT JOIN fx_enrichments e ON s.user_id = e.user_id AND s.account_id = e.account_id AND s.date = e.date AND s.id = e.id")
def j8(fx):
    return reads.enrich(fx.stored, fx.enrichments).select("account_id", "id", "category", "counterparty_name")


@query("j9_merchant_suggest", """
WITH q AS (SELECT DISTINCT country, substr(search_term, 1, 3) AS prefix FROM fx_merchants),
h AS (SELECT q.country || ':' || prefix AS query_id, merchant_name, min(search_term) AS term FROM q JOIN fx_merchants m ON m.country = q.country AND starts_with(m.search_term, prefix) GROUP BY ALL),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term, merchant_name) AS n FROM h)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY merchant_name) AS INTEGER) AS rank, merchant_name FROM f WHERE n <= 10""")
def j9(fx):
    asked = fx.merchants.select("country", F.upper(F.substring("search_term", 1, 3)).alias("text")).distinct().withColumn("query_id", F.concat_ws(":", "country", F.lower("text")))
    return reads.merchant_suggest(asked, fx.merchants.withColumn("direct", F.lit(True)))


@query("j7_group_similar", """
SELECT user_id, description AS name, CAST(sum(count(*)) OVER (PARTITION BY user_id, description) AS BIGINT) AS n, account_id, CAST(count(*) AS BIGINT) AS n_ids, min(id) AS first_id
FROM fx_stored GROUP BY user_id, description, account_id""")
def j7(fx):
    return _similar(fx.stored)


query("j7_group_similar_all", _ORACLES["j7_group_similar"])(j7)


def _similar(stored: DataFrame) -> DataFrame:
    groups = stored.groupBy("user_id", F.col("description").alias("name")).agg(F.collect_list(F.struct("account_id", "id")).alias("keys")).withColumn("group_no", F.lit(0))
    out = reads.group_similar(groups)
    return out.select("user_id", "name", F.col("n").cast("long").alias("n"), "account_id", F.size("ids").cast("long").alias("n_ids"), F.get("ids", F.lit(0)).alias("first_id"))


# --- reports --------------------------------------------------------------------------------

@query("a1_retrieval_lower_bound", f"""
WITH r AS (SELECT * FROM fx_stored WHERE date >= DATE '{TODAY}' - INTERVAL 90 DAY AND ts IS NOT NULL),
p AS (SELECT account_id, min(ts) AS p FROM r WHERE status = 'PENDING' GROUP BY account_id),
a AS (SELECT x.user_id, x.user_site_id, x.site_id, p.p, (SELECT max(ts) FROM r WHERE r.account_id = x.id AND status = 'BOOKED') AS b, (SELECT max(ts) FROM r WHERE r.account_id = x.id AND status = 'BOOKED' AND ts <= p.p) AS q
  FROM fx_accounts x LEFT JOIN p ON p.account_id = x.id),
g AS (SELECT user_id, user_site_id, min(site_id) AS site_id, min(p) AS p, max(b) AS b, CASE WHEN NOT bool_or(p IS NOT NULL AND q IS NULL) THEN min(q) END AS q FROM a GROUP BY ALL)
SELECT user_id, user_site_id, CAST(CAST(CASE WHEN q IS NOT NULL AND site_id = 2 AND q < TIMESTAMP '{NOW}' - INTERVAL 1 MONTH THEN TIMESTAMP '{NOW}' - INTERVAL 1 MONTH
  WHEN q IS NOT NULL THEN q - INTERVAL 1 DAY WHEN p IS NULL THEN b - INTERVAL 1 DAY END AS TIMESTAMP) AS VARCHAR) AS lower_bound FROM g""")
def a1(fx):
    return reports.retrieval_lower_bound(fx.accounts, fx.stored, NOW, special_site=2)


@query("a2_account_groups", """
SELECT user_id, CAST(list_position(['CURRENT_ACCOUNT','CREDIT_CARD','SAVINGS_ACCOUNT','PREPAID_ACCOUNT','PENSION','INVESTMENT','FOREIGN_CURRENCY','UNKNOWN'], account_group) AS INTEGER) AS group_no, account_group, currency, total
FROM (SELECT user_id, CASE WHEN currency <> 'EUR' THEN 'FOREIGN_CURRENCY' ELSE type END AS account_group, currency, sum(balance) AS total, count(*) - count(balance) AS unknown FROM fx_accounts WHERE status <> 'DELETED' AND NOT hidden GROUP BY 1, 2, 3) x
WHERE unknown = 0""")
def a2(fx):
    return reports.account_groups(fx.accounts)


def _instructions(fx: Fixtures) -> DataFrame:
    """Stored rows as instructions, by their id."""
    n = F.col("id").cast("long")
    action = F.when(n % 10 == 0, "DELETE").when(n % 10 < 3, "UPDATE").when(n % 10 < 5, "IGNORE").otherwise("INSERT")
    return fx.stored.withColumns({"action": action, "counterparty_number": F.when(n % 3 == 0, "N").when(n % 3 == 1, " "), "counterparty_name": F.when(n % 4 < 3, "C")})


_INSTRUCTIONS = """
ins AS (SELECT *, CASE WHEN n % 10 = 0 THEN 'DELETE' WHEN n % 10 < 3 THEN 'UPDATE' WHEN n % 10 < 5 THEN 'IGNORE' ELSE 'INSERT' END AS action FROM (SELECT *, CAST(id AS BIGINT) AS n FROM fx_stored) y)"""


@query("a4_balance_accuracy", f"""
WITH {_INSTRUCTIONS}, c AS (SELECT account_id, count(*) FILTER (action = 'DELETE') AS d, coalesce(sum(amount) FILTER (action = 'INSERT'), 0) AS i FROM ins GROUP BY account_id)
SELECT user_id, id AS account_id, k.kind || '_accuracy' AS kind, CASE WHEN k.kind = 'available' OR balance IS NULL THEN 'NOT_PRESENT' WHEN coalesce(d, 0) > 0 THEN 'CANT_RECONCILE' WHEN CASE WHEN id % 2 = 0 THEN balance ELSE 0 END + coalesce(i, 0) = balance THEN 'ACCURATE' ELSE 'INACCURATE' END AS verdict
FROM fx_accounts LEFT JOIN c ON account_id = id CROSS JOIN (VALUES ('current'), ('available')) k(kind)""")
def a4(fx):
    before = F.when(F.col("id") % 2 == 0, F.col("balance"))
    accounts = fx.accounts.select("user_id", F.col("id").alias("account_id"), F.col("balance").alias("current_balance"), before.alias("previous_current_balance"), F.lit(None).cast("decimal(18,2)").alias("available_balance"), F.lit(None).cast("decimal(18,2)").alias("previous_available_balance"))
    return reports.balance_accuracy(accounts, _instructions(fx))


@query("a5_start_balance_check", f"""
WITH i AS (SELECT account_id, abs(amount) AS a, ts, status FROM fx_stored),
s AS (SELECT account_id, coalesce(sum(a) FILTER (ts <= TIMESTAMP '{NOW}' AND status = 'BOOKED'), 0) AS booked_now, coalesce(sum(a) FILTER (ts <= TIMESTAMP '{NOW}'), 0) AS all_now,
  coalesce(sum(a) FILTER (ts <= TIMESTAMP '{TODAY} 00:00:00' AND status = 'BOOKED'), 0) AS booked_midnight, coalesce(sum(a) FILTER (ts <= TIMESTAMP '{TODAY} 00:00:00'), 0) AS all_midnight FROM i GROUP BY account_id),
l AS (UNPIVOT s ON booked_now, all_now, booked_midnight, all_midnight INTO NAME selection VALUE total)
SELECT account_id, selection, 'CURRENT' AS balance_type, total = (SELECT sum(a) FROM i WHERE i.account_id = l.account_id AND status = 'BOOKED') AS equal FROM l WHERE account_id IN (SELECT account_id FROM i WHERE status = 'BOOKED')""")
def a5(fx):
    return _start_balances(fx.stored)


query("a5_start_balance_check_all", _ORACLES["a5_start_balance_check"])(a5)


def _start_balances(stored: DataFrame) -> DataFrame:
    ins = stored.withColumns({"amount": F.abs("amount"), "action": F.lit("INSERT")})
    booked = ins.where("status = 'BOOKED'").groupBy("user_id", "account_id").agg(F.sum("amount").cast("decimal(18,2)").alias("b"))
    accounts = booked.select("user_id", "account_id", F.lit(True).alias("is_new"), F.array(F.struct(F.lit("CURRENT").alias("type"), F.col("b").alias("amount"))).alias("balances"))
    # The tables reach back further than a new account's first refresh: no row is too old here.
    return reports.start_balance_check(accounts, ins, NOW, months=600).select("account_id", "selection", "balance_type", "equal")


@query("a6_old_pending", f"""
WITH o AS (SELECT CAST(s.date AS VARCHAR) AS d, CAST(coalesce(a.site_id, 0) AS VARCHAR) AS site FROM fx_stored s LEFT JOIN fx_accounts a ON a.user_id = s.user_id AND a.id = s.account_id AND a.id % 5 <> 0 WHERE s.status = 'PENDING' AND s.date < DATE '{TODAY}' - INTERVAL 40 DAY)
SELECT 'date' AS kind, d AS key, count(*) AS n FROM o GROUP BY d UNION ALL SELECT 'site', site, count(*) FROM o GROUP BY site UNION ALL SELECT 'total', '', count(*) FROM o""")
def a6(fx):
    return reports.old_pending(fx.stored, fx.accounts.where("id % 5 <> 0"), TODAY)


@query("a7_ingestion_report", f"""
WITH {_INSTRUCTIONS}, g AS (SELECT user_id, account_id, count(*) AS total, CAST(min(date) AS VARCHAR) AS oldest, CAST(max(date) AS VARCHAR) AS newest, count(*) FILTER (action = 'INSERT') AS new, count(*) FILTER (action = 'DELETE') AS deleted,
  count(*) FILTER (action = 'UPDATE') AS updated, count(*) FILTER (action = 'IGNORE') AS unchanged, count(*) FILTER (action = 'INSERT' AND n % 3 = 0) AS with_number, count(*) FILTER (action = 'INSERT' AND n % 4 < 3) AS with_name,
  count(*) FILTER (date < DATE '{TODAY}' - INTERVAL 40 DAY) AS older FROM ins GROUP BY ALL)
SELECT *, CASE WHEN new > 0 THEN CAST(CAST(floor(least(with_number, with_name) * 100.0 / new + 0.5) / 100 AS DECIMAL(5,2)) AS VARCHAR) ELSE 'n/a' END AS quality FROM g""")
def a7(fx):
    return reports.ingestion_report(_instructions(fx), TODAY)


@query("a8_month_range", """
SELECT user_id, strftime(min(date), '%Y-%m') AS first_month, strftime(max(date), '%Y-%m') AS last_month FROM (SELECT user_id, date FROM fx_upstream UNION ALL SELECT user_id, date FROM fx_stored WHERE status = 'PENDING') x GROUP BY user_id""")
def a8(fx):
    return reports.month_range(fx.upstream, fx.stored, ["user_id"])


@query("a9_last_external_id", "SELECT user_id, account_id, external_id AS last_external_id FROM (SELECT *, max(pos) OVER (PARTITION BY account_id) AS m FROM fx_upstream) x WHERE pos = m")
def a9(fx):
    return reports.last_external_id(fx.upstream)


@query("a10_oldest_change", f"WITH {_INSTRUCTIONS} SELECT user_id, account_id, CAST(min(date) AS VARCHAR) AS oldest_change FROM ins WHERE action <> 'IGNORE' GROUP BY ALL")
def a10(fx):
    return reports.oldest_change(_instructions(fx))


@query("a11_quality_counters", f"""
WITH q AS (SELECT account_id % 5 AS provider, count(*) FILTER (date > DATE '2000-12-31' AND status = 'BOOKED') AS future_booked, count(*) FILTER (date > DATE '2000-12-31' AND status = 'PENDING') AS future_pending, count(*) FILTER (n % 2 = 0) AS remittance_both,
  0::BIGINT AS remittance_none, count(*) FILTER (amount >= 0 AND n % 3 = 0) AS debtor_on_credit, count(*) FILTER (amount < 0 AND n % 5 = 0) AS creditor_on_debit FROM (SELECT *, CAST(id AS BIGINT) AS n FROM fx_stored) s GROUP BY 1)
UNPIVOT q ON future_booked, future_pending, remittance_both, remittance_none, debtor_on_credit, creditor_on_debit INTO NAME counter VALUE n""")
def a11(fx):
    n = F.col("id").cast("long")
    rows = fx.stored.withColumns({"provider": F.col("account_id") % 5, "structured": F.when(n % 2 == 0, "S"), "debtor_name": F.when(n % 3 == 0, "D"), "creditor_name": F.when(n % 5 == 0, "C")})
    return reports.quality_counters(rows, ["provider"], "2000-12-31")


@query("a11_balance_presence", "SELECT site_id, CASE WHEN id % 4 = 0 THEN 'NONE' ELSE 'CURRENT' END AS balance_type, count(*) AS n FROM fx_accounts GROUP BY ALL UNION ALL SELECT site_id, 'AVAILABLE', count(*) FROM fx_accounts WHERE id % 4 = 1 GROUP BY ALL")
def a11_presence(fx):
    kind = lambda t: F.struct(F.lit(t).alias("type"))
    key = F.col("id")
    balances = F.when(key % 4 == 0, F.array().cast("array<struct<type:string>>")).when(key % 4 == 1, F.array(kind("CURRENT"), kind("AVAILABLE"))).otherwise(F.array(kind("CURRENT")))
    return reports.balance_presence(fx.accounts.withColumn("balances", balances), ["site_id"])


@query("a12_pending_age", f"""
SELECT a.site_id, a.type, CAST(greatest(1, least(90, CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(p.t)) / 86400) AS BIGINT))) AS INTEGER) AS days, count(*) AS n
FROM (SELECT user_id, account_id, min(ts) AS t FROM fx_stored WHERE status = 'PENDING' GROUP BY ALL) p JOIN fx_accounts a ON a.user_id = p.user_id AND a.id = p.account_id GROUP BY ALL""")
def a12(fx):
    return reports.pending_age_distribution(fx.stored, fx.accounts, NOW)


@query("a13_json_absence", """
WITH k AS (SELECT event_type, key, json_extract(props, '$.' || key) AS v FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) e)
SELECT event_type, 'root.' || key AS path, count(*) AS nulls, 1.0::DOUBLE AS share FROM k WHERE FALSE GROUP BY ALL
UNION ALL SELECT event_type, 'root.extra', count(*) FILTER (event_id % 3 = 0), count(*) FILTER (event_id % 3 = 0) / count(*)::DOUBLE FROM events GROUP BY event_type
UNION ALL SELECT event_type, 'root.list.[]', count(*), 1.0::DOUBLE FROM events GROUP BY event_type""")
def a13(fx):
    extra = F.concat(F.lit('{"extra": '), F.when(F.col("event_id") % 3 == 0, "null").otherwise("1"), F.lit(', "list": [null, {"b": 2}], "p": '), F.coalesce("props", F.lit("{}")), F.lit("}"))
    return reports.json_absence(fx.table("events").select("event_type", "event_id", extra.alias("value")), ["event_type"])


@query("a14_sync_compare", """
WITH a AS (SELECT user_id, account_id, count(*) FILTER (status = 'PENDING') AS p, count(*) FILTER (status = 'BOOKED') AS b FROM fx_stored GROUP BY ALL), z AS (SELECT user_id, account_id, count(*) FILTER (pending = 2) AS p, count(*) FILTER (pending = 1) AS b FROM fx_analytics GROUP BY ALL)
SELECT z.user_id, z.account_id, z.p AS b_pending, z.b AS b_booked, coalesce(a.p, 0) AS a_pending, coalesce(a.b, 0) AS a_booked, coalesce(a.p, 0) - z.p AS pending_delta, coalesce(a.b, 0) - z.b AS booked_delta, coalesce(a.p, 0) = z.p AND coalesce(a.b, 0) = z.b AS perfect
FROM z LEFT JOIN a ON a.user_id = z.user_id AND a.account_id = z.account_id""")
def a14(fx):
    return reports.sync_compare(fx.stored, fx.analytics)


# --- merges and deletes ---------------------------------------------------------------------

@query("e2_cycle_changeset", """
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.cycle_id, n.cycle_id) AS cycle_id, CASE WHEN o.cycle_id IS NULL THEN 'ADDED' WHEN n.cycle_id IS NULL THEN 'DELETED' ELSE 'UPDATED' END AS change, coalesce(n.amount, o.amount) AS amount
FROM (SELECT * FROM fx_cycles WHERE user_id IN (SELECT user_id FROM fx_cycles_new)) o FULL JOIN fx_cycles_new n ON o.user_id = n.user_id AND o.cycle_id = n.cycle_id""")
def e2(fx):
    return merges.cycle_changeset(fx.cycles, fx.cycles_new).select("user_id", "cycle_id", "change", "amount")


@query("e3_apply_cycles", """
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(o.cycle_id, n.cycle_id) AS cycle_id, coalesce(n.amount, o.amount) AS amount, n.cycle_id IS NULL AND o.user_id IN (SELECT user_id FROM fx_cycles_new) AS expired
FROM fx_cycles o FULL JOIN fx_cycles_new n ON o.user_id = n.user_id AND o.cycle_id = n.cycle_id""")
def e3(fx):
    return merges.apply_cycles(fx.cycles, merges.cycle_changeset(fx.cycles, fx.cycles_new)).select("user_id", "cycle_id", "amount", "expired")


@query("e4_delete_cascade", """
WITH g AS (SELECT user_id, id FROM fx_accounts WHERE user_site_id % 5 = 0 AND user_id % 2 = 0), e AS (SELECT * FROM fx_enrichments WHERE (user_id, account_id) IN (SELECT user_id, id FROM g))
SELECT 'accounts' AS section, count(*) AS n FROM g UNION ALL SELECT 'transactions', count(*) FROM fx_stored WHERE (user_id, account_id) IN (SELECT user_id, id FROM g) UNION ALL SELECT 'enrichments', count(*) FROM e
UNION ALL SELECT 'cycles', count(*) FROM fx_cycles WHERE (user_id, cycle_id) IN (SELECT user_id, cycle_id FROM e WHERE cycle_id IS NOT NULL)""")
def e4(fx):
    targets = fx.accounts.where("user_site_id % 5 = 0 AND user_id % 2 = 0").select("user_id", "user_site_id").distinct()
    gone = merges.delete_cascade(targets, fx.accounts, fx.stored, fx.enrichments, fx.cycles)
    out = None
    for section, df in gone.items():
        one = df.agg(F.lit(section).alias("section"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("e4_delete_cascade_rows", """
WITH g AS (SELECT user_id, id FROM fx_accounts WHERE user_site_id % 5 = 0 AND user_id % 2 = 0), e AS (SELECT * FROM fx_enrichments WHERE (user_id, account_id) IN (SELECT user_id, id FROM g))
SELECT 'accounts' AS section, user_id, CAST(id AS VARCHAR) AS key FROM g UNION ALL SELECT 'transactions', user_id, id FROM fx_stored WHERE (user_id, account_id) IN (SELECT user_id, id FROM g)
UNION ALL SELECT 'enrichments', user_id, id FROM e UNION ALL SELECT 'cycles', user_id, cycle_id FROM fx_cycles WHERE (user_id, cycle_id) IN (SELECT user_id, cycle_id FROM e WHERE cycle_id IS NOT NULL)""")
def e4_rows(fx):
    targets = fx.accounts.where("user_site_id % 5 = 0 AND user_id % 2 = 0").select("user_id", "user_site_id").distinct()
    gone = merges.delete_cascade(targets, fx.accounts, fx.stored, fx.enrichments, fx.cycles)
    parts = [df.select(F.lit(section).alias("section"), "user_id", F.col("cycle_id" if section == "cycles" else "id").cast("string").alias("key")) for section, df in gone.items()]
    return reduce(DataFrame.unionByName, parts)


@query("e4_delete_envelopes", """
WITH g AS (SELECT user_id, id FROM fx_accounts WHERE user_site_id % 5 = 0 AND user_id % 2 = 0)
SELECT CAST(user_id AS VARCHAR) AS key, CAST(id AS VARCHAR) AS entity_id, 'true' AS gone FROM g
UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(user_id AS VARCHAR) || ':' || CAST(account_id AS VARCHAR) || ':' || CAST(date AS VARCHAR) || ':' || id, 'true' FROM fx_stored WHERE (user_id, account_id) IN (SELECT user_id, id FROM g)""")
def e4_envelopes(fx):
    targets = fx.accounts.where("user_site_id % 5 = 0 AND user_id % 2 = 0").select("user_id", "user_site_id").distinct()
    out = sinks.delete_envelopes(merges.delete_cascade(targets, fx.accounts, fx.stored, fx.enrichments, fx.cycles))
    return out.select("key", F.get_json_object("value", "$.entity_id").alias("entity_id"), F.get_json_object("value", "$.delete").alias("gone"))


@query("e5_retention_delete", f"""
WITH k AS (SELECT s.*, c.client_id, coalesce(c.client_id = 1 AND date < DATE '{TODAY}' - INTERVAL 365 DAY, FALSE) AS gone FROM fx_stored s LEFT JOIN fx_user_client c USING (user_id))
SELECT count(*) AS seen, count(*) FILTER (gone) AS can_delete, count(*) FILTER (gone) AS did_delete, count(DISTINCT user_id) FILTER (gone) AS users, count(DISTINCT (user_id, account_id)) FILTER (gone) AS accounts, count(DISTINCT user_id) FILTER (client_id IS NULL) AS users_without_client FROM k""")
def e5(fx):
    return merges.retention_delete(fx.stored, fx.user_client, 1, TODAY)[1]


@query("e5_retained", f"SELECT account_id, id FROM fx_stored s WHERE NOT (date < DATE '{TODAY}' - INTERVAL 365 DAY AND user_id IN (SELECT user_id FROM fx_user_client WHERE client_id = 1))")
def e5_retained(fx):
    return merges.retention_delete(fx.stored, fx.user_client, 1, TODAY)[0].select("account_id", "id")


@query("e6_sync_delete_pending", """
WITH p AS (SELECT user_id, account_id, id FROM fx_stored WHERE status = 'PENDING'), x AS (SELECT * FROM p WHERE (user_id, account_id, id) NOT IN (SELECT user_id, account_id, transaction_id FROM fx_analytics)),
g AS (SELECT account_id, (SELECT count(*) FROM x WHERE x.account_id = p.account_id) AS e, count(*) AS a, (SELECT count(*) FROM fx_analytics z WHERE z.account_id = p.account_id AND pending = 2) AS b FROM p GROUP BY account_id)
SELECT account_id, id FROM x WHERE account_id IN (SELECT account_id FROM g WHERE a > b AND e = a - b)""")
def e6(fx):
    b = fx.analytics.withColumnRenamed("transaction_id", "id")
    return merges.sync_delete_pending(fx.stored, b).select("account_id", "id")


@query("e7_set_hidden", """
SELECT id, CASE WHEN id % 7 = 0 AND user_id % 10 <> 0 THEN TRUE ELSE hidden END AS hidden FROM fx_accounts""")
def e7(fx):
    updates = fx.accounts.where("id % 7 = 0").select("user_id", F.col("id").alias("account_id"), F.lit(True).alias("hidden"))
    unknown = fx.accounts.where("user_id % 10 = 0").select("user_id").distinct().select("user_id", F.lit(-1).cast("long").alias("account_id"), F.lit(True).alias("hidden"))
    return merges.set_hidden(fx.accounts, updates.unionByName(unknown))[0].select("id", "hidden")


@query("e8_move_user_site", "SELECT id, CASE WHEN id % 3 = 0 THEN user_site_id + 100 ELSE user_site_id END AS user_site_id FROM fx_accounts")
def e8(fx):
    moves = fx.accounts.where("id % 3 = 0").select("user_id", "id", (F.col("user_site_id") + 100).alias("new_user_site_id"))
    return merges.move_user_site(fx.accounts, moves).select("id", "user_site_id")


def _enrichment_messages(fx: Fixtures) -> DataFrame:
    """Two categories messages and a counterparties message on the stored rows, by their id."""
    base = fx.stored.where("CAST(id AS BIGINT) % 6 < 3").select("user_id", "account_id", "date", "id", F.col("id").cast("long").alias("n"))
    text = lambda p: F.concat(F.lit(p), (F.col("n") % 7).cast("string"))
    rows = lambda domain, at, **f: base.select("user_id", "account_id", "date", "id", F.lit(domain).alias("domain"), F.lit(at).alias("time"), F.lit(0).alias("message_index"), *(
        f.get(c, F.lit(None).cast(t)).alias(c) for c, t in (("category", "string"), ("labels", "array<string>"), ("counterparty_name", "string"), ("known_merchant", "boolean"), ("cycle_id", "string"))))
    return (
        rows("CATEGORIES", 1, category=text("old")).unionByName(rows("CATEGORIES", 2, category=F.when(F.col("n") % 2 == 0, text("new"))))
        .unionByName(rows("COUNTER_PARTIES", 3, counterparty_name=F.when(F.col("n") % 3 == 0, text("cp")), known_merchant=F.lit(True)))
    )


@query("e9_merge_enrichments", """
WITH m AS (SELECT user_id, account_id, date, id, CAST(id AS BIGINT) AS n FROM fx_stored WHERE CAST(id AS BIGINT) % 6 < 3)
SELECT coalesce(e.account_id, m.account_id) AS account_id, coalesce(e.id, m.id) AS id, coalesce(CASE WHEN n % 2 = 0 THEN 'new' || CAST(n % 7 AS VARCHAR) ELSE 'old' || CAST(n % 7 AS VARCHAR) END, category) AS category,
  coalesce(CASE WHEN n % 3 = 0 THEN 'cp' || CAST(n % 7 AS VARCHAR) END, counterparty_name) AS counterparty_name, coalesce(CASE WHEN n % 3 = 0 THEN TRUE END, known_merchant) AS known_merchant, cycle_id
FROM fx_enrichments e FULL JOIN m ON e.user_id = m.user_id AND e.account_id = m.account_id AND e.date = m.date AND e.id = m.id""")
def e9(fx):
    return merges.merge_enrichments(fx.enrichments, _enrichment_messages(fx)).select("account_id", "id", "category", "counterparty_name", "known_merchant", "cycle_id")


@query("e10_delete_enrichments", "SELECT account_id, id FROM fx_enrichments WHERE NOT (account_id % 7 = 0)")
def e10(fx):
    return merges.delete_enrichments(fx.enrichments, fx.accounts.where("id % 7 = 0").select("user_id", F.col("id").alias("account_id"))).select("account_id", "id")


@query("k1_apply_instructions", f"""
WITH {_INSTRUCTIONS} SELECT account_id, id, amount FROM fx_stored WHERE (account_id, id) NOT IN (SELECT account_id, id FROM ins)
UNION ALL SELECT account_id, CASE WHEN action = 'INSERT' THEN 'I' || id ELSE id END, amount + 1 FROM ins WHERE action IN ('INSERT', 'UPDATE')
UNION ALL SELECT account_id, id, amount FROM ins WHERE action IN ('IGNORE', 'INSERT')""")
def k1(fx):
    ins = _instructions(fx).withColumns({"id": F.when(F.col("action") == "INSERT", F.concat(F.lit("I"), F.col("id"))).otherwise(F.col("id")), "amount": (F.col("amount") + 1).cast("decimal(18,2)")})
    return merges.apply_instructions(fx.stored, ins).select("account_id", "id", "amount")


@query("k2_sparse_upsert", """
SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN 1.00 ELSE balance END AS balance, CASE WHEN id % 2 = 0 THEN NULL ELSE iban END AS iban FROM fx_accounts""")
def k2(fx):
    patch = fx.accounts.where("id % 2 = 0").select("user_id", "id", F.when(F.col("id") % 3 == 0, F.lit(1).cast("decimal(18,2)")).alias("balance"), F.lit(None).cast("string").alias("iban"))
    return merges.sparse_upsert(fx.accounts, patch, ["user_id", "id"], always_overwrite=("iban",)).select("id", "balance", "iban")


@query("k3_offload_envelopes", """
SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) || ':' || CAST(account_id AS VARCHAR) || ':' || CAST(date AS VARCHAR) || ':' || id AS entity_id, status = 'PENDING' AS gone, CASE WHEN status <> 'PENDING' THEN id END AS payload_id FROM fx_stored""")
def k3(fx):
    v = sinks.offload_envelopes(fx.stored, "transaction", F.col("status") == "PENDING")
    part = lambda p: F.get_json_object("value", p)
    return v.select("key", part("$.entity_id").alias("entity_id"), (part("$.delete") == "true").alias("gone"), part("$.payload.id").alias("payload_id"))


@query("k4_backfill_offload", "SELECT 'account' AS kind, count(*) AS n FROM fx_accounts WHERE user_id IN (SELECT user_id FROM fx_user_client)")
def k4(fx):
    return sinks.backfill_offload(fx.accounts, "account", fx.user_client, dry_run=True)


@query("k4_backfill_feed", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(id AS VARCHAR) AS entity_id, currency, CAST(credit_limit AS DOUBLE) AS credit_limit FROM fx_accounts WHERE user_id IN (SELECT user_id FROM fx_user_client)")
def k4_feed(fx):
    part = lambda p: F.get_json_object("value", p)
    return sinks.backfill_offload(fx.accounts, "account", fx.user_client).select(
        "key", part("$.entity_id").alias("entity_id"), part("$.payload.currency").alias("currency"), part("$.payload.credit_limit").cast("double").alias("credit_limit")
    )


@query("k5_personal_transactions", "SELECT user_id, sha256(CAST(account_id AS VARCHAR)) AS account, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount, description FROM fx_stored")
def k5_transactions(fx):
    return sinks.personal_transactions(fx.stored)


@query("k5_personal_accounts", "SELECT user_id, sha256(CAST(id AS VARCHAR)) AS account, type, currency, balance, coalesce(iban, '') AS identification FROM fx_accounts")
def k5(fx):
    return sinks.personal_accounts(fx.accounts)


@query("k7_ingestion_finished", f"""
WITH {_INSTRUCTIONS}, m AS (SELECT user_id, strftime(min(date), '%Y-%m') AS first_month, strftime(max(date), '%Y-%m') AS last_month FROM (SELECT user_id, date FROM fx_upstream UNION ALL SELECT user_id, date FROM fx_stored WHERE status = 'PENDING') x GROUP BY user_id)
SELECT m.*, coalesce((SELECT count(DISTINCT account_id) FROM fx_upstream u WHERE u.user_id = m.user_id AND external_id IS NOT NULL), 0) AS n_last, coalesce((SELECT count(DISTINCT account_id) FROM ins WHERE ins.user_id = m.user_id AND action <> 'IGNORE'), 0) AS n_changed FROM m""")
def k7(fx):
    out = sinks.ingestion_finished(fx.upstream, fx.stored, _instructions(fx), ["user_id"])
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(F.map_keys(c))).cast("long")
    return out.select("user_id", "first_month", "last_month", size("last_external_id").alias("n_last"), size("oldest_change").alias("n_changed"))


@query("k7_finished_entries", f"""
WITH {_INSTRUCTIONS}, l AS (SELECT user_id, account_id, arg_max(external_id, pos) AS v FROM fx_upstream WHERE external_id IS NOT NULL GROUP BY ALL)
SELECT user_id, 'last_external_id' AS entry, CAST(account_id AS VARCHAR) AS account, v AS value FROM l
UNION ALL SELECT user_id, 'oldest_change', CAST(account_id AS VARCHAR), CAST(min(date) AS VARCHAR) FROM ins WHERE action <> 'IGNORE' AND user_id IN (SELECT user_id FROM fx_upstream UNION SELECT user_id FROM fx_stored WHERE status = 'PENDING') GROUP BY user_id, account_id""")
def k7_entries(fx):
    out = sinks.ingestion_finished(fx.upstream, fx.stored, _instructions(fx), ["user_id"])
    flat = lambda c: out.select("user_id", F.lit(c).alias("entry"), F.explode(c).alias("account", "value")).withColumn("value", F.col("value").cast("string"))
    return flat("last_external_id").unionByName(flat("oldest_change"))


# --- sources and streams --------------------------------------------------------------------

@query("s2_split_invalid", """
WITH r AS (SELECT * FROM (SELECT account_id, o.status, CASE WHEN order_no % 97 = 0 THEN NULL ELSE amount END AS amount, CASE WHEN order_no % 11 = 0 THEN 'HOLD' ELSE o.status END AS st FROM fx_upstream o) x WHERE st <> 'HOLD')
SELECT account_id, count(*) AS rows FROM r GROUP BY account_id HAVING count(*) > count(amount)""")
def s2(fx):
    rows = fx.upstream.withColumns({"amount": F.when(F.col("order_no") % 97 != 0, F.col("amount")), "status": F.when(F.col("order_no") % 11 == 0, "HOLD").otherwise(F.col("status"))})
    return messages.split_invalid(rows, ["account_id"], ["amount", "date"])[1]


def _subscriptions(fx: Fixtures) -> DataFrame:
    names = [F.lit(d) for d in activities.SUBSCRIBED]
    client = fx.user_client.select("client_id").distinct()
    return client.select("client_id", F.when(F.col("client_id") == 0, F.array(names[0], names[1])).when(F.col("client_id") == 1, F.array(*names)).otherwise(F.array().cast("array<string>")).alias("domains"))


@query("t2_wanted_messages", """
SELECT message_id FROM fx_messages m JOIN (SELECT user_id, client_id FROM fx_user_client) c ON m.user_id % 90 = c.user_id WHERE (client_id = 0 AND domain IN ('CATEGORIES', 'COUNTER_PARTIES')) OR (client_id = 1 AND domain <> 'PREPROCESSING')""")
def t2(fx):
    m = fx.messages.withColumns({"user_id": F.col("user_id") % 90, "version": F.lit(1)})
    return activities.wanted_messages(m, fx.user_client, _subscriptions(fx)).select("message_id")


def _expected(fx: Fixtures) -> DataFrame:
    acts = fx.messages.select("activity_id").distinct().withColumns({"client_id": F.col("activity_id") % 3, "kind": F.when(F.col("activity_id") % 5 == 0, "TRANSACTION_CYCLES_FEEDBACK").otherwise("REFRESH")})
    return activities.expected_sum(acts, _subscriptions(fx))


_EXPECTED = """
x AS (SELECT activity_id, CASE WHEN activity_id % 3 = 0 THEN 11 + CASE WHEN activity_id % 5 = 0 THEN 100 ELSE 0 END ELSE 1111 END AS expected FROM (SELECT DISTINCT activity_id FROM fx_messages) a WHERE activity_id % 3 < 2)"""


@query("t6_expected_sum", f"WITH {_EXPECTED} SELECT activity_id, CAST(expected AS INTEGER) AS expected FROM x")
def t6(fx):
    return _expected(fx).select("activity_id", "expected")


@query("t3_activity_completion", f"""
WITH {_EXPECTED},
r AS (SELECT m.*, expected, sum(CASE domain WHEN 'CATEGORIES' THEN 1 WHEN 'COUNTER_PARTIES' THEN 10 WHEN 'TRANSACTION_CYCLES' THEN 100 WHEN 'LABELS' THEN 1000 ELSE 0 END) OVER (PARTITION BY m.activity_id ORDER BY ts, message_id) AS s FROM fx_messages m JOIN x ON x.activity_id = m.activity_id),
f AS (SELECT activity_id, ts, message_id FROM (SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY ts, message_id) AS k FROM r WHERE s = expected) y WHERE k = 1)
SELECT r.activity_id, r.account_id, CAST(min(r.date) AS VARCHAR) AS oldest_date, any_value(f.message_id) AS completed_by FROM r JOIN f ON f.activity_id = r.activity_id AND (r.ts < f.ts OR (r.ts = f.ts AND r.message_id <= f.message_id)) GROUP BY r.activity_id, r.account_id""")
def t3(fx):
    return activities.completed_activities(fx.messages.withColumn("is_last", F.lit(True)), _expected(fx))
