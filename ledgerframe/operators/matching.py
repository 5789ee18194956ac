"""Matching upstream rows against stored ones: windows, equality stages and the attribute strategy.

All accounts are matched at once. Both sides are put into one tagged frame, and
a stage is a single window over (account, attribute values): how often a key
occurs on either side tells rejected, duplicate, matched and peerless rows
apart, so a stage costs one shuffle and no join. Values are compared null-safe.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import UNMATCHED_WEIGHTS, Selector, cents, first_present, not_blank, not_null, signed

KEYS = ["user_id", "account_id"]
ATTRIBUTES = [
    "external_id", "cents", "date", "status", "booking_date", "ts", "debtor_name", "debtor_account", "creditor_name", "creditor_account", "description", "end_to_end_id",
]
BACKFILL_DAYS = 7
# The provider with gap-free numeric ids, and the one that sends only what is new.
NUMERIC_ID_PROVIDER, DELTA_PROVIDER = "RABOBANK", "BUDGET_INSIGHT"


@dataclass(frozen=True)
class Stage:
    name: str
    selectors: tuple[Selector, ...]

    def without(self, postfix: str, attribute: str) -> Stage:
        return Stage(f"{self.name}-{postfix}", tuple(s for s in self.selectors if s.name != attribute))


_DETAILS = tuple(map(Selector, ("creditor_name", "debtor_name", "description", "external_id", "ts")))
EXTERNAL_ID_AMOUNT = Stage("ExternalIdAmountStrict", (not_blank("external_id"), not_null("cents")))
BOOKING_DATE_AMOUNT = Stage("BookingDateAmountStrict", (not_null("booking_date"), not_null("cents"), *_DETAILS))
DATE_AMOUNT = Stage("DateAmountStrict", (not_null("date"), not_null("cents"), *_DETAILS))
OPEN_BANKING = Stage("OpenBanking", (not_null("cents"), not_null("booking_date"), *_DETAILS))

# How each provider is matched.
PROVIDER_STAGES: dict[str, tuple[str, tuple[Stage, ...]]] = {
    "ASN_BANK": ("unbounded", (EXTERNAL_ID_AMOUNT,)),
    "BUNQ": ("unbounded", (EXTERNAL_ID_AMOUNT,)),
    "RABOBANK": ("unbounded", (EXTERNAL_ID_AMOUNT,)),
    "REGIO_BANK": ("unbounded", (EXTERNAL_ID_AMOUNT,)),
    "SNS_BANK": ("unbounded", (EXTERNAL_ID_AMOUNT,)),
    "TRIODOS_BANK_NL": ("unbounded", (EXTERNAL_ID_AMOUNT, BOOKING_DATE_AMOUNT)),
    "KNAB_BANK_NL": ("booking_date", (EXTERNAL_ID_AMOUNT, BOOKING_DATE_AMOUNT)),
    "ABN_AMRO": ("unbounded", (EXTERNAL_ID_AMOUNT, BOOKING_DATE_AMOUNT, DATE_AMOUNT)),
    "ING_NL": ("unbounded", (EXTERNAL_ID_AMOUNT, BOOKING_DATE_AMOUNT, BOOKING_DATE_AMOUNT.without("noTs", "ts"))),
}


def _optional(df: DataFrame, name: str, kind: str = "string"):
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def generalize(df: DataFrame, side: str) -> DataFrame:
    """The attributes both sides share. Upstream amounts are unsigned with a direction, stored ones signed."""
    if side == "upstream":
        amount, row, numbers = signed("amount", "type"), F.col("pos").cast("string"), ("{}_account",)
    else:
        amount, row, numbers = F.col("amount"), F.col("id").cast("string"), ("{}_bban", "{}_iban", "{}_pan", "{}_masked_pan", "{}_sort_code")

    def account(party: str):
        return first_present(*(_optional(df, n.format(party)) for n in numbers)).alias(f"{party}_account")

    return df.select(
        *KEYS, F.lit(side).alias("side"), row.alias("row"), "external_id", cents(amount).alias("cents"), "date", "status", "booking_date", F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"),
        _optional(df, "debtor_name").alias("debtor_name"), account("debtor"), _optional(df, "creditor_name").alias("creditor_name"), account("creditor"), "description", _optional(df, "end_to_end_id").alias("end_to_end_id"), _optional(df, "provider").alias("provider"),
    )


def unmatched(upstream: DataFrame, stored: DataFrame) -> DataFrame:
    """Both generalized sides as one frame, nothing matched yet."""
    return upstream.unionByName(stored).select(
        "*", F.lit("UNPROCESSED").alias("reason"), F.lit(None).cast("string").alias("matcher"), F.lit(None).cast("string").alias("partner"),
    )


def _weight(reason):
    found = F.lit(0)
    for name, weight in UNMATCHED_WEIGHTS.items():
        found = F.when(reason == name, weight).otherwise(found)
    return found


def match_on_equality(rows: DataFrame, stage: Stage, applies: Column | None = None) -> DataFrame:
    """One stage over what is not yet matched; every row comes back, matched rows with their partner.

    A key must be usable and occur once on either side to match. A new reason
    replaces an old one of no greater weight, together with the matcher's name.
    Rows to which the stage does not apply stay as they are.
    """
    applies = F.lit(True) if applies is None else F.coalesce(applies, F.lit(False))
    usable = F.lit(True)
    for s in stage.selectors:
        usable = usable & s.usable()
    values = [f"_v{i}" for i in range(len(stage.selectors))]
    key = Window.partitionBy(*KEYS, "_in", *values)
    is_open = F.col("partner").isNull() & applies
    out = rows.withColumns(
        {v: s.value() for v, s in zip(values, stage.selectors, strict=True)} | {"_open": is_open, "_in": is_open & F.coalesce(usable, F.lit(False))}
    )
    up, mine = F.col("side") == "upstream", F.col("side")
    count = lambda test: F.sum(F.when(F.col("_in") & test, 1).otherwise(0)).over(key)
    out = out.withColumns({
        "_up": count(up), "_st": count(~up),
        "_up_row": F.max(F.when(F.col("_in") & up, F.col("row"))).over(key), "_st_row": F.max(F.when(F.col("_in") & ~up, F.col("row"))).over(key),
    })
    own = F.when(mine == "upstream", F.col("_up")).otherwise(F.col("_st"))
    new = F.when(~F.col("_in"), "REJECTED").when(own > 1, "DUPLICATE").when((F.col("_up") == 1) & (F.col("_st") == 1), "MATCHED").otherwise("PEERLESS")
    out = out.withColumn("_new", F.when(F.col("_open"), new))
    matched = F.col("_new") == "MATCHED"
    replaces = F.coalesce(F.col("_open") & (matched | (_weight(F.col("_new")) >= _weight(F.col("reason")))), F.lit(False))
    return out.withColumns({
        "partner": F.when(matched, F.when(mine == "upstream", F.col("_st_row")).otherwise(F.col("_up_row"))).otherwise(F.col("partner")),
        "reason": F.when(replaces, F.col("_new")).otherwise(F.col("reason")),
        "matcher": F.when(replaces, F.lit(stage.name)).otherwise(F.col("matcher")),
    }).select(*rows.columns)


#: Accounts with windows that begin long before the others' and are read by name.
OUTLIERS = 500


def pruned(stored: DataFrame, upstream: DataFrame, outliers: int = OUTLIERS) -> DataFrame:
    """Stored rows that any account's window can hold: literal bounds, which reach the scan.

    Windows are counted by the month they begin in. Most accounts share a bound;
    up to ``outliers`` accounts whose windows begin before it are read by name, so
    that one back-dated row does not open the old months of all accounts. Costs one
    aggregate over what came in. Without upstream rows nothing is read.
    """
    begins = upstream.groupBy(*KEYS).agg(F.date_sub(F.to_date(F.min("ts")), 1).alias("_from")).where("_from IS NOT NULL")
    months = begins.groupBy(F.date_trunc("month", "_from").cast("date").alias("m")).agg(F.count("*").alias("n"), F.min("_from").alias("first")).orderBy("m").collect()
    if not months:
        return stored.limit(0)
    before, at = 0, 0
    while at + 1 < len(months) and before + months[at].n <= outliers:
        before, at = before + months[at].n, at + 1
    shared, first = months[at].first, months[0].first
    by_month = lambda day: F.col("month") >= day.strftime("%Y-%m")
    if at == 0:
        near = stored.where(by_month(shared)) if "month" in stored.columns else stored
        return near.where(F.col("date") >= F.lit(shared))
    named = begins.where(F.col("_from") < F.lit(shared)).select(*KEYS).collect()
    old = F.lit(True)
    for key in KEYS:
        old = old & F.col(key).isin(sorted({r[key] for r in named}))
    recent, older = stored.where(F.col("date") >= F.lit(shared)), stored.where((F.col("date") < F.lit(shared)) & (F.col("date") >= F.lit(first)) & old)
    if "month" in stored.columns:
        recent, older = recent.where(by_month(shared)), older.where(by_month(first) & (F.col("month") <= shared.strftime("%Y-%m")))
    return recent.unionByName(older)


def _number(external_id: str = "external_id") -> Column:
    return F.expr(f"try_cast(trim({external_id}) AS BIGINT)")


def stored_in_window(upstream: DataFrame, stored: DataFrame, numeric_ids: bool | Column = False) -> DataFrame:
    """Stored rows in the time window of each account's upstream rows.

    ``numeric_ids`` (for all, or a test of upstream rows) adds the rule for
    providers with gap-free numeric ids: stored ids below the smallest upstream id
    go, and stored rows whose id occurs upstream stay whatever their time.
    """
    always = isinstance(numeric_ids, bool)
    numeric = F.lit(numeric_ids) if always else F.coalesce(numeric_ids, F.lit(False))
    number = _number()
    bounds = upstream.groupBy(*KEYS).agg(
        F.min("ts").alias("_t0"), F.min(number).alias("_low"), F.max(number).alias("_high"), F.count_distinct(number).alias("_kinds"), F.count_if(number.isNull()).alias("_bad"),
        F.bool_or(numeric).alias("_numeric"),
    )
    day = F.to_date("_t0")
    joined = pruned(stored, upstream).join(bounds, KEYS).where(F.col("date") >= F.date_sub(day, 1))
    second = lambda c: F.date_trunc("second", c)
    in_time = F.when(F.col("ts").isNull(), F.col("date") >= day).otherwise(second("ts") >= second("_t0"))
    if always and not numeric_ids:
        return joined.where(in_time).select(*stored.columns)
    dense = F.col("_numeric") & (F.col("_bad") == 0) & (F.col("_kinds") == F.col("_high") - F.col("_low") + 1)
    seen = upstream.where(numeric & F.col("external_id").isNotNull()).select(*KEYS, "external_id").distinct().withColumn("_seen", F.lit(True))
    marked = joined.join(seen, [*KEYS, "external_id"], "left")
    stays = ~dense | number.isNull() | (number >= F.col("_low"))
    return marked.where(F.coalesce(stays, F.lit(True)) & (F.col("_seen") | in_time)).select(*stored.columns)


def accounts_with_odd_ids(upstream: DataFrame, stored: DataFrame, numeric: Column) -> DataFrame:
    """Accounts under the numeric rule (a test of upstream rows) that hold an id that is no number, on either side of the window."""
    own = upstream.where(numeric)
    bounds = own.groupBy(*KEYS).agg(F.date_sub(F.to_date(F.min("ts")), 1).alias("_from"))
    near = pruned(stored, own).join(bounds, KEYS).where(F.col("date") >= F.col("_from"))
    return own.select(*KEYS, "external_id").unionByName(near.select(*KEYS, "external_id")).where(_number().isNull()).select(*KEYS).distinct()


def sync_bounds(upstream: DataFrame, stored: DataFrame) -> DataFrame:
    """Per account the relation of the booking-date intervals and the lower bound it gives (null: none).

    The order of the tests matters: an interval pair may pass several of them.
    """
    def interval(df, p):
        return df.groupBy(*KEYS).agg(F.min("booking_date").alias(f"{p}_start"), F.max("booking_date").alias(f"{p}_end"), (F.count("*") == F.count("booking_date")).alias(f"{p}_sure"))

    both = interval(upstream, "u").join(interval(stored, "s"), KEYS, "left")
    a, b, c, d = F.col("u_start"), F.col("u_end"), F.col("s_start"), F.col("s_end")
    relation = (
        F.when(c.isNull() | ~F.col("u_sure") | ~F.col("s_sure"), "UNBOUNDED")
        .when((a == c) & (b == d), "EQUAL").when(b < c, "PRECEDES").when(a > d, "PRECEDED_BY").when(b == c, "MEETS").when(a == d, "MET_BY")
        .when((a < c) & (b > c) & (b < d), "OVERLAPS").when((a > c) & (a < d) & (b > d), "OVERLAPPED_BY")
        .when((a == c) & (b < d), "STARTS").when((a == c) & (b > d), "STARTED_BY").when((a > c) & (b < d), "DURING").when((a < c) & (b > d), "CONTAINS")
        .when((a > c) & (b == d), "FINISHES").when((a < c) & (b == d), "FINISHED_BY")
    )
    several = F.datediff(b, a) >= 1
    bound = (
        F.when(F.col("relation").isin("STARTS", "DURING"), F.when(several, F.date_add(a, 1)).otherwise(a))
        .when(F.col("relation").isin("PRECEDED_BY", "MET_BY"), a)
        .when(F.col("relation").isin("OVERLAPPED_BY", "STARTED_BY", "FINISHES", "EQUAL"), F.when((a < d) & several, F.date_add(a, 1)).otherwise(a))
    )
    return both.withColumn("relation", relation).withColumn("lower", bound).select(*KEYS, "relation", "lower")


def truncate_to(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows on or after their account's bound; all of them where there is none."""
    return df.join(bounds.select(*KEYS, "lower"), KEYS, "left").where(F.col("lower").isNull() | (F.col("booking_date") >= F.col("lower"))).drop("lower")


def match_attributes(
    upstream: DataFrame, stored: DataFrame, stages: Sequence[Stage | tuple[Stage, Column]], window: str | Column = "unbounded", numeric_ids: bool | Column = False
) -> DataFrame:
    """All rows of the attribute strategy with what became of them and their account's outcome.

    Columns: keys, side, row, date, status, reason, matcher, partner, outcome,
    fill_type. Booked upstream rows take part; accounts without any are left out.
    A stage may come with a test of the account's ``provider`` (a column of
    upstream), a window and the numeric rule with a test of upstream rows, so that
    all providers go through one plan. An account under the numeric rule with an
    id that is no number fails.
    """
    booked = upstream.where("status = 'BOOKED'")
    in_window = stored_in_window(booked, stored, numeric_ids)
    if not isinstance(window, str) or window == "booking_date":
        bounded = booked if isinstance(window, str) else booked.where(window)
        bounds = sync_bounds(bounded, in_window.where("status = 'BOOKED'"))
        booked, in_window = truncate_to(booked, bounds), truncate_to(in_window, bounds)
    up, st = generalize(booked, "upstream"), generalize(in_window, "stored")
    account = Window.partitionBy(*KEYS)
    rows = unmatched(up, st).withColumn("provider", F.max("provider").over(account))
    is_up, pending = F.col("side") == "upstream", (F.col("side") == "stored") & (F.col("status") == "PENDING")
    rows = rows.withColumns({
        "_fresh": ~F.bool_or(F.col("side") == "stored").over(account), "_oldest": F.min(F.when(is_up, F.col("date"))).over(account),
        "_newest": F.coalesce(F.max(F.when(~is_up, F.col("date"))).over(account), F.lit("1970-01-01").cast("date")), "_pending": pending,
    })
    # Pending rows and accounts with nothing stored stand apart from the stages.
    taking_part = rows.where(~F.col("_pending") & ~F.col("_fresh"))
    for stage in stages:
        taking_part = match_on_equality(taking_part, *(stage if isinstance(stage, tuple) else (stage,)))
    rows = taking_part.unionByName(rows.where(F.col("_pending") | F.col("_fresh")))
    left = F.col("partner").isNull() & ~F.col("_pending") & ~F.col("_fresh")
    bad = lambda side, reasons: F.bool_or(left & (F.col("side") == side) & F.col("reason").isin(*reasons)).over(account)
    late = F.bool_or(left & (F.col("side") == "stored") & (F.col("reason") == "PEERLESS") & (F.col("date") != F.col("_oldest"))).over(account)
    outcome = (
        F.when(bad("stored", ["UNPROCESSED"]), "FATAL_STORED_UNPROCESSED").when(bad("stored", ["REJECTED"]), "FATAL_STORED_REJECTED")
        .when(late, "FATAL_STORED_PEERLESS").when(bad("stored", ["DUPLICATE"]), "FATAL_STORED_DUPLICATE")
        .when(bad("upstream", ["UNPROCESSED"]), "FATAL_UPSTREAM_UNPROCESSED").when(bad("upstream", ["REJECTED"]), "FATAL_UPSTREAM_REJECTED")
        .when(bad("upstream", ["DUPLICATE"]), "FATAL_UPSTREAM_DUPLICATE").otherwise("OK")
    )
    if not isinstance(numeric_ids, bool):
        odd = accounts_with_odd_ids(upstream.where("status = 'BOOKED'"), stored, numeric_ids).withColumn("_odd", F.lit(True))
        rows = rows.join(odd, KEYS, "left")
        outcome = F.when(F.col("_odd"), "FATAL_EXTERNAL_ID").otherwise(outcome)
    regular = F.col("_fresh") | (F.col("date") > F.date_sub("_newest", BACKFILL_DAYS))
    inserted = is_up & (F.col("_fresh") | (left & (F.col("reason") == "PEERLESS")))
    return rows.withColumn("outcome", outcome).withColumn("fill_type", F.when(inserted, F.when(regular, "REGULAR").otherwise("BACKFILLED"))).select(
        *KEYS, "side", "row", "date", "status", "reason", "matcher", "partner", "outcome", "fill_type"
    )


def reconcile_attributes(upstream: DataFrame, stored: DataFrame, stages, window: str | Column = "unbounded", numeric_ids: bool | Column = False) -> DataFrame:
    """Instructions (keys, action, row, date, fill_type) of the accounts whose outcome is OK: inserts and pending deletes."""
    return attribute_instructions(match_attributes(upstream, stored, stages, window, numeric_ids))


def attribute_instructions(rows: DataFrame) -> DataFrame:
    """What ``match_attributes`` asks to do to the accounts whose outcome is OK."""
    rows = rows.where("outcome = 'OK'")
    action = F.when(F.col("fill_type").isNotNull(), "INSERT").when((F.col("side") == "stored") & (F.col("status") == "PENDING"), "DELETE")
    return rows.select(*KEYS, action.alias("action"), "row", "date", "fill_type").where("action IS NOT NULL")


def oldest_change(instructions: DataFrame) -> DataFrame:
    """Per account the oldest date that a change touches; backfilled rows do not count."""
    return instructions.where("fill_type IS NULL OR fill_type = 'REGULAR'").groupBy(*KEYS).agg(F.min("date").alias("oldest_change"))


def match_report(rows: DataFrame) -> DataFrame:
    """Counts per account, matcher, side and reason."""
    return rows.groupBy(*KEYS, F.coalesce("matcher", F.lit("none")).alias("matcher"), "side", "reason").agg(F.count("*").alias("n"))


#: Rows that a report shows of each of its groups.
SAMPLE_ROWS = 5


def match_report_samples(rows: DataFrame, k: int = SAMPLE_ROWS, seed: int = 42) -> DataFrame:
    """The counts of ``match_report`` with up to ``k`` of each group's rows: those of the lowest hashes, in their order.

    Hashes are counted by their number of bits, at most 61 counts a group and task;
    only rows of the shortest lengths that hold k rows are gathered, a few times k
    whatever the group's size. The same rows are shown on every run.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "row"))
    shown = F.struct(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"), "row", "external_id", "cents", "date", "booking_date", "description")
    group = [*KEYS, "matcher", "side", "reason"]
    marked = rows.withColumn("matcher", F.coalesce("matcher", F.lit("none"))).select(*group, shown.alias("s")).withColumn("bits", F.length(F.bin("s.h")))
    cells = marked.groupBy(*group, "bits").agg(F.count("*").alias("n"))
    rising = Window.partitionBy(*group).orderBy("bits")
    needed = cells.withColumn("before", F.sum("n").over(rising) - F.col("n")).where(F.col("before") < k)
    totals = cells.groupBy(*group).agg(F.sum("n").alias("n"))
    few = marked.join(needed.select(*group, "bits"), [*group, "bits"], "left_semi")
    samples = few.groupBy(*group).agg(F.slice(F.array_sort(F.collect_list("s")), 1, k).alias("sample"))
    return totals.join(samples, group).select(*group, "n", F.transform("sample", lambda s: s.dropFields("h")).alias("sample"))
