"""The default strategy: stored rows take upstream rows one at a time.

What a stored row takes depends on what the ones before it took, but only rows
that share an external id, or a day and an amount, can want the same upstream
row. So an account falls into components: its (day, amount) classes, joined
where rows of one external id lie in several of them. Components never touch,
and almost all have at most one row a side, which built-in functions settle. The
rest is sorted by component and streamed through a matcher that holds one
component at a time and looks rows up by id and by (day, amount), so its time is
in proportion to the rows.

A bank that gives many rows one external id makes a whole account a component.
Components of more than ``SPLIT_ROWS`` rows are therefore matched in rounds, in
parts (``_in_rounds``): as long as an id has two or more free upstream rows, a
stored row of the id takes none but those of its own day, so days do not touch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import cents, signed
from .graph import components, cut
from .matching import KEYS, stored_in_window

FIELDS = ["row", "external_id", "date", "status", "cents", "raw", "description"]
OUT = "action string, stored_row string, upstream_row string, date date, how string"
#: Components with more rows are matched in parts, so many rounds at most; what is left then is matched in one go.
SPLIT_ROWS, MAX_ROUNDS = 20_000, 25
COMPARED = ["external_id", "date", "status", "cents", "description"]


def _prepared(df: DataFrame, side: str) -> DataFrame:
    """One shape for both sides; ``raw`` is the amount as given, ``first`` and ``second`` are the order within an account."""
    if side == "upstream":
        amount, row = signed("amount", "type"), F.col("pos").cast("string")
        order = F.col("pos").cast("long"), F.lit("")
    else:
        amount, row = F.col("amount"), F.col("id").cast("string")
        order = -F.unix_date("date").cast("long"), row
    return df.select(
        *KEYS, F.lit(side).alias("side"), row.alias("row"), "external_id", "date", "status", cents(amount).alias("cents"), cents("amount").alias("raw"), "description",
        order[0].alias("first"), order[1].alias("second"),
    )


def _same(a, b) -> bool:
    return (pd.isna(a) and pd.isna(b)) or (not pd.isna(a) and not pd.isna(b) and a == b)


class _Free:
    """The upstream rows nobody has taken, by external id and by day and amount, each in list order."""

    def __init__(self, rows: list[dict]):
        self.rows = dict(enumerate(rows))
        self.by: dict[tuple, dict[int, None]] = {}
        for k, row in self.rows.items():
            for key in self._keys(row):
                self.by.setdefault(key, {})[k] = None

    @staticmethod
    def _keys(row: dict) -> Iterator[tuple]:
        if row["external_id"] is not None:
            yield "id", row["external_id"]
            yield "id day", row["external_id"], row["date"]
            for kind in ("raw", "cents"):
                yield "id day", row["external_id"], row["date"], kind, row[kind]
        like = "like", row["status"] == "PENDING", row["cents"], row["date"]
        yield like
        yield *like, row["description"]

    def of(self, *key) -> dict[int, None]:
        return self.by.get(key, {})

    def first(self, *keys: tuple) -> int | None:
        return min((next(iter(found)) for key in keys if (found := self.of(*key))), default=None)

    def size(self, *keys: tuple) -> int:
        return sum(len(self.of(*key)) for key in keys)

    def take(self, k: int) -> dict:
        row = self.rows.pop(k)
        for key in self._keys(row):
            del self.by[key][k]
        return row


def match_rows(stored: list[dict], upstream: list[dict], signed_tiebreak: bool = True) -> list[tuple]:
    """(action, stored row, upstream row, date, how) of rows that may interact, both sides in order.

    With ``signed_tiebreak`` the amount test among several equal external ids
    compares the amounts as given, so an unsigned debit never passes it. A stored
    row marked ``many`` is told that its id has several free rows, some of them elsewhere.
    """
    free, out = _Free(upstream), []
    amount = "raw" if signed_tiebreak else "cents"
    for s in stored:
        taken, how = None, None
        n = 0 if s["external_id"] is None else 2 if s.get("many") else free.size(("id", s["external_id"]))
        if n:
            how, day = "external_id", ("id day", s["external_id"], s["date"])
            taken = free.first(("id", s["external_id"])) if n == 1 else free.first((*day, amount, s["cents"]))
            if taken is None:
                taken = free.first(day)
        else:
            like = [("like", pending, s["cents"], s["date"]) for pending in ([False] if s["status"] == "BOOKED" else [False, True])]
            n = free.size(*like)
            if n > 1:
                like = [(*key, s["description"]) for key in like]
                n = free.size(*like)
            if n:
                taken, how = free.first(*like), "unique" if n == 1 else "optimistic"
        if taken is None:
            out.append(("DELETE", s["row"], None, s["date"], None))
            continue
        u = free.take(taken)
        if u["date"] != s["date"] or u["status"] != s["status"]:
            out.append(("DELETE", s["row"], u["row"], s["date"], "moved"))
        out.append(("IGNORE" if all(_same(u[f], s[f]) for f in COMPARED) else "UPDATE", s["row"], u["row"], u["date"], how))
    return out + [("INSERT", None, u["row"], u["date"], None) for u in free.rows.values()]


def interacting(upstream: DataFrame, stored: DataFrame) -> DataFrame:
    """Both prepared sides in one frame, with the component (``part``) in which a row can meet others.

    A hash names a class of day and amount; classes that clash only make a component larger.
    """
    both = upstream.unionByName(stored).withColumn("spot", F.xxhash64(*KEYS, "cents", "date"))
    held = both.where("external_id IS NOT NULL").select(*KEYS, "external_id", "spot").distinct()
    links = cut(held.withColumn("b", F.min("spot").over(Window.partitionBy(*KEYS, "external_id"))).where("spot <> b").select(F.col("spot").alias("a"), "b").distinct())
    if links.isEmpty():
        return both.withColumnRenamed("spot", "part")
    roots = components(links).select(F.col("node").alias("spot"), "root")
    return both.join(roots, "spot", "left").withColumn("part", F.coalesce("root", "spot")).drop("root", "spot")


def _act(action, stored_row, upstream_row, date, how):
    text = lambda x: (F.lit(x) if x is None or isinstance(x, str) else x).cast("string")
    return F.struct(
        text(action).alias("action"), text(stored_row).alias("stored_row"), text(upstream_row).alias("upstream_row"), date.alias("date"), text(how).alias("how")
    )


def _settle_pairs(pairs: DataFrame) -> DataFrame:
    """Instructions of components with one row a side, columns ``s`` and ``u``."""
    s, u = F.col("s"), F.col("u")
    by_id = F.coalesce(s["external_id"] == u["external_id"], F.lit(False))
    alike = (s["cents"] == u["cents"]) & (s["date"] == u["date"]) & ~((s["status"] == "BOOKED") & (u["status"] == "PENDING"))
    same = F.lit(True)
    for f in COMPARED:
        same = same & s[f].eqNullSafe(u[f])
    moved = (s["date"] != u["date"]) | (s["status"] != u["status"])
    matched = F.array_compact(F.array(
        F.when(moved, _act("DELETE", s["row"], u["row"], s["date"], "moved")),
        _act(F.when(same, "IGNORE").otherwise("UPDATE"), s["row"], u["row"], u["date"], F.when(by_id, "external_id").otherwise("unique")),
    ))
    apart = F.array(_act("DELETE", s["row"], None, s["date"], None), _act("INSERT", None, u["row"], u["date"], None))
    return pairs.select(*KEYS, F.explode(F.when(by_id | F.coalesce(alike, F.lit(False)), matched).otherwise(apart)).alias("x")).select(*KEYS, "x.*")


def reconcile_default(upstream: DataFrame, stored: DataFrame, signed_tiebreak: bool = True) -> DataFrame:
    """Instructions (keys, action, stored_row, upstream_row, date, how) for every account with upstream rows."""
    rows = interacting(_prepared(upstream, "upstream"), _prepared(stored_in_window(upstream, stored), "stored"))
    part = Window.partitionBy(*KEYS, "part")
    is_up = F.col("side") == "upstream"
    counted = rows.withColumns({"n_up": F.count_if(is_up).over(part), "n_st": F.count_if(~is_up).over(part)})
    lone = (F.col("n_up") == 0) | (F.col("n_st") == 0)
    single = (F.col("n_up") == 1) & (F.col("n_st") == 1)
    alone = counted.where(lone).select(
        *KEYS, F.when(is_up, _act("INSERT", None, F.col("row"), F.col("date"), None)).otherwise(_act("DELETE", F.col("row"), None, F.col("date"), None)).alias("x")
    ).select(*KEYS, "x.*")
    whole = F.struct(*FIELDS)
    pairs = counted.where(single).groupBy(*KEYS, "part").agg(F.max(F.when(is_up, whole)).alias("u"), F.max(F.when(~is_up, whole)).alias("s"))

    several = counted.where(~lone & ~single).select(*KEYS, "part", "side", "first", "second", *FIELDS, (F.col("n_up") + F.col("n_st") > SPLIT_ROWS).alias("large"))
    small = _matched(several.where("NOT large").withColumn("many", F.lit(False)), ["part"], signed_tiebreak).select(*KEYS, *_NAMES)
    large = cut(several.where("large").drop("large"))
    done = alone.unionByName(_settle_pairs(pairs)).unionByName(small)
    return done if large.isEmpty() else done.unionByName(_in_rounds(large, signed_tiebreak))


_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _matched(rows: DataFrame, group: list[str], signed_tiebreak: bool) -> DataFrame:
    """Rows streamed through ``match_rows``, one group of an account at a time.

    Each instruction comes with the place (``first``, ``second``) of its stored row
    and with the external id of the upstream row it took (``took``).
    """
    keys = [*KEYS, *group]

    def match(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sides, done = None, {"stored": [], "upstream": []}, []

        def settle() -> None:
            if key is not None:
                places = {r["row"]: (r["first"], r["second"]) for r in sides["stored"]}
                took = {r["row"]: r["external_id"] for r in sides["upstream"]}
                done.extend((*key, *x, *places.get(x[1], (None, None)), took.get(x[2]) if x[1] is not None else None) for x in match_rows(sides["stored"], sides["upstream"], signed_tiebreak))

        names = [*keys, *_NAMES, "first", "second", "took"]
        for frame in frames:
            frame["external_id"] = frame["external_id"].astype(object).where(frame["external_id"].notna(), None)
            for row in frame.to_dict("records"):
                own = tuple(row[k] for k in keys)
                if own != key:
                    settle()
                    key, sides = own, {"stored": [], "upstream": []}
                sides[row["side"]].append(row)
            yield pd.DataFrame(done, columns=names)
            done.clear()
        settle()
        yield pd.DataFrame(done, columns=names)

    ordered = rows.select(*keys, "side", "first", "second", *FIELDS, "many").repartition(*keys).sortWithinPartitions(*keys, "side", "first", "second")
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInPandas(match, f"{kinds}, {OUT}, first long, second string, took string")


def _in_rounds(rows: DataFrame, signed_tiebreak: bool) -> DataFrame:
    """Instructions of large components (keys, ``part``), each matched in smaller parts at once, round by round.

    An id with two or more free upstream rows is taken to keep that many: its
    stored rows then look at their own day only. Of an id with one free row only
    the first stored row can take it by id; of an id with none, none can. So rows
    touch within a day, or where one id's last row lies. Afterwards takes are
    counted in order: once all but one of an id's rows are taken, the next stored
    row of that id was told wrong. What comes before the first such row of a
    component stands; from it on the component goes into the next round, where that
    id is down to its last row. An id is spent so once, and a round costs a few
    shuffles of what is left.
    """
    group = [*KEYS, "part"]
    place = F.struct("first", "second")
    everything, settled = rows, []
    for n in range(MAX_ROUNDS + 1):
        last = n == MAX_ROUNDS
        ids = rows.where("external_id IS NOT NULL").groupBy(*group, "external_id").agg(
            F.count_if(F.col("side") == "upstream").alias("free"), F.min(F.when(F.col("side") == "stored", place)).alias("head")
        )
        known = rows.join(ids, [*group, "external_id"], "left").withColumn("many", (F.coalesce("free", F.lit(0)) >= 2) & F.lit(not last))
        if last:
            done = cut(_matched(known, ["part"], signed_tiebreak))
        else:
            spotted = cut(known.withColumn("spot", F.xxhash64(*group, "cents", "date")))
            own_day = spotted.where("many").select(*group, "external_id", F.col("date").cast("string").alias("near"), "spot")
            is_head = (F.col("side") == "stored") & (place == F.col("head"))
            last_row = spotted.where("free = 1").where((F.col("side") == "upstream") | is_head).select(*group, "external_id", F.lit("").alias("near"), "spot")
            near = own_day.unionByName(last_row).distinct()
            links = near.withColumn("b", F.min("spot").over(Window.partitionBy(*group, "external_id", "near"))).where("spot <> b").select(F.col("spot").alias("a"), "b").distinct()
            roots = components(links).select(F.col("node").alias("spot"), "root")
            done = cut(_matched(spotted.join(roots, "spot", "left").withColumn("sub", F.coalesce("root", "spot")), ["part", "sub"], signed_tiebreak).where("stored_row IS NOT NULL"))
        if last:
            wrong = None
        else:
            takes = done.where("upstream_row IS NOT NULL AND took IS NOT NULL AND NOT (action = 'DELETE' AND how = 'moved')")
            counted = takes.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "took").orderBy("first", "second")))
            spent = counted.join(ids.where("free >= 2").select(*group, F.col("external_id").alias("took"), "free"), [*group, "took"]).where("nth = free - 1").select(*group, F.col("took").alias("external_id"), place.alias("spent"))
            told = rows.where("side = 'stored'").join(spent, [*group, "external_id"]).where(place > F.col("spent"))
            wrong = cut(told.groupBy(*group).agg(F.min(place).alias("wrong")))
        if wrong is None or wrong.isEmpty():
            settled.append(done.where("stored_row IS NOT NULL"))
            break
        settled.append(cut(done.join(wrong, group, "left").where(F.col("wrong").isNull() | (place < F.col("wrong"))).drop("wrong")))
        gone = settled[-1].where("upstream_row IS NOT NULL").select(*KEYS, F.lit("upstream").alias("side"), F.col("upstream_row").alias("row")).distinct()
        open_rows = (F.col("side") == "upstream") | (place >= F.col("wrong"))
        rows = cut(rows.join(wrong, group).where(open_rows).join(gone, [*KEYS, "side", "row"], "left_anti").select(*rows.columns))
    every = reduce(lambda a, b: a.unionByName(b), (x.select(*KEYS, *_NAMES) for x in settled))
    taken = every.where("upstream_row IS NOT NULL").select(*KEYS, F.col("upstream_row").alias("row")).distinct()
    fresh = everything.where("side = 'upstream'").join(taken, [*KEYS, "row"], "left_anti")
    none = F.lit(None).cast("string")
    return every.unionByName(fresh.select(*KEYS, F.lit("INSERT").alias("action"), none.alias("stored_row"), F.col("row").alias("upstream_row"), "date", none.alias("how")))


def reconcile_delta(upstream: DataFrame) -> DataFrame:
    """Sources that send only what is new: booked rows become inserts under their own external id."""
    return upstream.where("status = 'BOOKED'").select(*KEYS, F.lit("INSERT").alias("action"), F.col("external_id").alias("row"), "date", F.lit("REGULAR").alias("fill_type"))


def shadow_compare(active: DataFrame, passive: DataFrame, keys: list[str]) -> DataFrame:
    """Instructions that only one of two strategies gives, or that differ in action."""
    a = active.select(*keys, F.col("action").alias("active_action"))
    b = passive.select(*keys, F.col("action").alias("passive_action"))
    return a.join(b, keys, "full").where(~F.col("active_action").eqNullSafe(F.col("passive_action")))


def reconciliation_counters(instructions: DataFrame, upstream: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """The 14 counters of what the default strategy did with both sides, one row a counter.

    All three frames have the keys and ``by``. A missing external id is null or
    empty; rows of an id (an empty one too) that occurs more than once in an account count as duplicates.
    """
    rows = lambda df, row, p: df.select(*KEYS, row.cast("string").alias(f"{p}_row"), F.col("status").alias(f"{p}_status"))
    joined = (
        instructions.join(rows(stored, F.col("id"), "stored"), [*KEYS, "stored_row"], "left")
        .join(rows(upstream, F.col("pos"), "upstream"), [*KEYS, "upstream_row"], "left")
    )
    action, how, was, now = F.col("action"), F.col("how"), F.col("stored_status"), F.col("upstream_status")
    gone, kept = (action == "DELETE") & how.isNull(), action.isin("UPDATE", "IGNORE")
    done = {
        "upstream_new": action == "INSERT", "upstream_update": how == "moved", "upstream_unchanged": action == "IGNORE",
        "stored_match_extid": how == "external_id", "stored_match_uniq_attrs": how == "unique", "stored_match_attrs": how == "optimistic",
        "stored_no_match_booked": gone & (was == "BOOKED"), "stored_no_match_pending": gone & ~was.eqNullSafe("BOOKED"),
        "stored_pending_to_booked": kept & (was == "PENDING") & (now == "BOOKED"), "stored_booked_to_pending": kept & (was == "BOOKED") & (now == "PENDING"),
    }
    known = F.col("external_id").isNotNull() & (F.col("external_id") != "")
    per_id = upstream.groupBy(*dict.fromkeys([*by, *KEYS]), "external_id").agg(F.count("*").alias("n"))
    ids = {"upstream_total": F.sum("n"), "quality_extid_missing": F.sum(F.when(~known, F.col("n")).otherwise(0)), "quality_extid_dupes": F.sum(F.when(F.col("external_id").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0))}
    tables = (
        (joined, {name: F.count_if(test) for name, test in done.items()}), (per_id, ids), (stored_in_window(upstream, stored), {"stored_total": F.count("*")}),
    )
    long = [df.groupBy(*by).agg(*(c.alias(n) for n, c in counters.items())).unpivot(by, list(counters), "counter", "value") for df, counters in tables]
    # A provider with nothing stored has its zero, too.
    every = upstream.select(*by).distinct().crossJoin(upstream.sparkSession.createDataFrame([(n,) for _, counters in tables for n in counters], "counter string"))
    return every.join(long[0].unionByName(long[1]).unionByName(long[2]), [*by, "counter"], "left").select(*by, "counter", F.coalesce("value", F.lit(0)).alias("value"))
