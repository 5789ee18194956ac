"""Reads: intervals, pages, enrichment, merchant suggestions, similar groups."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

PAGE_SIZE = 100


@dataclass(frozen=True)
class Interval:
    """Inclusive dates. Two of start, period and end give the third; a period is like P1M, P7D or P1Y."""

    start: date
    end: date

    @staticmethod
    def of(text: str) -> Interval:
        parts = text.split("/")
        if len(parts) != 2:
            raise ValueError(f"an interval has two parts: {text}")
        first, last = parts
        if first.startswith("P") and last.startswith("P"):
            raise ValueError(f"an interval needs a date: {text}")
        if first.startswith("P"):
            end = date.fromisoformat(last)
            start = _shift(end, first, -1)
        elif last.startswith("P"):
            start = date.fromisoformat(first)
            end = _shift(start, last, 1)
        else:
            start, end = date.fromisoformat(first), date.fromisoformat(last)
        if start > end:
            raise ValueError(f"an interval ends before it starts: {text}")
        return Interval(start, end)

    @staticmethod
    def last_month(today: date) -> Interval:
        return Interval(_shift(today, "P1M", -1), today)


def _shift(day: date, period: str, sign: int) -> date:
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?", period)
    if not m or not any(m.groups()):
        raise ValueError(f"not a period: {period}")
    years, months, weeks, days = (int(x or 0) for x in m.groups())
    total = day.year * 12 + day.month - 1 + sign * (12 * years + months)
    year, month = divmod(total, 12)
    last = (date(year + month // 11, (month + 1) % 12 + 1, 1) - timedelta(days=1)).day if month != 11 else 31
    return date(year, month + 1, min(day.day, last)) + sign * timedelta(days=7 * weeks + days)


def transactions_between(txns: DataFrame, interval: Interval, accounts: list | None = None) -> DataFrame:
    """Transactions of an inclusive interval; backfilled ones are hidden, an unknown fill type counts as regular."""
    found = txns.where(F.col("date").between(F.lit(interval.start), F.lit(interval.end)))
    if accounts is not None:
        found = found.where(F.col("account_id").isin(accounts))
    return found.where("coalesce(fill_type, 'REGULAR') <> 'BACKFILLED'") if "fill_type" in txns.columns else found


def unknown_accounts(accounts: DataFrame, user, wanted: list) -> list:
    """Wanted account ids that the user does not have."""
    known = {r.id for r in accounts.where((F.col("user_id") == F.lit(user)) & F.col("id").isin(wanted)).select("id").distinct().collect()}
    return [x for x in wanted if x not in known]


def page(df: DataFrame, size: int = PAGE_SIZE, after: tuple | None = None) -> DataFrame:
    """The next rows in the order account, newest date, id, after a cursor (account, date, id)."""
    if after is not None:
        account, day, row = map(F.lit, after)
        a, d, i = F.col("account_id"), F.col("date"), F.col("id")
        df = df.where((a > account) | ((a == account) & ((d < day) | ((d == day) & (i > row)))))
    return df.orderBy("account_id", F.col("date").desc(), "id").limit(size)


def page_cursors(df: DataFrame, by: list[str], size: int = PAGE_SIZE) -> DataFrame:
    """Where each page of each group ends: rows of (by, page, rows, account_id, date, id)."""
    order = Window.partitionBy(*by).orderBy("account_id", F.col("date").desc(), "id")
    numbered = df.withColumn("_n", F.row_number().over(order))
    return (
        numbered.groupBy(*by, F.floor((F.col("_n") - 1) / size).alias("page"))
        .agg(F.count("*").alias("rows"), F.max_by(F.struct("account_id", "date", "id"), "_n").alias("c")).select(*by, "page", "rows", "c.account_id", "c.date", "c.id")
    )


ENRICHMENT_KEYS = ["user_id", "account_id", "date", "id"]


def enrich(txns: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Transactions with what the side table knows of them."""
    return txns.join(enrichments, ENRICHMENT_KEYS, "left")


def normal_search(texts: pd.Series) -> pd.Series:
    """Search form: lower case without accents, only letters, digits, spaces and other punctuation; sharp s as s, dashes as they are."""
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        spread = unicodedata.normalize("NFD", text.lower().replace("ß", "s"))
        return "".join(c for c in spread if unicodedata.category(c) in ("Ll", "Lu", "Lo", "Lm", "Lt", "Nd", "Po", "Pd") or c == " ")

    return texts.map(one)


#: Search terms in a block of the prefix index.
BLOCK_TERMS = 100_000
_AFTER_ALL = "\U0010ffff"


@dataclass(frozen=True)
class PrefixIndex:
    """Search terms in sorted blocks: rows of (block, country, term, merchant_name), and the first (country, term) of each block."""

    terms: DataFrame
    bounds: list[tuple[str, str]]


def prefix_index(merchants: DataFrame, block_terms: int = BLOCK_TERMS) -> PrefixIndex:
    """Sorts the merchants' search terms into blocks by country and term.

    Merchants (country, merchant_name, search_term, direct) have direct names and
    other spellings; of equal search terms the direct one counts, then the first
    by name. One bound a block comes to the driver.
    """
    normal = F.pandas_udf(normal_search, "string")
    spelled = merchants.select("country", "merchant_name", _search_form("search_term", normal).alias("term"), "direct").where("country IS NOT NULL AND term IS NOT NULL")
    best = F.min_by("merchant_name", F.struct((~F.col("direct")).alias("other"), "merchant_name"))
    terms = cut(spelled.groupBy("country", "term").agg(best.alias("merchant_name")))
    blocks = max(1, -(-terms.count() // block_terms))
    placed = cut(terms.repartitionByRange(blocks, "country", "term").withColumn("block", F.spark_partition_id()))
    first = placed.groupBy("block").agg(F.min(F.struct("country", "term")).alias("b")).orderBy("b").collect()
    # numbered anew, as a range may be empty
    order = {r.block: i for i, r in enumerate(first)}
    number = F.element_at(F.create_map(*(F.lit(x) for pair in order.items() for x in pair)), F.col("block")) if order else F.col("block")
    return PrefixIndex(placed.withColumn("block", number), [(r.b.country, r.b.term) for r in first])


def _search_form(column: str, normal) -> F.Column:
    """``normal_search`` of a column; plain ASCII without symbols goes by built-in functions."""
    plain = F.lower(F.col(column))
    return F.when(F.col(column).rlike(r"^[A-Za-z0-9 .,;:!?'\"&%#@/*-]*$"), plain).otherwise(normal(F.when(~F.col(column).rlike(r"^[A-Za-z0-9 .,;:!?'\"&%#@/*-]*$"), F.col(column))))


def merchant_suggest(queries: DataFrame, merchants: DataFrame | PrefixIndex, k: int = 10, adjusted: DataFrame | None = None) -> DataFrame:
    """Up to k merchants a query (query_id, country, text), by normalised prefix.

    Each distinct prefix goes to the blocks of the index that its range of terms
    meets: its own, and further ones only while blocks begin with the prefix. A
    block gives the first k merchants of a prefix, so the rows that are joined grow
    with the queries and their answers. The first k distinct merchants in the order
    of their terms are returned, numbered by name. An empty text asks for the names
    that the query's ``user_id`` has given before (``adjusted``: user_id, nth,
    counterparty_name), all of them in their order; a text of signs only matches all.
    """
    index = merchants if isinstance(merchants, PrefixIndex) else prefix_index(merchants)
    normal = F.pandas_udf(normal_search, "string")
    asked = queries.where("text <> ''").withColumn("prefix", _search_form("text", normal))
    firsts = index.bounds

    def place(country: pd.Series, prefix: pd.Series) -> pd.Series:
        pairs = zip(country, prefix, strict=True)
        return pd.Series([list(range(max(0, bisect_right(firsts, (c, p)) - 1), bisect_right(firsts, (c, p + _AFTER_ALL)))) for c, p in pairs])

    wanted = asked.select("country", "prefix").where("country IS NOT NULL").distinct()
    wanted = wanted.withColumn("block", F.explode(F.pandas_udf(place, "array<int>")("country", "prefix")))

    def look_up(terms: pd.DataFrame, prefixes: pd.DataFrame) -> pd.DataFrame:
        terms = terms.sort_values(["country", "term"])
        keys, names = list(zip(terms["country"], terms["term"], strict=True)), terms["merchant_name"].tolist()
        found = []
        for country, prefix in zip(prefixes["country"], prefixes["prefix"], strict=True):
            seen: set[str] = set()
            for at in range(bisect_left(keys, (country, prefix)), len(keys)):
                if len(seen) == k or keys[at][0] != country or not keys[at][1].startswith(prefix):
                    break
                if names[at] not in seen:
                    seen.add(names[at])
                    found.append((country, prefix, keys[at][1], names[at]))
        return pd.DataFrame(found, columns=["country", "prefix", "term", "merchant_name"])

    met = index.terms.join(wanted.select("block").distinct(), "block", "left_semi")
    hits = met.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(look_up, "country string, prefix string, term string, merchant_name string")
    first = hits.groupBy("country", "prefix", "merchant_name").agg(F.min("term").alias("term"))
    by_term, by_name = Window.partitionBy("country", "prefix").orderBy("term", "merchant_name"), Window.partitionBy("country", "prefix").orderBy("merchant_name")
    answers = first.withColumn("_n", F.row_number().over(by_term)).where(F.col("_n") <= k).withColumn("rank", F.row_number().over(by_name))
    found = asked.join(answers, ["country", "prefix"]).select("query_id", "rank", "merchant_name")
    if adjusted is None:
        return found
    names = adjusted.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("nth", "counterparty_name")))
    own = queries.where("text IS NULL OR text = ''").join(names, "user_id").select("query_id", "rank", F.col("counterparty_name").alias("merchant_name"))
    return found.unionByName(own)


def group_similar(groups: DataFrame) -> DataFrame:
    """Similar transactions (user_id, group_no, name, keys of (account_id, id)): count and ids per account; empty groups go."""
    one = groups.withColumn("n", F.size("keys")).select("user_id", "group_no", "name", "n", F.explode("keys").alias("k"))
    return one.groupBy("user_id", "group_no", "name", "n", F.col("k.account_id").alias("account_id")).agg(F.sort_array(F.collect_set("k.id")).alias("ids"))
