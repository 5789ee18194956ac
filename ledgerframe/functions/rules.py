"""Scalar rules as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enum domains.
STATUSES = ("BOOKED", "PENDING", "HOLD")
ACCOUNT_STATUSES = ("ENABLED", "DELETED", "BLOCKED")
FILL_TYPES = ("REGULAR", "BACKFILLED")
UNMATCHED_WEIGHTS = {"UNPROCESSED": 0, "REJECTED": 1, "DUPLICATE": 2, "PEERLESS": 3}
PLACEHOLDER = "Not Provided"

_NUMBERS = r"\d+(?:[.,]\d+)*\s*"
_SORT_CODE = r"^[0-9]{2}-[0-9]{2}-[0-9]{2} [0-9]{7,8}$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed(amount: Column | str, direction: Column | str) -> Column:
    """An amount with the sign of its direction: debits are negative, whatever sign came in."""
    size = F.abs(col(amount))
    return F.when(col(direction) == "DEBIT", -size).otherwise(size)


def cents(amount: Column | str) -> Column:
    """Whole cents, half up."""
    return (F.round(col(amount), 2) * 100).cast("long")


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(F.trim(col(x)), F.lit(""))


def first_present(*columns: Column | str) -> Column:
    return F.coalesce(*map(blank_to_null, columns))


def normal_identification(x: Column | str) -> Column:
    """An account number without white space and punctuation, in upper case; null stays null and matches nothing."""
    return F.upper(F.regexp_replace(col(x), r"[\s\W]", ""))


def is_normal_identification(scheme: Column | str, x: Column | str) -> Column:
    """An IBAN without spaces whose letters, all but its numbers, are upper case; or a sort code and account number in their written form."""
    iban = ~F.contains(col(x), F.lit(" ")) & F.regexp_replace(col(x), _NUMBERS, "").rlike(r"^\p{Lu}+$")
    return F.when(col(scheme) == "IBAN", iban).when(col(scheme) == "SORTCODEACCOUNTNUMBER", col(x).rlike(_SORT_CODE)).otherwise(F.lit(False))


def maybe_card_number(x: Column | str) -> Column:
    return col(x).rlike(r"^[0-9]{15,16}$")


def balance_of(balances: Column | str, kind: str) -> Column:
    """Amount of the first balance of a kind in an array of (type, amount)."""
    return F.get(F.filter(col(balances), lambda b: b["type"] == kind), 0)["amount"]


def days_covered(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col(end), col(start)) + 1


def overlap(a_start, a_end, b_start, b_end) -> Column:
    return (col(a_start) <= col(b_end)) & (col(b_start) <= col(a_end))


@dataclass(frozen=True)
class Selector:
    """An attribute that takes part in a match: its value, and whether a row may use it."""

    name: str
    need: str = "any"
    since: str | None = None

    def value(self) -> Column:
        """Before ``since`` the attribute is null but still usable."""
        if self.since is None:
            return F.col(self.name)
        return F.when(F.col("ts") >= F.lit(self.since).cast("timestamp_ntz"), F.col(self.name))

    def usable(self) -> Column:
        x = F.col(self.name)
        tests = {
            "any": F.lit(True),
            "not_null": x.isNotNull(),
            "not_blank": x.isNotNull() & (F.trim(x.cast("string")) != ""),
            "not_placeholder": x.isNull() | (F.lower(F.trim(x.cast("string"))) != PLACEHOLDER.lower()),
        }
        return tests[self.need]


def not_null(name: str) -> Selector:
    return Selector(name, "not_null")


def not_blank(name: str) -> Selector:
    return Selector(name, "not_blank")


def not_placeholder(name: str) -> Selector:
    return Selector(name, "not_placeholder")


def use_after_or_null(name: str, since: str) -> Selector:
    return replace(Selector(name), since=since)
