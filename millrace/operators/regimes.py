"""Balance-sheet items whose source fields change with the date, and the check that they sum up.

A regime table says which field codes make an item in which span of quarters. Every code has a consolidated
and a domestic field; the first counts unless it is null or zero and the second is neither. Items of a record
are then the sum of the codes whose regime holds at its date.

Defined cases: a field the file lacks is null; a code without value counts as zero where sums skip nulls, and
makes its item null where they do not; a date in no regime of an item gives zero (or null).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.operators.rules import number

# fixed values: item, first and last quarter end ('' for open), field codes
REGIMES = [
    ("cash", "", "", ["0081", "0071"]),
    ("securities", "", "2018-12-31", ["1754"]),
    ("securities", "2019-03-31", "", ["JJ34"]),
    ("securities", "", "", ["1773"]),
    ("securities", "2018-03-31", "", ["JA22"]),
    ("funds_sold", "", "1996-09-30", ["1350"]),
    ("funds_sold", "1996-12-31", "1996-12-31", ["0276", "0277"]),
    ("funds_sold", "1997-03-31", "2001-12-31", ["1350"]),
    ("funds_sold", "2002-03-31", "", ["B987", "B989"]),
    ("loans", "", "2000-12-31", ["2125"]),
    ("loans", "2001-03-31", "", ["B529", "5369"]),
    ("trading", "", "", ["3545"]),
    ("premises", "", "", ["2145"]),
    ("real_estate", "", "", ["2150"]),
    ("stakes", "", "", ["2130"]),
    ("item_9", "", "2005-12-31", ["2155"]),
    ("item_9", "2009-06-30", "", ["3656"]),
    ("intangibles", "", "2000-12-31", ["2143"]),
    ("intangibles", "2001-03-31", "2018-03-31", ["3163", "0426"]),
    ("intangibles", "2018-06-30", "", ["2143"]),
    ("other", "", "", ["2160"]),
]
TOTAL = "2170"
ITEMS = list(dict.fromkeys(r[0] for r in REGIMES))


def prefer(a: Column, b: Column) -> Column:
    """a, or b where a is null or zero and b is neither."""
    return F.when((a.isNull() | (a == 0)) & b.isNotNull() & (b != 0), b).otherwise(a)


def largest(a: Column, b: Column) -> Column:
    """The greater of two, the other where one is null."""
    return F.greatest(a, b)


def field(values: Column, code: str) -> Column:
    """Preferred value of a code from a map of field to text."""
    get = lambda side: number(F.try_element_at(values, F.lit(side + code)))
    return prefer(get("RCFD"), get("RCON"))


def _table(rows: list) -> Column:
    """The regimes as an array of (first, last, code)."""
    day = lambda d: F.lit(d or None).cast("date")
    return F.array(*[F.struct(day(first).alias("first"), day(last).alias("last"), F.lit(c).alias("code")) for _, first, last, codes in rows for c in codes])


def _held(rows: list, date: Column) -> Column:
    """Codes whose regime holds at a date."""
    held = F.filter(_table(rows), lambda r: (r["first"].isNull() | (date >= r["first"])) & (r["last"].isNull() | (date <= r["last"])))
    return F.transform(held, lambda r: r["code"])


def item(values: Column, name: str, date: Column, skip_nulls: bool = True) -> Column:
    """One item of a record at a date.

    The regime table is an array that each record filters and folds: as many expressions as regimes would
    outgrow what one generated method may hold.
    """

    def value(code: Column) -> Column:
        get = lambda side: number(F.try_element_at(values, F.concat(F.lit(side), code)))
        v = prefer(get("RCFD"), get("RCON"))
        return F.coalesce(v, F.lit(0.0)) if skip_nulls else v

    return F.aggregate(_held([r for r in REGIMES if r[0] == name], date), F.lit(0.0), lambda total, code: total + value(code))


def missing_codes(names: Column, date: Column) -> Column:
    """Codes a regime asks for at the date of which the file has neither field."""
    lacks = F.filter(_held(REGIMES, date), lambda c: ~F.array_contains(names, F.concat(F.lit("RCFD"), c)) & ~F.array_contains(names, F.concat(F.lit("RCON"), c)))
    return F.array_distinct(lacks)
