"""Dates of the panels: half-years, quarter codes, 14-digit timestamps and their distances.

Defined cases: what is no date gives null; two-digit years from 69 on are of the 1900s.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_year(date: Column) -> Column:
    """Period of a date, like '1998-H1'."""
    return F.concat(F.year(date).cast("string"), F.when(F.month(date) <= 6, F.lit("-H1")).otherwise(F.lit("-H2")))


def half_year_index(date: Column) -> Column:
    """Half-years since year 0."""
    return F.year(date) * 2 + F.when(F.month(date) <= 6, 0).otherwise(1)


def half_year_name(index: Column) -> Column:
    return F.concat(F.floor(index / 2).cast("string"), F.when(index % 2 == 0, F.lit("-H1")).otherwise(F.lit("-H2")))


def half_year_end(index: Column) -> Column:
    """Last day of a half-year."""
    return F.make_date(F.floor(index / 2).cast("int"), F.when(index % 2 == 0, 6).otherwise(12), F.when(index % 2 == 0, 30).otherwise(31))


def period_end(period: Column) -> Column:
    """Last day of a period like '1998-H1'; null for another form."""
    year = F.when(period.rlike(r"^\d{4}-H[12]$"), F.substring(period, 1, 4).cast("int"))
    return F.make_date(year, F.when(F.endswith(period, F.lit("H1")), 6).otherwise(12), F.when(F.endswith(period, F.lit("H1")), 30).otherwise(31))


def snapshot_date(ts: Column) -> Column:
    """Date of a 14-digit timestamp."""
    return F.when(ts.rlike(r"^\d{14}$"), F.try_to_date(F.substring(ts, 1, 8), "yyyyMMdd"))


def day_number(ts: Column) -> Column:
    """YYYYMMDD of a 14-digit timestamp as an integer: not evenly spaced, but that is how distances on it were defined."""
    return F.when(ts.rlike(r"^\d{14}$"), F.substring(ts, 1, 8).cast("int"))


def month_index(year: Column, month: Column) -> Column:
    return year * 12 + month


def quarter_end(code: Column) -> Column:
    """Date of an MMDDYY quarter code; null if it is none."""
    yy = F.substring(code, 5, 2)
    year = F.concat(F.when(yy >= "69", F.lit("19")).otherwise(F.lit("20")), yy)
    return F.when(code.rlike(r"^\d{6}$"), F.try_to_date(F.concat(year, F.substring(code, 1, 4)), "yyyyMMdd"))


def quarter_code(date: Column) -> Column:
    return F.date_format(date, "MMddyy")


def quarter_label(date: Column) -> Column:
    """Like '1999 Q1'."""
    return F.concat(F.year(date).cast("string"), F.lit(" Q"), F.quarter(date).cast("string"))


def file_quarter(name: Column) -> Column:
    """Date of the MMDDYYYY that a file name ends in."""
    got = F.regexp_extract(name, r"(\d{8})(?:\.\w+)?$", 1)
    return F.when(got != "", F.try_to_date(got, "MMddyyyy"))


def name_year(name: Column, first: int = 1900, last: int = 2200) -> Column:
    """Year in the first four characters of a name, if it lies within the bounds."""
    y = F.when(name.rlike(r"^\d{4}"), F.substring(name, 1, 4).cast("int"))
    return F.when(y.between(first, last), y)


def quarter_links(html: Column) -> Column:
    """(yy, mm, link) of the quarter archives that a page links to, as in 'call8403-zip.zip', each once."""
    links = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]*call\d{4}[^"]*\.zip)"'), F.lit(1)))
    return F.transform(links, lambda x: F.struct(F.regexp_extract(x, r"(?i)call(\d{2})\d{2}", 1).alias("yy"), F.regexp_extract(x, r"(?i)call\d{2}(\d{2})", 1).alias("mm"), x.alias("link")))


def quarter_folder(yy: Column, mm: Column) -> Column:
    """MMDDYY of the quarter that ends in a month; null for a month that ends none."""
    last = F.when(mm.isin("03", "12"), "31").when(mm.isin("06", "09"), "30")
    return F.concat(mm, last, yy)
