"""Partial-precision dates: classification, scopes and periods, as column expressions.

A written date is matched against WRITTEN, a table of forms. Each form says how the first
and the last day that it covers are spelled from the parts of the text; a form whose days
do not exist, or lie in the wrong order, does not match.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtext.functions.text import bound


class Form(NamedTuple):
    """A way to write a date: its precision, its parts, and its first and last day."""

    precision: str
    parts: str
    first: str
    last: str


YEAR, MONTH, DAY = r"(\d{4})", r"(\d\d)", r"(\d\d)"
CLOCK = r"\d\d:\d\d:\d\d(?:[.]\d{1,6})?"
ZONE = r"(?:Z|[-+]\d\d:?\d\d)"
#: `$1` to `$3` are the parts; an end of `$1-$2-?` is the month's last day.
WRITTEN = (
    Form("instant", f"{YEAR}-{MONTH}-{DAY}[ T]{CLOCK}{ZONE}", "$1-$2-$3", "$1-$2-$3"),
    Form("year_range", f"{YEAR}[-/–]{YEAR}", "$1-01-01", "$2-12-31"),
    Form("day", f"{YEAR}-{MONTH}-{DAY}", "$1-$2-$3", "$1-$2-$3"),
    Form("month", f"{YEAR}-{MONTH}", "$1-$2-01", "$1-$2-?"),
    Form("year", YEAR, "$1-01-01", "$1-12-31"),
)


def _spelled(text: Column, form: Form, day: str) -> Column:
    """The day that a form's spelling gives for a text; null where there is no such day."""
    whole = f"^{form.parts}$"
    if day.endswith("?"):
        return F.last_day(F.regexp_replace(text, whole, day[:-1] + "01").try_cast("date"))
    return F.regexp_replace(text, whole, day).try_cast("date")


def exact_utc(value: Column) -> Column:
    """An instant that names its zone, as a timestamp; else null."""
    text, form = F.trim(value), WRITTEN[0]
    colon = F.concat(F.substr(text, F.lit(1), F.length(text) - 2), F.lit(":"), F.right(text, F.lit(2)))
    iso = F.when(text.endswith("Z") | (F.substr(text, F.length(text) - 2, F.lit(1)) == ":"), text).otherwise(colon)
    return F.when(text.rlike(f"^{form.parts}$"), iso.try_cast("timestamp"))


def calendar_parts(value: Column) -> Column:
    """Struct precision, start, end, year of a written date.

    Precision is day, month, year, year_range, instant (with the writer's own day),
    unknown (null or blank) or invalid. A range has no year.
    """
    text = F.trim(value)
    read = F.lit(None).cast("struct<precision:string,start:date,end:date,year:bigint>")
    for form in reversed(WRITTEN):
        first, last = _spelled(text, form, form.first), _spelled(text, form, form.last)
        fits = text.rlike(f"^{form.parts}$") & (first <= last)
        if form.precision == "instant":
            fits = fits & exact_utc(text).isNotNull()
        year = F.lit(None) if form.precision == "year_range" else F.year(first)
        read = F.when(fits, F.struct(F.lit(form.precision).alias("precision"), first.alias("start"), last.alias("end"), year.cast("long").alias("year"))).otherwise(read)
    nothing = F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise("invalid")
    bare = F.struct(nothing.alias("precision"), F.lit(None).cast("date").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(None).cast("long").alias("year"))
    return F.coalesce(read, bare)


def window_scope(start: Column, end: Column, first: Column, last: Column) -> Column:
    """verified if the interval lies in the window, outside if apart, pending if it straddles."""
    apart, within = (end < first) | (last < start), (first <= start) & (end <= last)
    known = start.isNotNull() & end.isNotNull()
    return F.when(known & apart, "outside").when(known & within, "verified").otherwise("pending")


def scope_utc(value: Column, first: Column, last: Column) -> Column:
    """The same by the UTC day: included, outside, uncertain, missing or invalid."""
    words = F.create_map(*map(F.lit, ("verified", "included", "outside", "outside", "pending", "uncertain")))
    absent = F.create_map(*map(F.lit, ("unknown", "missing", "invalid", "invalid")))

    def scope(read: Column) -> Column:
        start, end = F.coalesce(read["utc"], read["parts"]["start"]), F.coalesce(read["utc"], read["parts"]["end"])
        return F.coalesce(F.try_element_at(absent, read["parts"]["precision"]), F.try_element_at(words, window_scope(start, end, first, last)))

    return bound(F.struct(calendar_parts(value).alias("parts"), F.to_date(exact_utc(value)).alias("utc")), scope)


def placeholder_year(value: Column) -> Column:
    """Precision with the first of January read as a bare year."""

    def precision(parts: Column) -> Column:
        opens = (F.month(parts["start"]) == 1) & (F.dayofmonth(parts["start"]) == 1)
        return F.when((parts["precision"] == "day") & opens, "year").otherwise(parts["precision"])

    return bound(calendar_parts(value), precision)


def month_index(day: Column) -> Column:
    """Months since year 0."""
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def scope_days(day: Column, first: Column, last: Column) -> Column:
    """Days of the day's month that lie between first and last."""
    begin, end = F.greatest(F.trunc(day, "month"), first), F.least(F.last_day(day), last)
    return F.greatest(F.lit(0), F.datediff(end, begin) + 1)


def period(day: Column, unit: str) -> Column:
    """First day of the month, quarter, year or decade."""
    if unit == "decade":
        return F.make_date((F.floor(F.year(day) / 10) * 10).cast("int"), F.lit(1), F.lit(1))
    return F.trunc(day, unit)
