"""Dates in names, years in texts, and day, week and month bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def name_date(path: Column) -> Column:
    """Struct (date, precision) of the date a file name carries: YYYY-MM-DD or YYYYMMDD or 'Month d, yyyy' by day, YYYY-MM by
    month; an impossible day is no date at all, and a month counts only where nothing has the shape of a day."""
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    dashed = F.regexp_extract(base, r"(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^0-9]|$)", 1)
    plain = F.regexp_extract(base, r"(?:^|[^0-9])((?:19|20)[0-9]{6})(?:[^0-9]|$)", 1)
    name = F.lower(F.regexp_extract(base, r"(?i)(?:^|[^a-z])((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* [0-9]{1,2},? [0-9]{4})", 1))
    month = F.regexp_extract(base, r"(?:^|[^0-9])([0-9]{4}-[0-9]{2})(?:[^0-9-]|$)", 1)
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(name, 1, 3))
    worded = F.concat_ws("-", F.regexp_extract(name, r"([0-9]{4})$", 1), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(name, r" ([0-9]{1,2})", 1), 2, "0"))
    day = F.when(dashed != "", dashed).when(plain != "", F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))).when(name != "", worded)
    parsed = F.try_to_date(day, "yyyy-MM-dd")
    by_month = F.when(day.isNull() & (month != ""), F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd"))
    return F.struct(F.coalesce(parsed, by_month).alias("date"), F.when(parsed.isNotNull(), "day").when(by_month.isNotNull(), "month").alias("precision"))


def month_inside(first: Column, low: Column, high: Column) -> Column:
    """Whether the whole month that begins at ``first`` lies in [low, high]."""
    return (low <= first) & (high >= F.last_day(first))


def years(text: Column) -> Column:
    """Years from 1900 to 2099 mentioned in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?=[^0-9]|$)"), F.lit(1)))


def week_start(day: Column) -> Column:
    return F.to_date(F.date_trunc("week", day))


def month_end(day: Column) -> Column:
    return F.last_day(day)
