"""Dates in clinical notes: parsing, relative ranges, extraction. Results have no time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of record fields, in the order in which they are tried: a pattern that a text must match, and its format.
RECORD_FORMATS = [
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"), (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/y H:mm:ss"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/y H:mm"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"), (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, y"), (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{14}$", "yyyyMMddHHmmss"),
]
#: Formats of dates in running text.
NOTE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-y"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "M-d-yy"),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", "MMMM d y"), (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d y"), (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM y"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM y"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-y"),
    (r"^[A-Za-z]{4,} \d{4}$", "MMMM y"), (r"^[A-Za-z]{3} \d{4}$", "MMM y"),
]
#: Days of the units of relative times; months and years have fixed lengths.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def parse(text: Column, formats: Sequence[tuple[str, str]]) -> Column:
    """The first format that a trimmed text fits gives its timestamp; null if none does. Two-digit years from 69 on are 19xx."""
    cut = F.trim(text)
    plain = F.initcap(F.replace(cut, F.lit(","), F.lit("")))

    def one(pattern: str, form: str) -> Column:
        named = "MMM" in form
        value = (plain if named else F.substring(cut, 1, 19) if "T" in form else cut)
        got = F.try_to_timestamp(value, F.lit(form.replace(",", "") if named else form))
        century = F.when(F.year(got) >= 2069, got - F.expr("INTERVAL 100 YEARS")).otherwise(got) if form.endswith("yy") and not form.endswith("yyyy") else got
        return F.when(cut.rlike(pattern), century)

    return F.coalesce(*(one(p, f) for p, f in formats)).cast("timestamp_ntz")


def record_date(text: Column) -> Column:
    """A timestamp of a record's field by RECORD_FORMATS, at local wall time: offsets are dropped."""
    return parse(text, RECORD_FORMATS)


def note_date(text: Column) -> Column:
    """A date as notes write it, by NOTE_FORMATS; a month alone means its first day."""
    return parse(text, NOTE_FORMATS)


def relative_range(text: Column, reference: Column) -> Column:
    """struct(start, end) of the first phrase like 'last 6 months' or 'past year' up to ``reference``; null without one."""
    numbered = r"(?i)(?:last|past|previous|within(?: the)?)\s+(\d+)\s+(day|week|month|year)s?"
    single = r"(?i)(?:last|past|previous)\s+(day|week|month|year)"
    count = F.regexp_extract(text, numbered, 1)
    unit = F.lower(F.when(count != "", F.regexp_extract(text, numbered, 2)).otherwise(F.regexp_extract(text, single, 1)))
    days = F.create_map(*(F.lit(x) for kv in UNIT_DAYS.items() for x in kv))[unit] * F.when(count != "", count.try_cast("bigint")).otherwise(F.lit(1))
    return F.when(unit != "", F.struct((reference - F.make_dt_interval(days.cast("int"))).alias("start"), reference.alias("end")))


def days_between(a: Column, b: Column) -> Column:
    """Whole days of a - b, rounded down before the sign goes; so a part of a day counts when a is the earlier."""
    seconds = F.unix_timestamp(a.cast("timestamp")) - F.unix_timestamp(b.cast("timestamp"))
    return F.abs(F.floor(seconds / F.lit(86400)))


def extract(text: Column) -> Column:
    """Sorted distinct dates of a text: ISO, month/day/year, and with the month's name."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    iso = F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2})(?:T\d{2}:\d{2}(?::\d{2})?)?\b"), F.lit(1))
    us = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(1))
    named = F.regexp_extract_all(text, F.lit(rf"(?i)\b({month}\s+\d{{1,2}},?\s+\d{{4}})\b"), F.lit(1))
    form = lambda items, f, fix=lambda x: x: F.transform(items, lambda x: F.to_date(F.try_to_timestamp(fix(x), F.lit(f))))
    short = lambda x: F.initcap(F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"(?i)^([a-z]{3})[a-z]*\s+", "$1 "))
    found = F.concat(form(iso, "y-M-d"), form(us, "M/d/y"), form(named, "MMM d y", lambda x: F.regexp_replace(short(x), r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: d.isNotNull())))


def temporal_issues(answer: Column, evidence_dates: Column) -> Column:
    """A line for each date of an answer that the evidence lacks."""
    return F.transform(F.array_except(extract(answer), evidence_dates), lambda d: F.concat(F.lit("Date "), F.date_format(d, "yyyy-MM-dd"), F.lit(" in answer not found in evidence")))
