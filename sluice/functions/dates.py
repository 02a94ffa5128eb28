"""Dates and times as Column expressions; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as v
from .text import c, clean_text, filled, let


_DAY_FIRST = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$"
_YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"


def parse_date(x: Column | str) -> Column:
    """Day, month and year in figures (one separator throughout) or with the month's name; null if neither fits."""
    t = F.regexp_replace(clean_text(x), r"(?i)(\d)(st|nd|rd|th)\b", "$1")
    return let(F.replace(t, F.lit(","), F.lit("")), _date_of)


def _date_of(t: Column) -> Column:
    day_first, year_first = F.regexp_replace(t, _DAY_FIRST, "$4-$3-$1"), F.regexp_replace(t, _YEAR_FIRST, "$1-$3-$4")
    return (
        F.when(t.rlike(_DAY_FIRST), F.try_to_date(day_first, "yyyy-M-d"))
        .when(t.rlike(_YEAR_FIRST), F.try_to_date(year_first, "yyyy-M-d"))
        .when(t.rlike("[A-Za-z]"), F.coalesce(*[F.try_to_date(t, p) for p in v.NAMED_DATE_PATTERNS]))
    )


def iso_or_parsed(x: Column | str) -> Column:
    """First ten characters as an ISO date, else parse_date of all."""
    t = clean_text(x)
    head = F.substring(t, 1, 10)
    return F.coalesce(F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd")), parse_date(t))


def iso_date(x: Column | str) -> Column:
    """An ISO 8601 calendar or week date, with hyphens throughout or none: 2024-01-31, 20240131, 2024-W05-3, 2024W05; null for anything else.

    A week without a day is its Monday.
    """
    t = c(x)
    year, week = F.substring(t, 1, 4).cast("int"), F.try_to_number(F.nullif(F.regexp_extract(t, r"W(\d{2})", 1), F.lit("")), F.lit("99")).cast("int")
    day = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, r"W\d{2}-?(\d)$", 1), F.lit("")), F.lit("9")).cast("int"), F.lit(1))
    weeks = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    of_week = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), (week - 1) * 7 + day - 1)
    found = (
        F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd")).when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd"))
        .when(t.rlike(r"^(\d{4}-W\d{2}(-\d)?|\d{4}W\d{2}\d?)$") & (year > 0) & week.between(1, weeks) & day.between(1, 7), of_week)
    )
    return F.when(~t.startswith("0000"), found)


def form_date(x: Column | str) -> Column:
    """struct(value, problem) of a form's ISO date: blank is no date; what is no ISO date names the problem."""
    t = F.trim(filled(x))
    value = iso_date(t)
    problem = F.when((t != "") & value.isNull(), F.concat(F.lit("Invalid isoformat string: "), t))
    return F.struct(value.alias("value"), problem.alias("problem"))


def extract_deadline(x: Column | str, patterns=v.CRAWL_DEADLINES) -> Column:
    """Of each pattern the first match; of these, in pattern order, the first that is a date."""

    def first(t: Column) -> Column:
        # Nothing is looked for once a date is found.
        return F.coalesce(*[let(F.regexp_extract(t, f"(?i){p}", 1), lambda m: F.when(m != "", parse_date(m))) for p in patterns])

    return let(clean_text(x), first)


#: Date, any one character, time of day with or without colons, zone.
_ISO_TIME = (
    r"^(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
    r"(?:(?s:.)(\d{2})(?:(:?)(\d{2})(?:\3(\d{2})(?:[.,](\d+))?)?)?(?:(Z)|([+-])(\d{2})(?:(:?)(\d{2})(?:\10(\d{2})(?:\.(\d+))?)?)?)?)?$"
)


def parse_timestamp(x: Column | str) -> Column:
    """ISO 8601 date or timestamp, UTC if it names no zone; null for anything else: neither a clock time nor a year alone is one."""

    def read(t: Column) -> Column:
        number = lambda i: F.coalesce(F.nullif(F.regexp_extract(t, _ISO_TIME, i), F.lit("")).cast("long"), F.lit(0).cast("long"))
        micros = lambda i: F.rpad(F.substring(F.regexp_extract(t, _ISO_TIME, i), 1, 6), 6, "0").cast("long")
        hour, minute, second, off_h, off_m, off_s = (number(i) for i in (2, 4, 5, 9, 11, 12))
        day = F.unix_date(iso_date(F.regexp_extract(t, _ISO_TIME, 1)))
        offset = (off_h * 3600 + off_m * 60 + off_s) * 1_000_000 + micros(13)
        at = ((day * 24 + hour) * 60 + minute) * 60_000_000 + second * 1_000_000 + micros(6)
        right = (hour < 24) & (minute < 60) & (second < 60) & (off_h < 24) & (off_m < 60) & (off_s < 60)
        zoned = at - F.when(F.regexp_extract(t, _ISO_TIME, 8) == "-", -offset).otherwise(offset)
        return F.when(t.rlike(_ISO_TIME) & right, F.timestamp_micros(zoned))

    return let(filled(x), read)


def is_expired(deadline: Column | str, as_of: Column) -> Column:
    return F.coalesce(c(deadline) < as_of, F.lit(False))


def is_due(last: Column | str, interval_hours: Column | int, now: Column) -> Column:
    """Never run, or the interval has passed (inclusive)."""
    hours = interval_hours if isinstance(interval_hours, Column) else F.lit(interval_hours)
    return c(last).isNull() | (now >= c(last) + F.make_dt_interval(F.lit(0), hours.cast("int")))


def scan_due(last: Column | str, interval_hours: Column | str, now: Column, default: int = 24) -> Column:
    """is_due with null and 0 hours taken as the default."""
    return is_due(last, F.coalesce(F.nullif(c(interval_hours), F.lit(0)), F.lit(default)), now)


def job_due(success: Column | str, failure: Column | str, interval_hours: int, now: Column, retry_hours: int = 6) -> Column:
    """Due by interval, or sooner by retry when a failure came after the last success."""
    s, f = c(success), c(failure)
    step, retry = (F.make_dt_interval(F.lit(0), F.lit(h)) for h in (interval_hours, retry_hours))
    return (
        F.when(s.isNull() & f.isNull(), True)
        .when(s.isNull(), now >= f + retry)
        .when(f > s, now >= F.least(s + step, f + retry))
        .otherwise(now >= s + step)
    )


def long_date(x: Column | str) -> Column:
    return F.date_format(c(x), "dd MMMM yyyy")


def short_date(x: Column | str) -> Column:
    return F.date_format(c(x), "dd MMM yyyy")
