"""Dates as sources write them, into ISO text or days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound

# Days by which a document may be older than a bound says, and days of a video's bound.
FRESH_DAYS = {"day": 2, "week": 8, "month": 32, "year": 367}
VIDEO_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
UNIT_DAYS = {"second": 0.0, "minute": 1 / 1440, "hour": 1 / 24, "day": 1.0, "week": 7.0, "month": 30.0, "year": 365.0}


def strict_date(text: Column) -> Column:
    """A date from ``YYYY-MM-DD...``; null for anything less exact."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))


def epoch_to_iso(epoch: Column) -> Column:
    """The UTC date of seconds since 1970; null if they are no number."""
    seconds = epoch.try_cast("double")
    return F.when(seconds.between(-62135596800.0, 253402300799.0), F.date_format(F.date_add(F.to_date(F.lit("1970-01-01")), F.floor(seconds / 86400.0).cast("int")), "yyyy-MM-dd"))


def iso_from_parts(parts: Column) -> Column:
    """[year, month?, day?] as ISO text, completed to the last day they allow; "" if they are no date."""
    year, month, day = (F.get(parts, F.lit(i)).cast("int") for i in range(3))
    full = F.coalesce(month, F.lit(12))
    first = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(full.cast("string"), 2, "0"), F.lit("-01")).try_cast("date")
    last = F.coalesce(day, F.day(F.last_day(first)))
    made = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(full.cast("string"), 2, "0"), F.lit("-"), F.lpad(last.cast("string"), 2, "0")).try_cast("date")
    return F.when(full.between(1, 12) & year.isNotNull(), F.coalesce(F.date_format(made, "yyyy-MM-dd"), F.lit(""))).otherwise("")


def duration_s(text: Column) -> Column:
    """Seconds of ``h:m:s`` or ``m:s``; null without a colon."""
    parts = F.transform(F.split(text, ":"), lambda p: p.try_cast("int"))
    return F.when(text.contains(":"), F.aggregate(parts, F.lit(0), lambda s, p: s * 60 + p))


def age_days(text: Column) -> Column:
    """Days of "3 weeks ago"; 0 for just now or today; null if it says no age."""
    days = F.create_map(*[F.lit(x) for kv in UNIT_DAYS.items() for x in kv])

    def read(words: Column) -> Column:
        ago = F.array_position(words, "ago").cast("int")
        number, unit = F.get(words, ago - 3).try_cast("double"), F.regexp_replace(F.get(words, ago - 2), "s$", "")
        return F.when(ago > 2, number * F.try_element_at(days, unit))

    low = F.lower(text)
    return F.when(low.contains("just now") | low.contains("today"), 0.0).otherwise(bound(F.regexp_extract_all(low, F.lit("[0-9]+|[a-z]+"), F.lit(0)), read))


def views(text: Column) -> Column:
    """"1.2M views" as a number; 0 for none."""
    low = F.lower(text)
    number = F.replace(F.regexp_extract(low, r"([\d.,]+)\s*([kmb]?)", 1), F.lit(","), F.lit("")).try_cast("double")
    scale = F.create_map(F.lit("k"), F.lit(1e3), F.lit("m"), F.lit(1e6), F.lit("b"), F.lit(1e9))
    return F.when(low.startswith("no views"), F.lit(0)).otherwise(F.round(number * F.coalesce(F.try_element_at(scale, F.regexp_extract(low, r"([\d.,]+)\s*([kmb]?)", 2)), F.lit(1.0)))).cast("long")


def rss_date(text: Column) -> Column:
    """The date of an RFC 2822 time as ISO text; "" if it has none."""
    day = F.lpad(F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})", 1), 2, "0")
    names = F.create_map(*[x for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()) for x in (F.lit(m), F.lit(f"{i + 1:02d}"))])
    made = F.concat(F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})", 3), F.lit("-"), F.try_element_at(names, F.regexp_extract(text, r"(\d{1,2}) ([A-Z][a-z]{2}) (\d{4})", 2)), F.lit("-"), day)
    return F.coalesce(F.date_format(made.try_cast("date"), "yyyy-MM-dd"), F.lit(""))
