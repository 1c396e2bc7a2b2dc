"""How a query is put to a source: operators, freshness codes, places, result counts and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound

#: Days that serial dates count from.
_SERIAL_ZERO = "1899-12-30"


def with_operators(text: Column, domains: Column, excluded: Column) -> Column:
    """The text with allowed domains as one alternative and excluded ones each on their own."""
    sites = F.array_join(F.transform(domains, lambda d: F.concat(F.lit("site:"), d)), " OR ")
    without = F.array_join(F.transform(excluded, lambda d: F.concat(F.lit(" -site:"), d)), "")
    return F.concat(text, F.when(F.size(domains) > 0, F.concat(F.lit(" ("), sites, F.lit(")"))).otherwise(""), without)


def freshness_letter(freshness: Column) -> Column:
    """d, w, m or y; "" for any other."""
    return F.when(freshness.isin("day", "week", "month", "year"), F.substring(freshness, 1, 1)).otherwise("")


def freshness_filter(freshness: Column, today: Column) -> Column:
    """The recency filter of an engine that numbers its spans, and writes a year as a range of serial dates."""
    serial = F.date_diff(today, F.to_date(F.lit(_SERIAL_ZERO)))
    year = F.concat(F.lit('ex1:"ez5_'), (serial - 365).cast("string"), F.lit("_"), serial.cast("string"), F.lit('"'))
    return F.when(freshness == "day", 'ex1:"ez1"').when(freshness == "week", 'ex1:"ez2"').when(freshness == "month", 'ex1:"ez3"').when(freshness == "year", year).otherwise("")


def specialist_k(k: Column, ratio: Column) -> Column:
    """How many results a specialist is asked for: a share of k, three at least; all of k where the share is none."""
    return F.when((ratio > 0) & (ratio < 1), F.greatest(F.lit(3), F.ceil(k * ratio).cast("int"))).otherwise(k)


def normal_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def query_key(text: Column, intent: Column, freshness: Column, domains: Column, excluded: Column, k: Column, superset: bool = True) -> Column:
    """The same for all spellings of a question; with ``superset``, for all result counts too (see covers)."""
    bag = lambda hosts: F.array_sort(F.transform(hosts, F.lower))
    return F.to_json(F.struct(normal_text(text).alias("text"), intent.alias("intent"), freshness.alias("freshness"), bag(domains).alias("domains"), bag(excluded).alias("excluded"), (F.lit(0) if superset else k).alias("k")))


def covers(cached_k: Column, asked_k: Column) -> Column:
    """Whether a cached answer holds all that is asked for; its first ``asked_k`` are the answer."""
    return cached_k >= asked_k


def locale_of(tag: Column) -> Column:
    """struct(locale, region) of a language tag, in its canonical spelling; null if it is none, region null if it names none."""
    spelled = F.replace(F.trim(F.coalesce(tag, F.lit(""))), F.lit("_"), F.lit("-"))

    def read(parts: Column) -> Column:
        rest = F.slice(parts, 2, 64)
        title = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 9)))
        canon = lambda p: F.when(p.rlike("^[A-Za-z]{4}$"), title(p)).when(p.rlike(r"^(?:[A-Za-z]{2}|\d{3})$"), F.upper(p)).otherwise(F.lower(p))
        region = F.lower(F.get(F.filter(rest, lambda p: p.rlike("^[A-Za-z]{2}$")), F.lit(0)))
        return F.struct(F.array_join(F.concat(F.array(F.lower(F.get(parts, F.lit(0)))), F.transform(rest, canon)), "-").alias("locale"), region.alias("region"))

    def checked(parts: Column) -> Column:
        sound = F.get(parts, F.lit(0)).rlike("^[A-Za-z]{2,3}$") & F.forall(F.slice(parts, 2, 64), lambda p: p.rlike("^[A-Za-z0-9]{2,8}$"))
        return F.when(sound, read(parts))

    return F.when(F.length(spelled) <= 35, bound(F.split(spelled, "-"), checked))
