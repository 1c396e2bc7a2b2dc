"""Filters that follow a fan-out: domain scope, freshness, relevance, degraded sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import FRESH_DAYS, strict_date
from ..functions.text import hits, query_terms, specific_terms
from ..functions.url import host_allowed


def in_scope(url: Column, domains: Column, exclude: Column) -> Column:
    """Inside the allowed domains (all, if none are named) and outside the excluded ones."""
    return ((F.size(domains) == 0) | host_allowed(url, domains)) & ~host_allowed(url, exclude)


def is_stale(published: Column, freshness: Column, as_of: Column) -> Column:
    """Whether a document is provably older than its bound; undated ones and those on the boundary day are not."""
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in FRESH_DAYS.items() for x in kv]), freshness)
    return F.coalesce(strict_date(published) < F.date_sub(as_of, days), F.lit(False))


def coverage(query: Column, title: Column, snippet: Column, url: Column) -> Column:
    """The share of a query's distinctive terms that a document shows; null without terms."""
    terms = query_terms(query)
    return F.when(F.size(terms) > 0, hits(terms, haystack(title, snippet, url)) / F.size(terms).cast("double"))


def haystack(title: Column, snippet: Column, url: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, snippet, url)]))


def is_relevant(query: Column, title: Column, snippet: Column, url: Column, floor: float = 0.25) -> Column:
    """Whether a document shows enough of the query's terms; queries of fewer than three are let pass."""
    return (F.size(query_terms(query)) < 3) | (coverage(query, title, snippet, url) >= floor)


def degraded(rows: DataFrame, keys: list[str], query: Column, title: Column, snippet: Column, url: Column, floor: float = 0.34) -> DataFrame:
    """(keys, degraded): whether a source's rows for a query do not seem to answer it."""
    terms = query_terms(query)
    hay = haystack(title, snippet, url)
    special = specific_terms(terms)
    each = rows.select(*keys, F.size(terms).alias("terms"), F.size(special).alias("special"), (hits(special, hay) > 0).cast("double").alias("echo"), (hits(terms, hay) / F.nullif(F.size(terms), F.lit(0)).cast("double")).alias("cover"))
    found = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("terms").alias("terms"), F.max("special").alias("special"), F.avg("echo").alias("echo"), F.avg("cover").alias("cover"))
    low = F.when(F.col("special") > 0, F.col("echo") < floor).otherwise(F.col("cover") < 0.30)
    return found.select(*keys, F.when((F.col("terms") == 0) | (F.col("n") < 3), False).otherwise(low).alias("degraded"))
