"""Folders of captured answers as a source, read by Spark and parsed by who gave them.

A capture is a file under ``provider=P/day=YYYY-MM-DD/query=N`` of a root, in any store that Spark reads; Spark
writes such folders itself (``write.partitionBy("provider", "day", "query").text``). All three are partitions, so
filters on them name the folders that are read, and a body is read only where it is used. Every provider's
parser makes the same row, refusals apart.

A folder a query costs a file made, moved and listed each, so what Spark itself captures is packed: ``pack`` writes
tables under ``provider=P/day=YYYY-MM-DD`` whose rows are captures, and ``packed`` reads them. Filters on provider and
day name folders there, too; the files grow with the bytes and not with the number of queries.

Several files of one query, and the same query on several days, are captures of their own. Empty files give
no results; folders of unknown providers are shown by ``captures`` and left out by ``answers``; a root
without a capture gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import apis, serp

LAYOUT = ["provider", "day", "query"]
PACKED = ["provider", "day"]


def captures(spark: SparkSession, root: str) -> DataFrame:
    """(provider, day, query, body) of all captures."""
    read = spark.read.schema("body string, provider string, day date, query long").text(root, wholetext=True)
    return read.select(*LAYOUT, "body")


def pack(rows: DataFrame, root: str) -> None:
    """Writes captures (provider, day, query, body) under a root, many to a file."""
    rows.select(*LAYOUT, "body").write.partitionBy(*PACKED).parquet(root)


def packed(spark: SparkSession, root: str) -> DataFrame:
    """(provider, day, query, body) of all packed captures."""
    read = spark.read.schema("query long, body string, provider string, day date").parquet(root)
    return read.select(*LAYOUT, "body")


#: Providers and what reads their answers: (query_id, body) into documents; refusals are rows without a URL.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "wikipedia": apis.wikipedia, "hackernews": apis.hackernews, "github": apis.github, "marginalia": apis.marginalia, "stackexchange": apis.stackexchange, "crossref": apis.crossref, "openalex": apis.openalex, "arxiv": apis.arxiv,
    "ddg": serp.ddg_html, "ddg_lite": serp.ddg_lite, "bing": serp.bing_html, "bing_rss": serp.bing_rss,
}


def answers(found: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """(provider, day, query, rank, url, title, snippet, published, refusal) of captures of known providers, or some of them."""
    wanted = [p for p in PARSERS if providers is None or p in providers]
    texts = ("url", "title", "snippet", "published", "refusal")

    def of(provider: str) -> DataFrame:
        # parsers key by query_id and hand it on as it is, so what names a capture goes in one value
        rows = found.where(F.col("provider") == provider).select(F.struct(F.monotonically_increasing_id().alias("capture"), "day", "query").alias("query_id"), "body")
        made = PARSERS[provider](rows)
        shown = [F.col(c) if c in made.columns else F.lit(None if c == "refusal" else "").alias(c) for c in texts]
        return made.select(F.lit(provider).alias("provider"), "query_id.day", "query_id.query", F.col("rank").cast("long").alias("rank"), *[c.cast("string") for c in shown])

    return functools.reduce(DataFrame.unionByName, map(of, wanted))
