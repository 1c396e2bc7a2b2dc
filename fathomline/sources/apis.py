"""Captured JSON and Atom answers of search APIs, into one schema of documents.

Every reader takes (query_id, body) and gives (query_id, provider, rank, url, title, snippet,
published, refusal). An answer without its results is one row with a refusal and no document; an
empty answer is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import epoch_to_iso, iso_from_parts
from ..functions.text import strip_tags


def _documents(rows: DataFrame, provider: str, results: Column, message: Column, document) -> DataFrame:
    """results: array column, null for a refusal; document: element -> (url, title, snippet, published)."""
    read = rows.select("query_id", results.alias("found"), F.substring(F.coalesce(message, F.lit("no results in response")), 1, 150).alias("refusal"))
    refused = read.where("found IS NULL").select("query_id", F.lit(provider).alias("provider"), *[F.lit(None).cast(t).alias(n) for n, t in (("rank", "int"), ("url", "string"), ("title", "string"), ("snippet", "string"), ("published", "string"))], "refusal")
    each = read.where("found IS NOT NULL").select("query_id", F.posexplode("found").alias("rank", "one"))
    url, title, snippet, published = document(F.col("one"))
    docs = each.select("query_id", F.lit(provider).alias("provider"), "rank", url.alias("url"), title.alias("title"), snippet.alias("snippet"), published.alias("published"), F.lit(None).cast("string").alias("refusal"))
    return docs.where(F.coalesce("url", F.lit("")) != "").unionByName(refused)


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def wikipedia(rows: DataFrame, site: str = "https://en.wikipedia.org/wiki/") -> DataFrame:
    body = F.from_json("body", "query struct<search:array<struct<title:string,snippet:string,timestamp:string>>>, error struct<code:string,info:string>")
    return _documents(rows, "wikipedia", body["query"]["search"], F.coalesce(body["error"]["info"], body["error"]["code"]), lambda d: (F.concat(F.lit(site), F.replace(d["title"], F.lit(" "), F.lit("_"))), d["title"], strip_tags(_or_empty(d["snippet"])), F.substring(_or_empty(d["timestamp"]), 1, 10)))


def hackernews(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "hits array<struct<objectID:string,url:string,title:string,story_title:string,story_text:string,comment_text:string,created_at:string>>, message string")
    return _documents(rows, "hackernews", body["hits"], body["message"], lambda d: (F.coalesce(F.nullif(d["url"], F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), d["objectID"])), _or_empty(F.coalesce(d["title"], d["story_title"])), F.substring(strip_tags(_or_empty(F.coalesce(d["story_text"], d["comment_text"]))), 1, 300), F.substring(_or_empty(d["created_at"]), 1, 10)))


def github(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "items array<struct<html_url:string,full_name:string,description:string,pushed_at:string>>, message string")
    return _documents(rows, "github", body["items"], body["message"], lambda d: (d["html_url"], d["full_name"], F.substring(_or_empty(d["description"]), 1, 300), F.substring(_or_empty(d["pushed_at"]), 1, 10)))


def marginalia(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "results array<struct<url:string,title:string,description:string>>, error string, message string")
    return _documents(rows, "marginalia", body["results"], F.coalesce(body["error"], body["message"]), lambda d: (d["url"], strip_tags(_or_empty(d["title"])), F.substring(strip_tags(_or_empty(d["description"])), 1, 300), F.lit("")))


def stackexchange(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "items array<struct<link:string,title:string,excerpt:string,creation_date:long>>, error_message string, error_name string")
    return _documents(rows, "stackexchange", body["items"], F.coalesce(body["error_message"], body["error_name"]), lambda d: (d["link"], strip_tags(_or_empty(d["title"])), F.substring(strip_tags(_or_empty(d["excerpt"])), 1, 300), _or_empty(epoch_to_iso(d["creation_date"]))))


def crossref(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "status string, message struct<items:array<struct<URL:string,title:array<string>,abstract:string,issued:struct<`date-parts`:array<array<int>>>>>>")
    return _documents(rows, "crossref", body["message"]["items"], body["status"], lambda d: (F.when(strip_tags(_or_empty(F.get(d["title"], F.lit(0)))) != "", d["URL"]), strip_tags(_or_empty(F.get(d["title"], F.lit(0)))), F.substring(strip_tags(_or_empty(d["abstract"])), 1, 400), iso_from_parts(F.get(d["issued"]["date-parts"], F.lit(0)))))


def abstract_of(index: Column) -> Column:
    """An abstract from its inverted index (word to places)."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def openalex(rows: DataFrame) -> DataFrame:
    body = F.from_json("body", "results array<struct<id:string,doi:string,title:string,display_name:string,publication_date:string,publication_year:int,primary_location:struct<landing_page_url:string>,abstract_inverted_index:map<string,array<int>>>>, error string, message string")
    year = lambda d: F.when(d["publication_year"].isNotNull(), iso_from_parts(F.array(d["publication_year"]))).otherwise("")
    return _documents(rows, "openalex", body["results"], F.coalesce(body["message"], body["error"]), lambda d: (F.coalesce(d["primary_location"]["landing_page_url"], d["doi"], d["id"]), _or_empty(F.coalesce(d["title"], d["display_name"])), F.substring(_or_empty(abstract_of(d["abstract_inverted_index"])), 1, 400), F.coalesce(F.nullif(d["publication_date"], F.lit("")), year(d))))


def arxiv(rows: DataFrame) -> DataFrame:
    """Atom: a body without a feed, or with one entry of the error namespace, is a refusal."""
    entries = F.regexp_extract_all("body", F.lit(r"(?s)<entry>(.*?)(?:</entry>|\z)"), F.lit(1))
    good = F.col("body").contains("<feed") & ~((F.size(entries) == 1) & F.get(entries, F.lit(0)).contains("api/errors"))
    part = lambda e, tag: strip_tags(F.regexp_extract(e, rf"(?s)<{tag}\b[^<>]*+>(.*?)(?:</{tag}>|\z)", 1))
    return _documents(rows, "arxiv", F.when(good, entries), F.lit("arxiv refused"), lambda e: (part(e, "id"), part(e, "title"), F.substring(part(e, "summary"), 1, 400), F.substring(part(e, "published"), 1, 10)))


def quota_hold(body: Column, least: float = 3600.0) -> Column:
    """Seconds for which an answer asks to be left alone: its backoff, and ``least`` at least where its quota is used up; null if it asks nothing."""
    said = F.from_json(body, "backoff double, quota_remaining long")
    return F.when(said["quota_remaining"] == 0, F.greatest(F.lit(least), F.coalesce(said["backoff"], F.lit(0.0)))).otherwise(said["backoff"])
