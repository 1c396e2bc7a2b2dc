"""Captured result pages and feeds of web engines, into rows of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import VIDEO_DAYS, age_days, duration_s, rss_date, views
from ..functions.net import attribute
from ..functions.text import strip_tags, unescaped
from ..functions.url import canonical_url, is_self_redirect
from .objects import objects_column


def unwrap_ddg(href: Column) -> Column:
    """The target of a redirector link on the engine's own host; other links stay."""
    full = F.when(href.startswith("//"), F.concat(F.lit("https:"), href)).otherwise(href)
    target = F.try_url_decode(F.regexp_extract(full, "[?&]uddg=([^&#]*)", 1))
    return F.when(full.rlike(r"(?i)^https?://(?:[^/?#]*\.)?duckduckgo\.com/") & (F.coalesce(target, F.lit("")) != ""), target).otherwise(full)


def unwrap_bing(href: Column) -> Column:
    """The target in a click link: base64url after ``a1``."""
    packed = F.translate(F.regexp_extract(href, "[?&]u=a1([^&#]*)", 1), "-_", "+/")
    padded = F.rpad(packed, ((F.length(packed) + 3) / 4).cast("int") * 4, F.lit("="))
    target = F.decode(F.unbase64(padded), "UTF-8")
    return F.when(href.contains("/ck/a") & (packed != ""), target).otherwise(href)


def _blocks(body: Column, tag: str, word: str) -> Column:
    """The parts of a page that begin with a tag in which a word stands, each to the next."""
    # the blank keeps what precedes the first tag, as a split at the very beginning would leave nothing
    return F.slice(F.split(F.concat(F.lit(" "), body), rf"(?i)(?=<{tag}\b[^<>]*\b{word}\b)"), 2, 1 << 30)


def _opening(block: Column) -> Column:
    return F.regexp_extract(block, "^<[^<>]*+>", 0)


def _inside(html: Column, tag: str) -> Column:
    """What the first element of a name holds; "" without one."""
    return F.regexp_extract(html, rf"(?is)<{tag}\b[^<>]*+>(.*?)(?:</{tag}\b|\z)", 1)


def _behind(html: Column, word: str) -> Column:
    """What the first tag in which a word stands holds, to the end of an anchor, division or cell; "" without one."""
    rest = F.when(html.contains(word), F.substr(html, F.instr(html, word)))
    return F.coalesce(F.get(F.split(F.substr(rest, F.instr(rest, ">") + 1), r"(?i)</(?:a|div|td)\b", 2), F.lit(0)), F.lit(""))


def ddg_html(rows: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, url, title, snippet) of (query_id, body): organic anchors; links back to the engine are dropped."""
    each = rows.select("query_id", F.posexplode(_blocks(F.col("body"), "a", "result__a")).alias("pos", "block"))
    href = F.coalesce(attribute(_opening(F.col("block")), "href"), F.lit(""))
    found = each.select("query_id", "pos", unwrap_ddg(unescaped(href)).alias("url"), strip_tags(_inside(F.col("block"), "a")).alias("title"), strip_tags(_behind(F.col("block"), "result__snippet")).alias("snippet"))
    kept = found.where(F.col("url").rlike("(?i)^https?://") & ~is_self_redirect(F.col("url"), "duckduckgo.com", "/y.js"))
    return _ranked(kept, limit)


def ddg_lite(rows: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, url, title) of the engine's lighter form, which has no snippets."""
    each = rows.select("query_id", F.posexplode(_blocks(F.col("body"), "a", "result-link")).alias("pos", "a"))
    href = F.coalesce(attribute(_opening(F.col("a")), "href"), F.lit(""))
    found = each.select("query_id", "pos", unwrap_ddg(unescaped(href)).alias("url"), strip_tags(_inside(F.col("a"), "a")).alias("title"))
    kept = found.where(F.col("url").rlike("(?i)^https?://") & ~is_self_redirect(F.col("url"), "duckduckgo.com", "/y.js"))
    return _ranked(kept, limit)


def bing(rows: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, rank, url, title, snippet) of answers (query_id, feed, page): the feed's items, and where it has none those of the page."""
    feed = bing_rss(rows.select("query_id", F.col("feed").alias("body")), limit).drop("published")
    bare = rows.join(feed.select("query_id").distinct(), "query_id", "left_anti")
    return feed.unionByName(bing_html(bare.select("query_id", F.col("page").alias("body")), limit).select(feed.columns))


def bing_html(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Organic results only, each page once, captions of at most 300 characters."""
    each = rows.select("query_id", F.posexplode(_blocks(F.col("body"), "li", "b_algo")).alias("pos", "block")).withColumn("head", _inside(F.col("block"), "h2"))
    href = F.coalesce(attribute(F.regexp_extract("head", r"(?i)<a\b[^<>]*+>", 0), "href"), F.lit(""))
    found = each.select("query_id", "pos", unwrap_bing(unescaped(href)).alias("url"), strip_tags(F.col("head")).alias("title"), F.substring(strip_tags(_inside(F.col("block"), "p")), 1, 300).alias("snippet"))
    kept = found.where(F.col("url").rlike("(?i)^https?://"))
    once = kept.groupBy("query_id", canonical_url(F.col("url")).alias("page")).agg(F.min(F.struct("pos", "url", "title", "snippet")).alias("one"))
    return _ranked(once.select("query_id", "one.*"), limit)


def bing_rss(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Items of a feed, CDATA or not, with ISO dates."""
    items = F.regexp_extract_all("body", F.lit(r"(?is)<item>(.*?)(?:</item>|\z)"), F.lit(1))
    each = rows.select("query_id", F.posexplode(items).alias("pos", "item"))
    plain = lambda tag: F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}\b[^<>]*+>(.*?)(?:</{tag}>|\z)", 1), r"^\s*<!\[CDATA\[|\]\]>\s*$", "")
    found = each.select("query_id", "pos", F.trim(unescaped(plain("link"))).alias("url"), strip_tags(plain("title")).alias("title"), F.substring(strip_tags(plain("description")), 1, 300).alias("snippet"), rss_date(plain("pubDate")).alias("published"))
    return _ranked(found.where(F.col("url").rlike("(?i)^https?://")), limit)


def _ranked(rows: DataFrame, limit: int | None = None) -> DataFrame:
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("pos")) - 1
    ranked = rows.withColumn("rank", rank).drop("pos")
    return ranked if limit is None else ranked.where(F.col("rank") < limit)


def video_cards(rows: DataFrame) -> DataFrame:
    """(query_id, rank, url, title, channel, age_days, seconds, views, live, shorts, snippet) of the videos in a result page's initial data: all of them, each once; short ones after the others.

    A live video has no age but 0.
    """
    cards = lambda mark, shorts: F.transform(objects_column(F.col("body"), mark), lambda c, i: F.named_struct(F.lit("shorts"), F.lit(shorts), F.lit("pos"), i, F.lit("card"), c))
    text = "struct<simpleText:string,runs:array<struct<text:string>>>"
    shape = f"videoId string, title {text}, headline {text}, ownerText {text}, publishedTimeText {text}, lengthText {text}, viewCountText {text}, badges array<struct<metadataBadgeRenderer:struct<label:string>>>"
    each = rows.select("query_id", F.inline(F.concat(cards('"videoRenderer":', False), cards('"reelItemRenderer":', True)))).select("query_id", F.struct("shorts", "pos").alias("pos"), F.from_json("card", shape).alias("v")).where("v.videoId IS NOT NULL")
    once = each.groupBy("query_id", "v.videoId").agg(F.min("pos").alias("pos"), F.min(F.struct("pos", "v"))["v"].alias("v"))
    said = lambda c: F.coalesce(F.col(f"v.{c}.simpleText"), F.array_join(F.transform(F.col(f"v.{c}.runs"), lambda r: r["text"]), ""))
    live = F.coalesce(said("viewCountText").endswith("watching"), F.lit(False)) | F.coalesce(F.exists("v.badges", lambda b: b["metadataBadgeRenderer"]["label"] == "LIVE"), F.lit(False))
    snippet = F.substring(F.concat_ws(" · ", *[F.nullif(said(c), F.lit("")) for c in ("ownerText", "viewCountText", "publishedTimeText", "lengthText")]), 1, 500)
    found = once.select(
        "query_id", "pos", F.concat(F.lit("https://www.youtube.com/watch?v="), F.col("videoId")).alias("url"), F.substring(F.coalesce(said("title"), said("headline")), 1, 400).alias("title"), said("ownerText").alias("channel"), F.when(live, 0.0).otherwise(age_days(said("publishedTimeText"))).alias("age_days"),
        duration_s(said("lengthText")).alias("seconds"), views(said("viewCountText")).alias("views"), live.alias("live"), F.col("pos.shorts").alias("shorts"), snippet.alias("snippet"),
    )
    return _ranked(found)


def fresh_videos(videos: DataFrame, freshness: Column) -> DataFrame:
    """The videos (age_days) that are not older than a bound; those of unknown age stay."""
    most = F.try_element_at(F.create_map(*[F.lit(x) for pair in VIDEO_DAYS.items() for x in pair]), freshness)
    return videos.where(F.coalesce(F.col("age_days") <= most, F.lit(True)))


def feed_gated(answers: DataFrame) -> DataFrame:
    """(query_id, gated) of answers (query_id, body): a marketplace page whose feed is there and holds nothing, as it is shown to visitors who are not let in."""
    feed = F.regexp_extract("body", r'"feed_units"\s*:\s*(null|\{\s*"edges"\s*:\s*\[\s*\])', 1)
    return answers.select("query_id", (F.col("body").contains('"marketplace_search"') & (feed != "")).alias("gated"))
