"""Marketplace cards in rendered pages, and the products behind a fan-out's links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.money import parse_price
from ..functions.net import attribute
from ..functions.text import strip_tags
from ..functions.url import canonical_url, domain_allowed, is_product_url, netloc_of
from .listings import jsonld_items

# Words of a card that are no part of its title.
FREE, DELIVERY = ["free", "gratis"], ["ships to you", "local pickup", "delivery available"]


def is_price(span: Column) -> Column:
    return span.rlike(r"^[A-Z]{0,3}[$€£]\s?\d[\d,.]*$") | F.lower(F.trim(span)).isin(FREE)


def is_place(span: Column) -> Column:
    """City, region: the tail of at most three words, without digits."""
    return span.rlike(r"^[A-Z][^,]*, [A-Z][A-Za-z.\-]*(?: [A-Za-z.\-]+){0,2}$") & ~F.substring_index(span, ",", -1).rlike(r"\d")


def price_of(span: Column) -> Column:
    return F.when(F.lower(F.trim(span)).isin(FREE), 0.0).otherwise(parse_price(span)["amount"])


def card_fields(spans: Column) -> Column:
    """struct(badges, price, was, title, place, delivery) of a card's texts in reading order.

    The first price tells the rest apart: before it stand badges, after it the title, and behind that a place and a delivery note in either order.
    """
    at = F.array_position(F.transform(spans, is_price), True).cast("int")
    after = F.when(at > 0, F.filter(F.slice(spans, at + 1, F.greatest(F.size(spans), F.lit(1))), lambda s: ~is_price(s))).otherwise(spans)
    prices = F.filter(spans, is_price)
    tail = lambda n: F.try_element_at(after, F.lit(-n))
    noted = lambda s: F.lower(F.trim(s)).isin(DELIVERY)
    pick = lambda test, other: F.when(test(tail(1)), tail(1)).when(other(tail(1)) & test(tail(2)), tail(2))
    place, delivery = pick(is_place, noted), pick(noted, is_place)
    cut = F.when(place.isNotNull(), 1).otherwise(0) + F.when(delivery.isNotNull(), 1).otherwise(0)
    badges = F.when(at > 1, F.slice(spans, 1, F.greatest(at - 1, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    title = F.array_join(F.slice(after, 1, F.greatest(F.size(after) - cut, F.lit(0))), " ")
    return F.struct(badges.alias("badges"), F.get(prices, F.lit(0)).alias("price"), F.get(prices, F.lit(1)).alias("was"), title.alias("title"), place.alias("place"), delivery.alias("delivery"))


def dom_cards(pages: DataFrame) -> DataFrame:
    """(page_id, pos, identity, url, title, amount, was, availability, condition, place, delivery) of the cards of rendered pages (page_id, html), each item once.

    An anchor without a title (around a picture) does not claim its item. One that is never closed ends where the next begins.
    """
    # each anchor's text is read once: it ends at the next tag of an anchor, whichever that is
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^<>]*+>(?:(?!</?a\b).)*+"), F.lit(0))
    leads = F.coalesce(attribute(F.regexp_extract("a", "^<[^<>]*+>", 0), "href"), F.lit(""))
    each = pages.select("page_id", F.posexplode(anchors).alias("pos", "a")).withColumn("item", F.regexp_extract(leads, r"/marketplace/item/(\d++)", 1)).where("item <> ''")
    texts = F.filter(F.transform(F.regexp_extract_all("a", F.lit(r"(?is)<span\b[^<>]*+>([^<]*+)"), F.lit(1)), strip_tags), lambda s: s != "")
    read = each.select("page_id", "pos", "item", texts.alias("spans")).withColumn("f", card_fields(F.col("spans"))).where("f.title <> ''")
    once = read.groupBy("page_id", "item").agg(F.min(F.struct("pos", "f")).alias("c"))
    status = F.transform("c.f.badges", lambda b: F.lower(F.trim(b)))
    availability = F.when(F.array_contains(status, "sold"), "SoldOut").when(F.array_contains(status, "pending"), "Pending").otherwise("InStock")
    condition = F.array_join(F.filter("c.f.badges", lambda b: ~F.lower(F.trim(b)).isin("sold", "pending")), ", ")
    return once.select("page_id", "c.pos", F.concat(F.lit("fbmp:"), "item").alias("identity"), F.concat(F.lit("https://www.facebook.com/marketplace/item/"), "item", F.lit("/")).alias("url"), F.substring("c.f.title", 1, 400).alias("title"),
                       price_of(F.col("c.f.price")).alias("amount"), price_of(F.col("c.f.was")).alias("was"), availability.alias("availability"), F.substring(condition, 1, 120).alias("condition"), "c.f.place", "c.f.delivery")


def with_payload(payload: DataFrame, cards: DataFrame) -> DataFrame:
    """The listings of a page's payload, and after them the cards whose items it lacks. Both: (page_id, pos, identity, title, amount)."""
    columns = ["page_id", "pos", "identity", "title", "amount"]
    rest = cards.join(payload, ["page_id", "identity"], "left_anti")
    return payload.select(*columns, F.lit("payload").alias("found_in")).unionByName(rest.select(*columns, F.lit("card").alias("found_in")))


def find_items(docs: DataFrame, pages: DataFrame, domains: Column, most: int = 8, parts: int | None = None) -> DataFrame:
    """(query_id, url, title, amount, currency, own): the products behind the links of a fan-out.

    docs (query_id, place, url, title): the first ``most`` product pages of the allowed domains of each
    query; pages (page_id, url, html): captured pages, met by canonical URL. Of a page that holds nodes with
    its own URL only those count. A link whose page gave nothing stands for itself. Links meet pages in ``parts``
    tasks, or as many as the session finds fit.
    """
    page = canonical_url(F.col("url"))
    fit = docs.where(is_product_url(F.col("url")) & ((F.size(domains) == 0) | domain_allowed(netloc_of(F.col("url")), domains)))
    fit = fit.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "url"))).where(F.col("nth") <= most).drop("nth", "place").withColumn("at", page)
    fit = fit if parts is None else fit.repartition(parts, "at")
    known = jsonld_items(pages).join(pages.select("page_id", page.alias("at")), "page_id").withColumn("own", canonical_url(F.col("url")) == F.col("at"))
    owned = F.max(F.col("own").cast("int")).over(Window.partitionBy("page_id")) == 1
    known = known.withColumn("owned", owned).where("own OR NOT owned").select("at", F.col("url").alias("item_url"), F.col("title").alias("item"), "amount", "currency", "own")
    met = fit.join(known, "at", "left")
    return met.select("query_id", F.coalesce("item_url", "url").alias("url"), F.coalesce("item", "title").alias("title"), "amount", "currency", F.coalesce("own", F.lit(False)).alias("own"))
