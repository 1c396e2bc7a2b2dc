"""Products and marketplace listings inside captured pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bound
from ..functions.money import identity_for, money_text, parse_price, price_from_meta, price_from_offer
from ..functions.net import resolved
from ..functions.text import visible_text
from ..scratch import written
from .objects import objects_column
from .records import generic_listings, is_engine, merged, result_counts, row_text, without_twins

#: The text of JSON-LD scripts; one that is never closed reaches to the end of its page.
_LD = r"""(?is)<script\b[^<>]*["']application/ld\+json["'][^<>]*+>(.*?)(?:</script\s*>|\z)"""
_NODE = "`@type` string, name string, url string, gtin13 string, gtin string, mpn string, sku string, image string, brand string, aggregateRating struct<ratingValue:double,reviewCount:int>, offers string, seller string, vehicleIdentificationNumber string, mileageFromOdometer string, vehicleTransmission string, vehicleEngine string"
# Types of nodes that are products.
TYPES = ["Product", "ProductGroup", "Vehicle", "IndividualProduct", "Car", "Motorcycle"]


def _nodes(pages: DataFrame) -> DataFrame:
    """(page_id, page, blob, pos, n) of every product node: single nodes, arrays and graphs. Fields of several shapes stay JSON text."""
    blobs = pages.select("page_id", F.col("url").alias("page"), F.posexplode(F.regexp_extract_all("html", F.lit(_LD), F.lit(1))).alias("blob", "json"))
    node = F.from_json("json", _NODE)
    graph = F.from_json("json", f"`@graph` array<struct<{_struct()}>>")["@graph"]
    listed = F.from_json("json", f"array<struct<{_struct()}>>")
    nodes = F.when(F.ltrim("json").startswith("["), listed).when(graph.isNotNull(), graph).otherwise(F.array(node))
    kind = F.coalesce(F.get_json_object("n.@type", "$[0]"), F.col("n.@type"))
    return blobs.select("page_id", "page", "blob", F.posexplode(nodes).alias("pos", "n")).where(kind.isin(TYPES) & F.col("n.name").isNotNull())


def _named(json: Column) -> Column:
    """The name in a value that is an object, a list of them, or the name itself."""
    inner = F.coalesce(*[F.get_json_object(json, p) for p in ("$[0].name", "$.name", "$[0].value", "$.value", "$[0]")])
    return F.coalesce(inner, F.when(~json.rlike(r"^\s*[\[{]"), json))


def _of_offer(name: str) -> Column:
    return F.coalesce(F.get_json_object("n.offers", f"$[0].{name}"), F.get_json_object("n.offers", f"$.{name}"))


def _first_offer() -> Column:
    return F.when(F.ltrim("n.offers").startswith("["), F.get_json_object("n.offers", "$[0]")).otherwise(F.col("n.offers"))


def jsonld_items(pages: DataFrame) -> DataFrame:
    """Items (page_id, pos, title, url, price, currency, …) of the JSON-LD products of pages (page_id, url, html); a page's own price declaration serves when it holds exactly one product that has none."""
    alone = F.count("*").over(Window.partitionBy("page_id")) == 1
    declared = pages.select("page_id", price_from_meta(F.col("html")).alias("meta"))
    each = _nodes(pages).withColumn("offer", price_from_offer(_first_offer())).withColumn("alone", alone).join(declared, "page_id", "left")
    price = F.when(F.col("offer.amount").isNull() & F.col("alone") & F.col("meta.amount").isNotNull(), F.col("meta")).when(F.col("offer").isNotNull(), F.col("offer"))
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^https?://schema\.org/", "")
    url, brand = F.coalesce(F.when(F.col("n.url") != "", resolved(F.col("page"), F.col("n.url"))), F.col("page")), _named(F.col("n.brand"))
    return each.withColumn("price", price).select(
        "page_id", "blob", "pos", F.col("n.name").alias("title"), url.alias("url"), F.col("price.amount").alias("amount"), F.coalesce("price.currency", F.lit("USD")).alias("currency"), brand.alias("brand"),
        F.col("n.aggregateRating.ratingValue").alias("rating"), F.col("n.aggregateRating.reviewCount").alias("reviews"), "n.image", clean(_of_offer("availability")).alias("availability"), clean(_of_offer("itemCondition")).alias("condition"),
        F.col("n.vehicleIdentificationNumber").alias("vin"), identity_for(F.coalesce("n.gtin13", "n.gtin"), F.coalesce("n.mpn", F.lit("")), brand, F.col("n.name"), F.when(F.col("alone"), url).otherwise("")).alias("identity"),
    )


#: Rows a page may add to its text.
MOST_ROWS = 60


def ld_listings(pages: DataFrame) -> DataFrame:
    """(page_id, path, key, name, price, miles, transmission, engine, color, vin, seller, distance, history, link, ids) of the JSON-LD products of pages; what JSON-LD does not say is null."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    comma = lambda c: F.format_number(F.replace(c, F.lit(","), F.lit("")).try_cast("long"), 0)
    miles, name = F.col("n.mileageFromOdometer"), F.trim("n.name")
    value, unit = F.get_json_object(miles, "$.value"), F.upper(F.coalesce(F.get_json_object(miles, "$.unitCode"), F.lit("")))
    measured = F.concat_ws(" ", F.coalesce(comma(value), value), F.when(unit == "SMI", "mi").when(unit == "KMT", "km"))
    distance = F.when(value.isNotNull(), some(measured)).when(~miles.rlike(r"^\s*\{"), F.coalesce(F.concat(comma(miles), F.lit(" mi")), some(miles)))
    engine = _named(F.col("n.vehicleEngine"))
    vin, seller = some(F.col("n.vehicleIdentificationNumber")), F.coalesce(_of_offer("seller"), F.col("n.seller"))

    def who(s: Column) -> Column:
        place = F.concat_ws(", ", *[some(F.get_json_object(s, f"$.address.{k}")) for k in ("addressLocality", "addressRegion")])
        return some(F.concat_ws(" ", some(_named(s)), bound(place, lambda p: F.when(p != "", F.concat(F.lit("("), p, F.lit(")"))))))

    link = F.coalesce(some(_of_offer("url")), some(F.col("n.url")))
    link = bound(F.when(link.isNotNull(), bound(link, lambda u: resolved(F.col("page"), u))), lambda u: F.when(u.rlike("(?i)^https?://"), u))
    none = F.lit(None).cast("string")
    return _nodes(pages).select(
        "page_id", F.array(F.col("blob").cast("int"), F.col("pos").cast("int")).alias("path"), F.coalesce(vin, name).alias("key"), some(name).alias("name"), some(bound(price_from_offer(_first_offer()), lambda p: money_text(p["amount"], p["currency"]))).alias("price"),
        distance.alias("miles"), some(F.col("n.vehicleTransmission")).alias("transmission"), bound(engine, lambda e: F.when(is_engine(e) & ~F.lower(name).contains(F.lower(e)), e)).alias("engine"), none.alias("color"), vin.alias("vin"), bound(seller, who).alias("seller"),
        none.alias("distance"), none.alias("history"), link.alias("link"), F.lit(None).cast("array<string>").alias("ids"),
    ).where("key <> ''")


def listing_rows(pages: DataFrame, prose: Column | None = None, generic: bool = False) -> DataFrame:
    """(page_id, place, key, row): the listings of pages (page_id, url, html) that their prose does not already name, as lines of text.

    A row is name | price | miles | transmission | engine | colour | VIN | seller (place) | distance | history |
    link, without what is missing; its key is the VIN, else the name. Each key counts once a page, gaps
    filled from its copies (JSON-LD first, then, with ``generic``, the page's own state), at most MOST_ROWS
    rows a page. ``prose``: the text to search, the visible text where it is not given.
    """
    return _rows_beside(pages, pages.select("page_id", (visible_text(F.col("html")) if prose is None else prose).alias("prose")), generic)


def _rows_beside(pages: DataFrame, texts: DataFrame, generic: bool) -> DataFrame:
    """listing_rows beside texts (page_id, prose)."""
    found = ld_listings(pages)
    if generic:
        state = generic_listings(pages).withColumn("ids", F.lit(None).cast("array<string>"))
        found = found.unionByName(state.withColumn("path", F.concat(F.array(F.lit(1 << 30)), "path")))
    once = merged(found)
    if generic:
        once = without_twins(written(once, "page-listings"))
    new = once.join(texts.select("page_id", "prose"), "page_id").where(~F.col("prose").contains(F.col("key")))
    ranked = new.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("path")))
    return ranked.where(F.col("place") <= MOST_ROWS).select("page_id", "place", "key", row_text().alias("row"))


def with_listings(pages: DataFrame, prose: Column, *also: Column) -> DataFrame:
    """(page_id, text, and what else is asked of each page): each page's prose and, where it has listings that the prose does not name, a section of them headed by the total that the page's data gives; a search without matches says so."""
    texts = written(pages.select("page_id", prose.alias("prose"), *also), "page-prose")  # read twice
    rows = _rows_beside(pages, texts, generic=True)
    lines = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "row"))), lambda r: F.concat(F.lit("- "), r["row"])), "\n").alias("lines"))
    whole = texts.join(lines, "page_id", "left").join(result_counts(pages), "page_id", "left")
    total = F.when(F.col("total") > 0, F.concat(F.lit("The page's own data reports "), F.format_number("total", 0), F.lit(" results in all.\n\n"))).otherwise("")
    section = F.when(F.col("lines").isNotNull(), F.concat(F.lit("\n\n## Listings\n\n"), total, "lines")).when((F.col("total") == 0) & (F.length("prose") < 500), "\n\n## Listings\n\nNo matches: the page's own data reports 0 results.").otherwise("")
    return whole.select("page_id", F.concat("prose", section).alias("text"), *texts.columns[2:])


def _struct() -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(_NODE).simpleString()[len("struct<") : -1].replace("@type", "`@type`")


def relay_listings(pages: DataFrame) -> DataFrame:
    """Listings (page_id, pos, identity, title, amount, currency, sold) in a marketplace payload, each id once; what is not said to be sold is not."""
    found = objects_column(F.col("html"), '"listing":')
    shape = "id string, marketplace_listing_title string, listing_price struct<amount:string,currency:string,formatted_amount:string>, is_sold boolean"
    each = pages.select("page_id", F.posexplode(found).alias("pos", "json")).select("page_id", "pos", F.from_json("json", shape).alias("v")).where("v.id IS NOT NULL")
    once = each.groupBy("page_id", F.col("v.id").alias("id")).agg(F.min(F.struct("pos", "v")).alias("one"))
    v = F.col("one.v")
    return once.select("page_id", F.col("one.pos").alias("pos"), F.concat(F.lit("fbmp:"), F.col("id")).alias("identity"), v["marketplace_listing_title"].alias("title"), v["listing_price"]["amount"].try_cast("double").alias("amount"), F.coalesce(v["listing_price"]["currency"], F.lit("USD")).alias("currency"), F.coalesce(v["is_sold"], F.lit(False)).alias("sold"))


def card_prices(cards: DataFrame) -> DataFrame:
    """(item_id, price, was, title) of listing cards given as texts in reading order: the first price leads, a second one is the former price."""
    is_price = lambda t: t.rlike(r"^(?:[A-Z]{0,3}[$€£]\s?\d[\d,.]*|Free|FREE|Gratis)$")
    prices = F.filter("spans", is_price)
    words = F.filter("spans", lambda t: ~is_price(t) & (F.length(t) > 0))
    first = F.get(prices, F.lit(0))
    free = F.lower(first).isin("free", "gratis")
    return cards.select("item_id", F.when(free, 0.0).otherwise(parse_price(first)["amount"]).alias("price"), parse_price(F.get(prices, F.lit(1)))["amount"].alias("was"), F.get(words, F.lit(0)).alias("title"))
