"""Merging offers into products: live and cheapest first, within the currency most offers share.

Rows: group (the query), identity, pos (order of arrival; ties go by url), url, title, seller, brand, image, currency,
amount, availability, condition, rating, reviews. Rows without identity are products of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bound
from ..functions.money import money_text
from ..functions.url import canonical_url, doc_domain

# Availabilities under which an offer cannot be taken.
STALE = ["outofstock", "soldout", "discontinued"]


def _by_arrival(offers: Column) -> Column:
    keyed = F.transform(offers, lambda o: F.named_struct(F.lit("o"), o["pos"], F.lit("u"), o["url"], F.lit("x"), o))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


_FIELDS = ["identity", "url", "title", "seller", "brand", "image", "currency", "amount", "availability", "condition", "rating", "reviews"]


def merge_items(items: DataFrame) -> DataFrame:
    """One row an identity: the winner, its gaps filled from the others, and the others as ``offers``; ``place`` is the order in its group."""
    # the products are dealt by group, which serves both windows
    merged = products(items).drop("own_brand").withColumn("common", F.count("amount").over(Window.partitionBy("group", "currency")))
    loner = F.col("product").startswith("_").cast("int")
    order = Window.partitionBy("group").orderBy(F.col("amount").isNull(), F.desc("common"), "currency", F.coalesce("amount", F.lit(0.0)), loner, "pos", "product")
    return merged.withColumn("place", F.row_number().over(order)).drop("common", "pos")


def products(items: DataFrame) -> DataFrame:
    """One row an identity as merge_items gives it, without its place; ``own_brand`` is the brand that the winner itself had, ``pos`` the first arrival.

    Two aggregations: copies of a listing to one, and listings to products, whose offers are then ordered
    within the product's own row. The offers move once, dealt by group: both aggregations and the order of a
    group's products take them where they are.
    """
    own = F.when(F.coalesce("identity", F.lit("")) == "", F.concat(F.lit("_"), F.col("pos").cast("string"))).otherwise(F.col("identity"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lacks = [F.col("amount").isNull(), F.col("rating").isNull(), F.col("reviews").isNull(), text("brand") == "", text("image") == ""]
    rows = items.withColumn("product", own).withColumn("page", F.when(text("url") == "", F.concat(F.lit("_"), F.col("pos").cast("string"))).otherwise(canonical_url(F.col("url")))).withColumn("currency", text("currency"))
    rows = rows.repartition("group")
    # the same listing twice: the richer copy, the first on ties; its place is that of the first
    rich = F.struct(F.struct(*[x.cast("int").alias(f"l{i}") for i, x in enumerate(lacks)]).alias("lacks"), F.col("pos").alias("own"), F.col("url").alias("at"), F.struct(*_FIELDS).alias("x"))
    listings = rows.groupBy("group", "product", "page").agg(F.min("pos").alias("pos"), F.min(rich)["x"].alias("x"))
    stale = F.lower(F.trim(F.coalesce("x.availability", F.lit("")))).isin(STALE)
    found = listings.groupBy("group", "product").agg(F.collect_list(F.struct("pos", stale.alias("stale"), "x.*")).alias("all"), F.count(F.lit(1)).cast("int").alias("offer_count"), F.min("pos").alias("pos"))

    def major(priced: Column) -> Column:  # the currency of most offers; on a tie the one seen first
        of = lambda c: F.filter(priced, lambda o: o["currency"] == c)
        votes = F.transform(F.array_distinct(F.transform(priced, lambda o: o["currency"])), lambda c: F.named_struct(F.lit("n"), -F.size(of(c)), F.lit("since"), F.array_min(F.transform(of(c), lambda o: o["pos"])), F.lit("c"), c))
        return F.array_min(votes)["c"]

    found = found.withColumn("major", bound(F.filter("all", lambda o: o["amount"].isNotNull()), major))

    def turn(o: Column) -> Column:
        pooled = o["amount"].isNotNull() & (o["currency"] == F.col("major"))
        zero = F.lit(0)
        return F.named_struct(F.lit("p"), F.when(pooled, zero).otherwise(1), F.lit("s"), F.when(pooled, o["stale"].cast("int")).otherwise(zero), F.lit("a"), F.when(pooled, o["amount"]).otherwise(0.0), F.lit("o"), o["pos"], F.lit("u"), o["url"], F.lit("x"), o)

    found = found.withColumn("turns", F.transform(F.array_sort(F.transform("all", turn)), lambda t: t["x"])).withColumn("first", F.get("turns", F.lit(0))).withColumn("rest", _by_arrival(F.slice("turns", 2, F.greatest(F.size("turns") - 1, F.lit(1)))))
    # the winner's own value, else that of the first of the others that has one
    fill = lambda c: F.coalesce(F.nullif(F.col(f"first.{c}"), F.lit("")), F.get(F.filter("rest", lambda o: F.coalesce(o[c], F.lit("")) != ""), F.lit(0))[c]).alias(c)
    value = lambda c: F.coalesce(F.col(f"first.{c}"), F.get(F.filter("rest", lambda o: o[c].isNotNull()), F.lit(0))[c]).alias(c)
    offer = lambda o: F.struct(o["pos"].alias("pos"), o["url"].alias("url"), F.coalesce(F.nullif(o["seller"], F.lit("")), doc_domain(o["url"])).alias("seller"), o["amount"].alias("price"), o["currency"].alias("currency"), o["availability"].alias("availability"), o["condition"].alias("condition"))
    return found.select("group", "product", *[F.col(f"first.{c}").alias(c) for c in ("identity", "url", "title", "seller", "currency", "amount", "availability", "condition")], fill("brand"), fill("image"), value("rating"), value("reviews"), F.transform("rest", offer).alias("offers"), "offer_count", "pos", F.col("first.brand").alias("own_brand"))


def item_documents(items: DataFrame, source: str = "marketplace") -> DataFrame:
    """(group, rank, url, title, snippet, source) of items (group, place, url, title, seller, currency, amount): products as documents of a search, what they cost and who sells them in the snippet."""
    who = F.coalesce(F.nullif(F.col("seller"), F.lit("")), doc_domain(F.col("url")))
    said = F.concat(F.coalesce(money_text(F.col("amount"), F.col("currency")), F.lit("")), F.lit(" · "), who)
    return items.select("group", (F.col("place") - 1).alias("rank"), "url", "title", said.alias("snippet"), F.lit(source).alias("source"))
