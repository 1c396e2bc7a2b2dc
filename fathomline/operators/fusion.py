"""Fusing ranked lists: one row a page, reciprocal ranks, agreement, syndicated copies.

Rows: query_id, provider, provider_pos (the provider's place in the registry), rank, url, title,
snippet, published. Everything is keyed by query_id, so queries spread over the cluster.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import shingles
from ..functions.url import canonical_url, doc_domain
from ..scratch import written

RRF_K = 60


def _present(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def dedupe_lists(lists: DataFrame) -> DataFrame:
    """One row a page within each provider's list: the best-ranked copy, its gaps filled from the others; ``pos`` counts what is left."""
    keyed = lists.withColumn("key", F.when(F.trim("url") == "", F.concat(F.lit("_"), F.col("rank").cast("string"))).otherwise(canonical_url(F.col("url"))))
    # the smallest struct whose first field says "present" is the best-ranked copy that has a value
    fill = lambda c: F.min(F.when(_present(c).isNotNull(), F.struct("rank", c)))[c].alias(c)
    grouped = keyed.groupBy("query_id", "provider", "provider_pos", "key").agg(F.min("rank").alias("rank"), F.min(F.struct("rank", "url"))["url"].alias("url"), fill("title"), fill("snippet"), fill("published"), F.count(F.lit(1)).alias("copies"))
    return grouped.withColumn("pos", F.row_number().over(Window.partitionBy("query_id", "provider").orderBy("rank")) - 1)


def rrf(deduped: DataFrame, weights: DataFrame | None = None, k: int = RRF_K) -> DataFrame:
    """Weighted reciprocal-rank fusion; weights: (query_id, provider, weight), 1 where absent. ``place`` is the fused order from 1."""
    rows = deduped.withColumn("page", canonical_url(F.col("url")))
    rows = rows.join(weights, ["query_id", "provider"], "left") if weights is not None else rows.withColumn("weight", F.lit(1.0))
    share = F.coalesce("weight", F.lit(1.0)) / (F.lit(float(k)) + F.col("pos") + 1)
    best = F.min(F.struct("rank", "provider_pos", "pos", "url", "title", "snippet"))
    seen = F.min(F.struct("provider_pos", "pos"))
    dated = F.min(F.when(_present("published").isNotNull(), F.struct("provider_pos", "pos", "published")))
    own = F.min(F.struct("rank", "provider_pos", "pos", "published"))
    fused = rows.groupBy("query_id", "page").agg(
        F.round(F.sum(share), 12).alias("score"), best.alias("best"), seen.alias("seen"), F.coalesce(F.nullif(own["published"], F.lit("")), dated["published"]).alias("published"), F.array_sort(F.collect_set("provider")).alias("sources"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return fused.select("query_id", "page", F.col("best.url").alias("url"), F.col("best.title").alias("title"), F.col("best.snippet").alias("snippet"), "published", "sources", F.size("sources").alias("agreement"), "score", F.row_number().over(order).alias("place"))


def _pages(fused: DataFrame) -> DataFrame:
    """(query_id, place, domain, class, set) of the pages whose titles and snippets have words; a class is the pages of one query with one set of shingles, named by its first place. A set holds the shingles' 64-bit hashes, as their words would be moved and written several times over."""
    probe = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    sets = fused.select("query_id", "place", doc_domain(F.col("url")).alias("domain"), F.array_sort(F.array_distinct(F.transform(shingles(probe), lambda s: F.xxhash64(s)))).alias("set")).where(F.size("set") > 0)
    named = sets.withColumn("a", F.xxhash64("set")).withColumn("b", F.xxhash64(F.lit(1), "set"))
    classes = named.groupBy("query_id", "a", "b").agg(F.min("place").alias("class"))
    return named.join(classes, ["query_id", "a", "b"]).select("query_id", "place", "domain", "class", "set")


def _similar_classes(pages: DataFrame, threshold: float) -> DataFrame:
    """(query_id, first, second, similarity) of classes whose sets overlap, each pair once.

    Pairs meet on shared shingles of the rarer part of each set (a prefix that any similar pair must
    share), so classes without common wording never meet.
    """
    sets = pages.where(F.col("place") == F.col("class")).select("query_id", "class", "set")
    each = sets.select("query_id", "class", F.explode("set").alias("shingle"))
    counted = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query_id", "shingle")))
    rare = Window.partitionBy("query_id", "class").orderBy("df", "shingle")
    whole = Window.partitionBy("query_id", "class")
    prefix = counted.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("i", F.row_number().over(rare)).where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")
    a, b = prefix.select("query_id", "shingle", F.col("class").alias("first")), prefix.select("query_id", "shingle", F.col("class").alias("second"))
    near = a.join(b, ["query_id", "shingle"]).where("first < second").select("query_id", "first", "second").distinct()
    left, right = sets.select("query_id", F.col("class").alias("first"), F.col("set").alias("sa")), sets.select("query_id", F.col("class").alias("second"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    scored = near.join(left, ["query_id", "first"]).join(right, ["query_id", "second"]).withColumn("similarity", common / (F.size("sa") + F.size("sb") - common).cast("double"))
    return scored.where(F.col("similarity") >= threshold).select("query_id", "first", "second", "similarity")


def _both_ways(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, class, other, similarity): each class with itself and with those it is similar to."""
    there = pairs.select("query_id", F.col("first").alias("class"), F.col("second").alias("other"), "similarity")
    back = pairs.select("query_id", F.col("second").alias("class"), F.col("first").alias("other"), "similarity")
    return there.union(back).union(pages.where(F.col("place") == F.col("class")).select("query_id", "class", F.col("class").alias("other"), F.lit(1.0)))


def similar_pairs(fused: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(query_id, first, second, similarity): all pairs of pages of one query on different domains whose titles and snippets overlap; first is placed higher."""
    pages = written(_pages(fused), "probes")
    met = _both_ways(_similar_classes(pages, threshold), pages)
    left, right = pages.select("query_id", "class", F.col("place").alias("first"), F.col("domain").alias("da")), pages.select("query_id", F.col("class").alias("other"), F.col("place").alias("second"), F.col("domain").alias("db"))
    return met.join(left, ["query_id", "class"]).join(right, ["query_id", "other"]).where("first < second AND da <> db").select("query_id", "first", "second", "similarity")


def suppressed(pages: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, place, kept): the pages that go, each with the first kept page that it is similar to.

    In order, a page goes if a kept one before it is similar and on another domain; pages: (query_id, place,
    domain, class), near: (query_id, class, other), a class with itself too. The decision is greedy and not
    transitive. Pages of one class and domain never meet, so the first of such a group stands for it; groups of one
    class always meet, so a class keeps one group at most. Hence it is made in rounds over classes, without
    pairs of pages: the first group in question of a class stays if no similar class has an earlier one in
    question; what stays settles its class and rules out later groups of other domains in the similar ones.
    """
    groups = pages.groupBy("query_id", "class", "domain").agg(F.min("place").alias("at"))
    open_, kept = written(groups, "open-groups"), []
    near = written(near.select("query_id", "class", "other"), "similar-classes")
    while not open_.isEmpty():
        heads = written(open_.groupBy("query_id", "class").agg(F.min(F.struct("at", "domain")).alias("h")).select("query_id", "class", "h.*"), "heads")
        earlier = heads.select("query_id", F.col("class").alias("other"), F.col("at").alias("before"))
        waits = heads.join(near, ["query_id", "class"]).join(earlier, ["query_id", "other"]).where("before < at").select("query_id", "class").distinct()
        stay = written(heads.join(waits, ["query_id", "class"], "left_anti"), "kept-groups")
        kept.append(stay)
        ruling = stay.join(near, ["query_id", "class"]).select("query_id", F.col("other").alias("class"), F.col("at").alias("since"), F.col("domain").alias("by"))
        out = open_.join(ruling, ["query_id", "class"]).where("since < at AND by <> domain").select("query_id", "class", "domain").distinct()
        rest = open_.join(stay.select("query_id", "class"), ["query_id", "class"], "left_anti")
        open_ = written(rest.join(out, ["query_id", "class", "domain"], "left_anti").select(groups.columns), "open-groups")
    if not kept:
        return pages.select("query_id", "place", F.col("place").alias("kept")).limit(0)
    ruling = functools.reduce(DataFrame.union, kept).join(near, ["query_id", "class"]).select("query_id", F.col("other").alias("class"), F.col("at").alias("since"), F.col("domain").alias("by"))
    return pages.join(ruling, ["query_id", "class"]).where("since < place AND by <> domain").groupBy("query_id", "place").agg(F.min("since").alias("kept"))


def collapse_syndication(fused: DataFrame, threshold: float = 0.82) -> DataFrame:
    """The fused list without syndicated copies: in order, a page goes if a kept one before it is similar. Adds ``near_duplicates``."""
    pages = written(_pages(fused), "probes")
    gone = written(suppressed(pages, _both_ways(_similar_classes(pages, threshold), pages)), "syndicated")
    copies = gone.join(fused.select("query_id", "place", "url"), ["query_id", "place"]).groupBy("query_id", F.col("kept").alias("place")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda c: c["url"]).alias("near_duplicates"))
    stay = fused.join(gone.select("query_id", "place"), ["query_id", "place"], "left_anti")
    return stay.join(copies, ["query_id", "place"], "left").withColumn("near_duplicates", F.coalesce("near_duplicates", F.array().cast("array<string>")))


def fuse(lists: DataFrame, weights: DataFrame | None = None, limit: int = 20, k: int = RRF_K) -> DataFrame:
    """Dedupe, fuse, collapse syndicated copies, and keep the first ``limit`` of each query."""
    fused = written(rrf(dedupe_lists(lists), weights, k), "fused")  # read by each step of the comparison
    collapsed = collapse_syndication(fused)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return collapsed.withColumn("place", place).where(F.col("place") <= limit)
