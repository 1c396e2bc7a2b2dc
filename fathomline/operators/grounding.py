"""Research bookkeeping: cited pages that were really retrieved, budgets, benchmark containment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.url import canonical_url


def ground_citations(cited: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """The citations (keys, finding, url) with ``grounded``: the page was seen under the same keys, spelling and tracking aside. A page cited twice in a finding counts once."""
    pages = seen.select(*keys, canonical_url(F.col("url")).alias("page")).distinct().withColumn("found", F.lit(True))
    once = cited.withColumn("page", canonical_url(F.col("url"))).groupBy(*keys, "finding", "page").agg(F.min("url").alias("url"))
    return once.join(pages, [*keys, "page"], "left").withColumn("grounded", F.coalesce("found", F.lit(False))).drop("found")


#: Text of items that may be shipped to every task as one automaton, in bytes.
SHIP_BYTES = 8 << 20


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents (doc_id, text) whose text contains an item's (item_id, item), spelling and all.

    Items of five words or more meet documents on three inner words, which no neighbouring text can alter, and
    the whole text decides. Shorter ones are searched for all at once by an automaton that is shipped to the
    tasks, in as many rounds over the documents as their size takes. Null texts contain and are contained in
    nothing; an empty item is in every text.
    """
    bench = items.where("item IS NOT NULL").select("item_id", "item", F.split("item", r"\s+").alias("w"))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    three = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    runs = F.transform(F.array(F.split("text", r"\s+")), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: three(w, i)))
    at = texts.select("doc_id", F.explode(F.array_distinct(F.flatten(runs))).alias("at"))
    met = at.join(bench.where(F.size("w") >= 5).select("item_id", three(F.col("w"), F.lit(1)).alias("at")), "at").select("doc_id", "item_id").distinct()
    found = met.join(texts, "doc_id").join(bench.select("item_id", "item"), "item_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    short = bench.where(F.size("w") < 5).select("item_id", "item")
    size = short.agg(F.sum(F.octet_length("item") + 16)).first()[0] or 0
    rounds = -(-size // SHIP_BYTES)
    for n in range(rounds):
        part = [(r.item_id, r.item) for r in short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(rounds)) == n).collect()]
        found = found.unionByName(_searched(texts, part))
    return found.distinct()


def _searched(texts: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(items)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])

    def search(batches):
        import ahocorasick

        machine, named = ahocorasick.Automaton(), {}
        for item_id, item in shared.value:
            named.setdefault(item, []).append(item_id)
        for item in named:
            if item:
                machine.add_word(item, item)
        machine.make_automaton()
        everywhere = {""} & named.keys()
        for batch in batches:
            docs, ids = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held = everywhere | ({item for _, item in machine.iter(text)} if len(machine) else set())
                for item in held:
                    ids += named[item]
                    docs += [doc_id] * len(named[item])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.int64())], schema=schema)

    return texts.mapInArrow(search, "doc_id long, item_id long")


def within_budget(calls: DataFrame, key: str, order: list[str], tokens: Column, most: int) -> DataFrame:
    """The calls of each run that were made before its tokens were used up, with the tokens used so far."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(tokens).over(before), F.lit(0))
    return calls.withColumn("used_before", used).where(F.col("used_before") < most)


def cost(tokens_in: Column, tokens_out: Column, price_in: float = 5.0, price_out: float = 25.0) -> Column:
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out


def majority_vote(votes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) where one value has two votes or more and more than half of all."""
    counted = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    per = Window.partitionBy(key)
    return counted.withColumn("all", F.sum("n").over(per)).where((F.col("n") >= 2) & (F.col("n") * 2 > F.col("all"))).select(key, value, F.col("n").alias("votes"))
