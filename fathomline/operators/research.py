"""What a research run makes of its workers' reports: proven links, rolled-up findings, what is new."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bound
from ..functions.url import canonical_url

MARKER = "[unverified link removed]"


def markdown_links(text: Column) -> Column:
    """The addresses that markdown links of a text lead to, in order: what stands between ``](`` and the next ``)``, behind a label."""
    pieces = F.split(text, r"\]\(")

    def link(before: Column, after: Column) -> Column:
        label, target = F.substring_index(before, "[", -1), F.substring_index(after, ")", 1)
        fits = before.contains("[") & ~label.contains("]") & after.contains(")") & (target.startswith("http://") | target.startswith("https://")) & ~target.rlike(r"\s") & (F.length(target) > F.instr(target, "://") + 2)
        return F.when(fits, target)

    return bound(pieces, lambda p: F.array_compact(F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), link)))


def bare_links(text: Column) -> Column:
    """The addresses that stand in a text by themselves: from their scheme, which no letter and no bracket precedes, to a blank, a quote or a closing bracket."""
    runs = F.regexp_extract_all(text, F.lit("""[^\\s)\\]>"']+"""), F.lit(0))

    def address(run: Column) -> Column:
        at = F.coalesce(F.nullif(F.least(*[F.when(F.instr(run, s) > 0, F.instr(run, s)).otherwise(1 << 30) for s in ("http://", "https://")]), F.lit(1 << 30)), F.lit(0))
        free = (at == 1) | ~F.substr(run, at - 1, F.lit(1)).rlike(r"[\w(]")
        found = F.substr(run, at)
        return F.when((at > 0) & free & (F.length(found) > F.instr(found, "://") + 2), found)

    return F.array_compact(F.transform(runs, address))


def link_key(url: Column) -> Column:
    """One spelling of a link: no closing punctuation, fragment or final slash; scheme and host in lower case."""
    bare = F.substring_index(F.regexp_replace(F.trim(url), "[.,;:!?]+$", ""), "#", 1)
    head = F.regexp_extract(bare, r"^([A-Za-z]+://[^/]*)", 1)
    return F.regexp_replace(F.concat(F.lower(head), F.substr(bare, F.length(head) + 1)), "/+$", "")


def proven_links(answers: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Answers (keys, answer) without links that no worker of the run retrieved (keys, url): ``proven`` and ``dropped``, their number.

    A markdown link keeps its text, a bare URL becomes a marker. A run's links are joined, not its pages collected.
    """
    links = bound(markdown_links(F.col("answer")), lambda linked: F.array_distinct(F.concat(linked, bare_links(F.aggregate(linked, F.col("answer"), lambda t, a: F.replace(t, F.concat(F.lit("]("), a, F.lit(")")), F.lit(" ")))))))
    said = answers.select(*keys, F.explode(links).alias("link")).withColumn("key", link_key(F.col("link"))).distinct()
    seen = retrieved.select(*keys, link_key(F.col("url")).alias("key")).distinct().withColumn("found", F.lit(True))
    bad = said.join(seen, [*keys, "key"], "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("link"), lambda a, b: F.length(b) - F.length(a)).alias("bad"))
    whole = answers.join(bad, keys, "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))

    def literal(link: Column) -> Column:
        return F.concat(F.lit("\\Q"), link, F.lit("\\E"))

    # the longest first, so that no link is cut inside a longer one
    plain = F.aggregate("bad", F.col("answer"), lambda text, link: F.regexp_replace(text, F.concat(F.lit(r"\[([^\]]*)\]\("), literal(link), F.lit(r"\)")), F.lit("$1")))
    proven = F.aggregate("bad", plain, lambda text, link: F.regexp_replace(text, F.concat(F.lit(r"(?<![(\w])"), literal(link), F.lit(r"(?![^\s)\]>\"'])")), F.lit(MARKER)))
    markers = lambda text: F.size(F.split(text, re.escape(MARKER))) - 1
    dropped = bound(F.struct(F.col("answer").alias("a"), proven.alias("p")), lambda x: F.size(markdown_links(x["a"])) - F.size(markdown_links(x["p"])) + markers(x["p"]) - markers(x["a"]))
    return whole.select(*keys, proven.alias("proven"), dropped.cast("long").alias("dropped"))


def reported(subtasks: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Subtasks with the report made for them (findings, finished); one that was never reported has none and is not finished."""
    return subtasks.join(reports.select(*keys, "findings", F.lit(True).alias("finished")), keys, "left").withColumn("finished", F.coalesce("finished", F.lit(False))).withColumn("findings", F.coalesce("findings", F.lit(0)))


def rolled_up(docs: DataFrame, run: str) -> DataFrame:
    """(run, page, url, title, text, workers): the documents of all workers of a run, each page once: the first copy that has a text, else the first; docs: run, worker, pos, url, title, text."""
    rank = F.struct((F.coalesce("text", F.lit("")) == "").cast("int").alias("bare"), "worker", "pos", "url", "title", "text")
    once = docs.groupBy(run, canonical_url(F.col("url")).alias("page")).agg(F.min(rank).alias("d"), F.count_distinct("worker").alias("workers"))
    return once.select(run, "page", "d.url", "d.title", "d.text", "workers")


def unseen(items: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Items that a worker was not shown before."""
    return items.join(seen.select(*keys).distinct(), keys, "left_anti")


def shown(docs: DataFrame) -> DataFrame:
    """docs (title, snippet, sources) as a worker sees them: short, and confirmed by how many sources where more than one lists the page."""
    n = F.size("sources")
    note = F.when(n > 1, F.concat(F.lit(" (confirmed by "), n.cast("string"), F.lit(" providers)"))).otherwise("")
    return docs.withColumn("line", F.concat(F.substring(F.coalesce("title", F.lit("")), 1, 200), note, F.lit("\n"), F.substring(F.coalesce("snippet", F.lit("")), 1, 240)))
