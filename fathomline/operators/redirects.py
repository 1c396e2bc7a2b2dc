"""Redirects that hold for more than one page: learned from reads as prefix moves, applied to later URLs.

A read that ended elsewhere and kept the tail of its path and its query says that a prefix moved. An
origin keeps its newest moves, one for each old prefix; a move that now leads elsewhere counts anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bound
from ..functions.url import netloc_of, path_of, query_of, scheme_of
from .state import ordered_fold

#: Moves an origin keeps, times one must have been seen to be followed, and moves followed in a row.
RULES, SEEN, HOPS = 8, 2, 3


def origin_of(url: Column) -> Column:
    return F.lower(F.concat(scheme_of(url), F.lit("://"), netloc_of(url)))


def moved_prefix(url: Column, final: Column) -> Column:
    """struct(origin, old, new) of the prefix move that a redirect shows; null if it shows none."""
    path, end = path_of(url), path_of(final)
    parts = lambda p: F.split(F.regexp_replace(p, "/+$", ""), "/")
    sides = F.struct(parts(path).alias("a"), parts(end).alias("b"))

    def move(s: Column) -> Column:
        a, b = s["a"], s["b"]
        shorter = F.least(F.size(a), F.size(b))
        same = F.transform(F.sequence(F.lit(1), shorter), lambda i: (F.element_at(a, -i) == F.element_at(b, -i)) & (F.element_at(a, -i) != ""))
        first = F.array_position(same, False).cast("int")
        kept = F.when(first == 0, shorter).otherwise(first - 1)
        front = lambda x: F.concat(F.array_join(F.slice(x, 1, F.greatest(F.size(x) - kept, F.lit(0))), "/"), F.lit("/"))
        return F.when(kept > 0, F.struct(origin_of(url).alias("origin"), front(a).alias("old"), F.concat(scheme_of(final), F.lit("://"), netloc_of(final), front(b)).alias("new")))

    sound = (final != "") & (final != url) & (query_of(url) == query_of(final)) & scheme_of(final).isin("http", "https") & (netloc_of(final) != "") & (path.endswith("/") == end.endswith("/"))
    return bound(F.when(sound, bound(sides, move)), lambda m: F.when(F.concat(m["origin"], m["old"]) != F.lower(m["new"]), m))


def learn(reads: DataFrame, seq: str, url: Column, final: Column) -> DataFrame:
    """(origin, old, new, seen, seq): the moves that each origin holds after all reads, in the order of ``seq``.

    A fold, since a move that newer ones pushed out starts again; an origin's state is at most RULES moves.
    """
    moves = reads.select(F.col(seq).alias("seq"), moved_prefix(url, final).alias("m")).where("m IS NOT NULL").select("m.origin", "seq", "m.old", "m.new")

    def step(rules: dict, old: str, new: str) -> tuple[dict, int]:
        held = rules.pop(old, None)
        seen = held[1] + 1 if held and held[0] == new else 1
        rules[old] = (new, seen)
        if len(rules) > RULES:
            del rules[next(iter(rules))]  # the one learned longest ago
        return rules, seen

    log = ordered_fold(moves, "origin", ["seq", "old", "new"], ["old", "new"], dict, step, "seen int")
    last = log.groupBy("origin", "old").agg(F.max_by(F.struct("new", "seen", "seq"), F.struct("seq", "new")).alias("r")).select("origin", "old", "r.*")
    newest = Window.partitionBy("origin").orderBy(F.desc("seq"), F.desc("old"))
    return last.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= RULES).drop("place")


def follow(urls: DataFrame, rules: DataFrame, url: str = "url", hops: int = HOPS) -> DataFrame:
    """urls with ``target``: where moves seen often enough lead, the longest prefix first, a few in a row; null where none applies.

    Each hop is a left join on the origin; an origin has at most RULES moves, gathered into one row.
    """
    listed = rules.where(F.col("seen") >= SEEN).groupBy("origin").agg(F.collect_list(F.struct(F.length("old").alias("n"), "old", "new")).alias("moves"))
    out = urls.withColumn("target", F.col(url))
    for _ in range(hops):
        now, path, query = F.col("target"), path_of(F.col("target")), query_of(F.col("target"))
        # a move that inserts a prefix which the path has already would insert it again
        again = lambda m: F.lower(m["new"]).startswith(F.concat(F.col("origin"), F.lit("/"))) & path.startswith(F.substr(m["new"], F.length("origin") + 1))  # noqa: E731, B023
        fit = F.filter("moves", lambda m: path.startswith(m["old"]) & ~again(m))  # noqa: B023
        best = F.get(F.sort_array(fit, asc=False), F.lit(0))
        moved = F.concat(best["new"], F.substr(path, best["n"] + 1), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
        out = out.withColumn("origin", origin_of(now)).join(listed, "origin", "left").withColumn("target", F.coalesce(moved, now)).drop("origin", "moves")
    return out.withColumn("target", F.when(F.col("target") != F.col(url), F.col("target")))
