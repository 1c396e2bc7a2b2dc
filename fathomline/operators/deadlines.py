"""When a fan-out stops waiting for its sources, replayed over a log of answers.

A fan-out ends at the first of: its last answer; the soft deadline, if a source has answered and enough
documents are in, and past it the answer that makes them enough, at the latest the hard deadline; a time of
grace after a quorum has answered; an answer after which enough documents are in and all sources still out
are known to be slow. Answers until then count, ties included; the others are late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOFT_S, HARD_S, MIN_DOCS, QUORUM = 1.5, 3.0, 10, 2
#: Calls after which a source's average latency is believed.
KNOWN_AFTER = 3


def _column(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def replay(answers: DataFrame, query: str, at: str, docs: str, ok: str, latency_s: str, calls: str, k: Column | int, soft_s: Column | float = SOFT_S, hard_s: Column | float = HARD_S, min_docs: Column | int = MIN_DOCS, quorum: Column | int = QUORUM, grace_s: Column | float = 0.0) -> DataFrame:
    """answers (a row a source that was asked) with ``ends_s``, the ``reason``, ``on_time`` and ``marks``: when each reason alone would have ended the fan-out.

    at: seconds from the beginning, null for a source that never answers; ok and docs: what came; latency_s and
    calls: the source's average before and the calls it rests on. A time of grace of 0 is none; one source
    alone is waited for. Nulls of ok, docs, latency and calls are no answer, 0, unknown and 0. The parameters may be columns of the answers.
    """
    soft, hard, least, enough, grace = map(_column, (soft_s, hard_s, min_docs, quorum, grace_s))
    hard = F.greatest(hard, soft)
    good = F.coalesce(F.col(ok), F.lit(False)) & (F.coalesce(F.col(docs), F.lit(0)) > 0)
    slow = F.coalesce((F.col(calls) >= KNOWN_AFTER) & (F.col(latency_s) >= soft), F.lit(False))
    every, until = Window.partitionBy(query), Window.partitionBy(query).orderBy(F.col(at).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    number, some = (lambda c: F.sum(c.cast("long"))), (lambda c: F.coalesce(c, F.lit(0)))
    docs_of = F.when(good, F.col(docs)).otherwise(0)
    t = F.col(at)
    seen = answers.withColumns({"n_": F.count(F.lit(1)).over(every), "answered_": number(good & t.isNotNull()).over(until), "docs_": F.sum(F.when(t.isNotNull(), docs_of)).over(until), "came_": F.count(t).over(until), "known_": number(slow).over(every), "slow_came_": number(slow & t.isNotNull()).over(until)})
    # of those still out, all are known to be slow
    out, slow_out = F.col("n_") - F.col("came_"), F.col("known_") - F.col("slow_came_")
    row = {
        "predicted": (F.col("answered_") >= 1) & (F.col("docs_") >= _column(k)) & (out > 0) & (out == slow_out) & (F.col("n_") >= 2),
        "soft": (t >= soft) & (F.col("answered_") >= 1) & (F.col("docs_") >= least) & (F.col("n_") >= 2),
        "hard": (t >= hard) & (F.col("answered_") >= 1) & (F.col("n_") >= 2),
    }
    first = lambda condition, when=t: F.min(F.when(condition & t.isNotNull(), when)).over(every)
    by = lambda limit: (some(number(good & (t <= limit)).over(every)), some(F.sum(F.when(t <= limit, docs_of)).over(every)))
    (had, had_docs), (had_late, _) = by(soft), by(hard)
    several = F.col("n_") >= 2
    ends = F.struct(
        F.max(t).over(every).alias("all"), first(row["predicted"]).alias("predicted"),
        first((F.col("answered_") >= F.least(enough, F.col("n_"))) & (grace > 0) & several, t + grace).alias("grace"),
        F.least(F.when(several & (had >= 1) & ((had_docs >= least) | (soft >= hard)), soft), first(row["soft"])).alias("soft"), F.least(F.when(several & (had_late >= 1), hard), first(row["hard"])).alias("hard"),
    )
    found = seen.withColumn("ends_", ends)
    names = ["all", "predicted", "grace", "soft", "hard"]
    # a source that never answers keeps the fan-out from being complete
    complete = F.count(t).over(every) == F.col("n_")
    found = found.withColumn("all_", F.when(complete, F.col("ends_.all")))
    marks = [F.col("all_"), *[F.col(f"ends_.{n}") for n in names[1:]]]
    found = found.withColumn("ends_s", F.coalesce(F.least(*marks), F.col("ends_.all")))
    reason = F.coalesce(*[F.when(m == F.col("ends_s"), n) for n, m in zip(names, marks, strict=True)], F.lit("all"))
    on_time = F.coalesce(t <= F.col("ends_s"), F.lit(False))
    found = found.withColumn("marks", F.struct(*[m.alias(n) for n, m in zip(names, marks, strict=True)]))
    return found.withColumn("reason", reason).withColumn("on_time", on_time).drop("n_", "answered_", "docs_", "came_", "known_", "slow_came_", "ends_", "all_")
