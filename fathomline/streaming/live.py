"""Streaming forms: health of sources as keyed state, fusion that grows with every answer, late answers.

State is checkpointed in the folder that all executors share; sinks write each batch under its own
number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import ALPHA, TRIP_AFTER
from ..operators.tables import StateTable
from ..scratch import fresh_path, written


def stream_health(calls: DataFrame) -> DataFrame:
    """(provider, calls, ema_latency_ms, ema_success, streak, tripped, seen): each source's state after every batch of a stream (provider, event_id, ok, latency_ms).

    Only the state is kept between batches. A source's calls of one batch come chunk by chunk and are
    held as three numbers each until they are sorted; ``maxFilesPerTrigger`` of the stream bounds a batch.
    """

    def fold(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        calls, latency, success, streak, seen = state.get if state.exists else (0, 500.0, 1.0, 0, -1)
        parts = [(c["event_id"].to_numpy(), c["ok"].to_numpy(bool), c["latency_ms"].to_numpy(float)) for c in chunks]
        ids, good, ms = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.argsort(ids, kind="stable")
        good, ms, n = good[order], ms[order], len(order)
        # a fold of s = (1 - a) s + a x: decayed from where it stood, and from each call on
        for at in range(0, n, 256):
            x, ok = ms[at : at + 256], good[at : at + 256]
            decay = (1 - ALPHA) ** np.arange(len(x), -1, -1)
            latency = float(latency * decay[0] + ALPHA * (x * decay[1:]).sum())
            success = float(success * decay[0] + ALPHA * (ok * decay[1:]).sum())
        last = np.flatnonzero(good)
        streak = streak + n if not len(last) else int(n - 1 - last[-1])
        calls, seen = calls + n, max(seen, int(ids.max()))
        state.update((calls, latency, success, streak, seen))
        yield pd.DataFrame({"provider": [key[0]], "calls": [calls], "ema_latency_ms": [latency], "ema_success": [success], "streak": [streak], "tripped": [streak >= TRIP_AFTER], "seen": [seen]})

    kept = "calls long, latency double, success double, streak int, seen long"
    shown = "provider long, calls long, ema_latency_ms double, ema_success double, streak int, tripped boolean, seen long"
    return calls.groupBy("provider").applyInPandasWithState(fold, shown, kept, "update", "NoTimeout")


def progressive_fusion(answers: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, page, score, agreement) over all answers (query_id, provider, pos, page) so far; each arrival changes its own pages only. A page's state holds its sources by name, which are few."""
    share = F.lit(1.0) / (F.lit(float(k)) + F.col("pos") + 1)
    return answers.groupBy("query_id", "page").agg(F.sum(share).alias("score"), F.size(F.collect_set("provider")).cast("long").alias("agreement"))


def on_time(answers: DataFrame, at: str, soft_deadline: str = "90 minutes") -> DataFrame:
    """Answers an hour within the watermark; what comes after the soft deadline is left to a later merge."""
    return answers.withWatermark(at, soft_deadline).groupBy(F.window(at, "1 hour"), "provider").agg(F.count(F.lit(1)).alias("answers"))


def late_merge(fused: DataFrame, late: DataFrame, k: int = 60) -> DataFrame:
    """A fused answer (query_id, page, score, providers) with stragglers (query_id, provider, pos, page) added; both are keyed, so only touched pages move.

    ``providers`` are the names already counted; one that answered early and late counts once in ``agreement``.
    """
    more = late.groupBy("query_id", "page").agg(F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("pos") + 1)).alias("more"), F.collect_set("provider").alias("others"))
    none = F.array().cast("array<string>")
    whole = F.array_sort(F.array_union(F.coalesce("providers", none), F.coalesce("others", none)))
    return fused.join(more, ["query_id", "page"], "full_outer").select("query_id", "page", (F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"), whole.alias("providers"), F.size(whole).cast("long").alias("agreement"))


SHARE = "query_id long, page string, provider string, pos int, at timestamp"


def answer_tables(spark: SparkSession, path: str, buckets: int = 16) -> tuple[StateTable, StateTable]:
    """The answers that a fused result rests on, and the result, in buckets of the same pages."""
    by = ["query_id", "page"]
    return StateTable(spark, f"{path}/answers", [*by, "provider"], by, buckets), StateTable(spark, f"{path}/fused", by, by, buckets)


def merge_answers(answers: StateTable, fused: StateTable, batch: DataFrame, number: int, name: str = "answers", k: int = 60) -> None:
    """Puts a batch of answers (query_id, page, provider, pos, at) into both tables; only the pages it names move.

    A source that lists a page again counts once, by its newest answer. Whatever comes twice, in another
    order, or again after a failure between the two tables, leaves them as they would be.
    """
    answers.upsert(batch.select("query_id", "page", "provider", "pos", "at"), ["at", "pos"], (name, number))
    pages = batch.select("query_id", "page").distinct()
    known = answers.read(only=answers.touched(pages))
    share = F.lit(1.0) / (F.lit(float(k)) + F.col("pos") + 1)
    now = known.join(pages, ["query_id", "page"], "left_semi").groupBy("query_id", "page").agg(F.sum(share).alias("score"), F.count(F.lit(1)).alias("agreement"))
    fused.upsert(now, batch=(name, number))


def late_stream(arrivals: DataFrame, path: str, life: str = "1 hour", buckets: int = 16, name: str = "answers") -> StateTable:
    """Runs a stream of answers (see SHARE) into fused results at a path, as far as there are any now, and returns the table (query_id, page, score, agreement).

    Stragglers join what was fused without them. An answer that comes when its entry's ``life`` is over (by
    the watermark) is dropped, as is one that was seen within it.
    """
    spark = arrivals.sparkSession
    answers, fused = answer_tables(spark, path, buckets)
    fresh = arrivals.withWatermark("at", life).dropDuplicatesWithinWatermark(["query_id", "page", "provider", "pos", "at"])

    def merge(batch: DataFrame, number: int) -> None:
        # written once: a batch behind a stateful step must not be computed twice
        merge_answers(answers, fused, written(batch, "late-batch"), number, name)

    query = fresh.writeStream.outputMode("append").foreachBatch(merge).option("checkpointLocation", f"{path}/marks").trigger(availableNow=True).start()
    query.awaitTermination()
    return fused


def run_to_end(stream: DataFrame, mode: str, label: str, *arrivals: Callable[[], None]) -> DataFrame:
    """Runs a stream over what is there now; all rows it put out, with the number of their ``batch``. After each of the ``arrivals`` it goes on from where it stood."""
    spark = stream.sparkSession
    out, marks = fresh_path(spark, label), fresh_path(spark, f"{label}-marks")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def run() -> None:
        query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    for arrive in arrivals:
        arrive()
        run()
    return spark.read.parquet(out)
