"""Caches and memos as streaming state: what is remembered of a key, and a timer that forgets it.

Each key holds one number, when what it remembers ends; a timer of event time clears it once the watermark
has passed that, so only keys that can still answer take room. Reads of one key in one micro-batch are
put in order before they are answered; ``maxFilesPerTrigger`` of the stream bounds them. The answers are
those of the windows over the whole log (``state.cache_log``, ``state.memo_hits``), as a read that comes after its timer would
be a miss either way. Reads older than the watermark are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """State with timers needs the RocksDB store while a query starts."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _Remembering(StatefulProcessor):
    """Keeps one number a key until its time is over. ``answer`` gives a read's answer and what is remembered after it, with the second when that ends."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "number double")

    def answer(self, kept: float | None, at: float, lasts: float | None) -> tuple[object, float | None, float | None]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # plain columns: a frame's own sort and records cost more than the reads of most keys
        at, ids, lasts = (np.concatenate(c) for c in zip(*((r["at_s"].to_numpy(), r["event_id"].to_numpy(), r["lasts"].to_numpy(float)) for r in rows), strict=True))
        order = np.lexsort((ids, at))
        stood = self.kept.get()
        kept, answers, ends = stood[0] if stood else None, [], None
        for second, lasting in zip(at[order].tolist(), lasts[order].tolist(), strict=True):
            said, kept, ends = self.answer(kept, second, lasting)
            answers.append(said)
        if stood:  # only what is remembered has a timer
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if kept is not None:
            self.kept.update((kept,))
            self.handle.registerTimer(math.floor(ends * 1000) + 1)
        elif stood:
            self.kept.clear()
        yield pd.DataFrame({"event_id": ids[order], "answer": answers})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


class CacheReads(_Remembering):
    """A read is a hit up to ``ttl_s`` after the one before, stale up to ``stale_s`` more, else a miss."""

    def __init__(self, ttl_s: float, stale_s: float):
        self.ttl_s, self.stale_s = ttl_s, stale_s

    def answer(self, kept, at, lasts):
        age = math.inf if kept is None else at - kept
        said = "hit" if age <= self.ttl_s else "stale" if age <= self.ttl_s + self.stale_s else "miss"
        return said, at, at + self.ttl_s + self.stale_s


class Memos(_Remembering):
    """Whether the read before left a remark that still holds; ``lasts``: how long a read's own does, null for none."""

    def answer(self, kept, at, lasts):
        said = "memo" if kept is not None and at <= kept else "asked"
        until = None if lasts is None or math.isnan(lasts) else at + lasts
        return said, until, until


def answered(reads: DataFrame, key: str, processor: _Remembering, delay: str = "1 hour") -> DataFrame:
    """(event_id, answer) of a stream of reads (key, event_id, ts, at_s, and lasts for memos); at_s: ts in seconds."""
    return reads.withWatermark("ts", delay).groupBy(key).transformWithStateInPandas(processor, "event_id long, answer string", "append", "EventTime")
