"""Adaptive state replayed over logs: health, breaker, rates, buckets, profiles, caches.

Breakers are windows. Averages, rates, buckets and tiers are scans (see ``scans``): a long log is folded in parts,
side by side. States that are no numbers go through ``ordered_fold``: rows are hash-partitioned by key, sorted
by time, and folded as they stream through the task, so a key's log is never gathered in memory. What needs no
order (counters, profiles) is a plain aggregation; what needs only neighbours is a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .routing import cooldown_s
from .scans import Fold, at_least, at_most, linear, scan_fold, then

ALPHA, TRIP_AFTER = 0.3, 3
ADDITIVE, BACKOFF, FLOOR = 0.05, 0.5, 0.1


def ordered_fold(rows: DataFrame, key: str, order: list[str], reads: list[str], start: Callable[[], object], step: Callable[..., tuple], added: str) -> DataFrame:
    """All rows, in order within their key, with what ``step(state, *reads)`` finds for each: (state, *added); added: DDL of the new columns.

    Only the columns read leave the Arrow batch, as plain lists.
    """
    extra = StructType.fromDDL(added)
    schema = StructType(rows.schema.fields + extra.fields)
    names, new = rows.columns, extra.fieldNames()
    kinds = [_arrow(extra[n].dataType.simpleString()) for n in new]

    def folded(batches):
        key_now, state = object(), None
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in new)
            for k, *values in zip(batch.column(key).to_pylist(), *(batch.column(c).to_pylist() for c in reads), strict=True):
                if k != key_now:
                    key_now, state = k, start()
                state, *found = step(state, *values)
                for column, value in zip(out, found, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], names=[*names, *new])

    return rows.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(folded, schema)


def _arrow(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}[kind]


def average_log(calls: DataFrame, key: str, order: list[str], ok: str, latency_ms: str) -> DataFrame:
    """The log with the running averages of latency and success after each call, in the order of the calls."""

    def step(state, good, ms):
        latency, success = state
        state = (1 - ALPHA) * latency + ALPHA * ms, (1 - ALPHA) * success + ALPHA * (1.0 if good else 0.0)
        return state, *state

    moves = lambda _, row: (linear(1 - ALPHA, ALPHA * row[1]), linear(1 - ALPHA, ALPHA if row[0] else 0.0))
    fold = Fold(lambda: (500.0, 1.0), step, tuple, moves, lambda numbers, _: numbers)
    return scan_fold(calls, key, order, [ok, latency_ms], fold, "ema_latency_ms double, ema_success double")


def breaker_log(calls: DataFrame, key: str, order: list[str], ok: str) -> DataFrame:
    """The log with its failure streak, trips since the last success, and whether each call tripped the breaker."""
    good = F.sum(F.col(ok).cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    streak = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(key, "good").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    rows = calls.withColumn("good", good).withColumn("streak", streak).drop("good")
    return rows.withColumn("trips", F.greatest(F.col("streak") - (TRIP_AFTER - 1), F.lit(0))).withColumn("tripped", F.col("streak") >= TRIP_AFTER)


def health_log(calls: DataFrame, key: str, order: list[str], ok: str, latency_ms: str) -> DataFrame:
    """The log with running averages, failure streak, trips and whether each call tripped the breaker."""
    return breaker_log(average_log(calls, key, order, ok, latency_ms), key, order, ok)


def health_report(calls: DataFrame, key: str, order: list[str], ok: str, latency_ms: str, base_s: float = 15.0) -> DataFrame:
    """(key, ema_latency_ms, ema_success, streak, calls, open, cooldown_s) of each source after its last call, in short figures."""
    log = health_log(calls, key, order, ok, latency_ms)
    last = F.struct(*order, "ema_latency_ms", "ema_success", "streak", "trips", "tripped")
    found = log.groupBy(key).agg(F.max(last).alias("s"), F.count(F.lit(1)).alias("calls"))
    return found.select(key, F.round("s.ema_latency_ms", 1).alias("ema_latency_ms"), F.round("s.ema_success", 3).alias("ema_success"), F.col("s.streak").cast("long").alias("streak"), "calls", F.col("s.tripped").alias("open"), F.when(F.col("s.tripped"), cooldown_s(F.lit(0.0), F.lit(base_s), F.col("s.trips"))).otherwise(0.0).alias("cooldown_s"))


def aimd_log(calls: DataFrame, key: str, order: list[str], ok: str, rps: float = 0.75, max_rps: float = 4.0) -> DataFrame:
    """The log with the rate after each call: a step up on success, half on a block."""

    def step(rate, good):
        rate = min(max_rps, rate + ADDITIVE) if good else max(FLOOR, rate * BACKOFF)
        return rate, rate

    up, down = then(linear(1.0, ADDITIVE), at_most(max_rps)), then(linear(BACKOFF, 0.0), at_least(FLOOR))
    fold = Fold(lambda: rps, step, lambda rate: (rate,), lambda _, row: (up if row[0] else down,), lambda numbers, _: numbers[0])
    return scan_fold(calls, key, order, [ok], fold, "rate double")


def token_bucket_log(calls: DataFrame, key: str, order: list[str], seconds: str, rate: float = 0.75, burst: float = 3.0) -> DataFrame:
    """The log with the tokens left and whether each call was let through at once; ``seconds``: time as a number."""

    def step(state, now):
        tokens, at = state
        tokens = burst if at is None else min(burst, tokens + (now - at) * rate)
        admitted = tokens >= 1.0
        wait = 0.0 if admitted else (1.0 - tokens) / rate
        tokens -= 1.0 if admitted else 0.0
        return (tokens, now), tokens, admitted, wait

    # tokens lie between none and all, so the pieces stay few
    some, full, taken = at_least(0.0), at_most(burst), [(-math.inf, 1.0, 0.0), (1.0, 1.0, -1.0)]
    moves = lambda before, row: (then(then(some, linear(1.0, (row[0] - before[0]) * rate)), then(full, taken)),)
    fold = Fold(lambda: (burst, None), step, lambda state: state[:1], moves, lambda numbers, last: (numbers[0], last[0]))
    return scan_fold(calls, key, order, [seconds], fold, "tokens double, admitted boolean, wait_s double")


def profile_log(fetches: DataFrame, key: str, order: list[str], ok: str, tier: str) -> DataFrame:
    """The log with the lowest tier that a domain is believed to need after each fetch."""

    def step(lowest, good, t):
        lowest = min(lowest, t) if good else max(lowest, min(t + 1, 2))
        return lowest, lowest

    moves = lambda _, row: (at_most(row[1]) if row[0] else at_least(min(row[1] + 1, 2)),)
    fold = Fold(lambda: 0, step, lambda lowest: (lowest,), moves, lambda numbers, _: int(numbers[0]))
    return scan_fold(fetches, key, order, [ok, tier], fold, "min_tier int")


#: What happens to a limiter, beside calls that ask for a token.
EVENTS = ["spend", "success", "block", "snapshot", "refund", "configure", "seed"]


def limiter_log(events: DataFrame, key: str, order: list[str], seconds: str, kind: str, rps: str, burst: str, default_rps: float = 0.75, default_burst: float = 3.0, max_rps: float = 4.0) -> DataFrame:
    """The log of mixed events with ``rate``, ``tokens``, ``ceiling`` and ``admitted`` (of calls that spend) after each.

    spend takes a token if there is one; success and block move the rate up to its ceiling and down, a block
    also takes all tokens; snapshot notes rate and tokens, and refund gives back what a block has taken since,
    less one token; configure sets a rate (``rps``) and burst of its own and with them the ceiling; seed starts
    at a rate learned elsewhere, without tokens, if it is below the default. Unknown kinds only let time pass.
    """

    def step(state, now, what, own_rps, own_burst):
        rate, size, tokens, at, ceiling, noted = state
        refilled = min(size, tokens + (now - at) * rate) if at is not None else tokens
        admitted = None
        if what not in ("block", "success", "configure", "seed"):
            tokens, at = refilled, now
        if what == "spend":
            admitted = tokens >= 1.0
            tokens -= 1.0 if admitted else 0.0
        elif what == "success":
            rate = min(ceiling, rate + ADDITIVE)
        elif what == "block":
            rate, tokens, at = max(FLOOR, rate * BACKOFF), 0.0, now
        elif what == "snapshot":
            noted = (rate, tokens)
        elif what == "refund" and noted is not None:
            rate, tokens = max(rate, noted[0]), min(size, tokens + noted[1] - 1.0)
        elif what == "configure":
            rate, size = max(FLOOR / 10, own_rps), max(float(own_burst), 1.0)
            tokens, at, ceiling = size, now, own_rps if own_rps < default_rps else max(own_rps, max_rps)
        elif what == "seed" and own_rps < default_rps:
            rate, tokens, at = max(FLOOR, own_rps), 0.0, now
        state = (rate, size, tokens, at if at is not None else now, ceiling, noted)
        return state, rate, tokens, ceiling, admitted

    return ordered_fold(events, key, order, [seconds, kind, rps, burst], lambda: (default_rps, default_burst, default_burst, None, max_rps, None), step, "rate double, tokens double, ceiling double, admitted boolean")


def block_rates(fetches: DataFrame, key: str, ok: Column) -> DataFrame:
    """(key, successes, blocks, block_rate), most fetched first by ``place``."""
    good, bad = F.sum(ok.cast("long")), F.sum((~ok).cast("long"))
    return fetches.groupBy(key).agg(good.alias("successes"), bad.alias("blocks"), F.coalesce(F.try_divide(bad.cast("double"), good + bad), F.lit(0.0)).alias("block_rate"))


def cache_log(reads: DataFrame, key: str, at: Column, ttl_s: float, stale_s: float) -> DataFrame:
    """Each read of a key with how a cache filled by the read before would answer: hit, stale or miss."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, "event_id"))
    age = at - before
    return reads.withColumn("age_s", age).withColumn("answer", F.when(age <= ttl_s, "hit").when(age <= ttl_s + stale_s, "stale").otherwise("miss"))


def newest(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each key."""
    return rows.withColumn("age_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("age_rank") <= n)


def recovered_rate(rate: Column, idle_s: Column, ceiling: float = 4.0) -> Column:
    """A learned rate after a pause."""
    return F.least(F.lit(ceiling), rate + idle_s * 0.005)


def link_down(failures: DataFrame, at: Column, kind: str, provider: str, within_s: int = 5) -> DataFrame:
    """The failures, and whether another provider failed in the same way within the time before: a fault of the link then.

    Every row stands in its own time bucket and, as history, in the next, so a window spans two
    buckets of one kind of failure, however many failures of that kind there are.
    """
    own = F.floor(at / within_s)
    rows = failures.withColumn("t", at).withColumn("bucket", F.explode(F.array(own, own + 1)))
    near = Window.partitionBy(kind, "bucket").orderBy("t").rangeBetween(-within_s, 0)
    seen = rows.withColumn("link_down", F.min(provider).over(near) != F.max(provider).over(near))
    return seen.where(F.floor(F.col("t") / within_s) == F.col("bucket")).drop("t", "bucket")


# How a tier's verdict leads on. A wall or a thin page climbs; what no tier mends stops.
CLIMBS = ["blocked", "thin", "js_required", "empty_mount"]


def climbed(attempts: DataFrame, key: str) -> DataFrame:
    """(key, tier, verdict, text_len, answered): of the attempts (key, tier, verdict, text_len) on a page the one that answers: the lowest tier that is ok; else, of thin pages, the longest text; else the last that was tried.

    Attempts above one that ended the climb (neither ok nor of CLIMBS) are not looked at.
    """
    ends = F.min(F.when((F.col("verdict") != "ok") & ~F.col("verdict").isin(CLIMBS), F.col("tier"))).over(Window.partitionBy(key))
    seen = attempts.withColumn("ends", ends).where(F.col("ends").isNull() | (F.col("tier") <= F.col("ends")))
    rank = F.when(F.col("verdict") == "ok", F.struct(F.lit(0).alias("r"), F.col("tier").alias("t"))).when(F.col("verdict").isin("thin", "empty_mount"), F.struct(F.lit(1).alias("r"), (-F.col("text_len")).alias("t"))).otherwise(F.struct(F.lit(2).alias("r"), (-F.col("tier")).alias("t")))
    best = seen.groupBy(key).agg(F.min(F.struct(rank.alias("rank"), "tier", "verdict", "text_len")).alias("b"))
    return best.select(key, "b.tier", "b.verdict", "b.text_len", (F.col("b.rank.r") < 2).alias("answered"))


def seeded(snapshots: DataFrame, key: str, at: Column, now_s: Column, ceiling: float = 4.0) -> DataFrame:
    """Rate limiters as a new process starts them: the last rate learned of each key, recovered for the time since, and no tokens, so a restart is no burst."""
    last = snapshots.withColumn("at_s", at).groupBy(key).agg(F.max_by("rate", "at_s").alias("learned"), F.max("at_s").alias("at_s"))
    return last.select(key, recovered_rate(F.col("learned"), F.greatest(now_s - F.col("at_s"), F.lit(0.0)), ceiling).alias("rate"), F.lit(0.0).alias("tokens"))


def memo_hits(reads: DataFrame, key: str, at: str, lasts: Column, order: str) -> DataFrame:
    """Reads with ``memo``: whether the read before left a remark (a failure that lasts so many seconds; null for none) that still holds."""
    w = Window.partitionBy(key).orderBy(at, order)
    until = F.lag(F.when(lasts.isNotNull(), F.col(at) + lasts)).over(w)
    return reads.withColumn("memo", F.coalesce(F.col(at) <= until, F.lit(False)))


def with_stale_if_error(log: DataFrame, ok: Column, stale_s: float) -> DataFrame:
    """A cache log (age_s, answer) in which a failed fetch is answered by what is not too old: ``stale_if_error``; else ``error``."""
    return log.withColumn("answer", F.when((F.col("answer") == "miss") & ~ok, F.when(F.col("age_s") <= stale_s, "stale_if_error").otherwise("error")).otherwise(F.col("answer")))


def covering_entries(asks: DataFrame, entries: DataFrame, key: str, ttl_s: float) -> DataFrame:
    """asks (ask_id, key, at_s, k) with the cache ``entry`` that answers each, null for none: its first k rows are the answer.

    entries (entry, key, at_s, k): what was remembered of a key, each with the number of results it was made
    for. An entry never gives way to a narrower one, so a key holds the widest so far, the newest of those; it
    answers for ``ttl_s`` seconds whoever asks for no more than it has. Both sides meet by time, in one pass.
    """
    both = entries.select(F.col(key).alias("key"), "at_s", F.lit(0).alias("kind"), F.col("k").cast("long").alias("k"), F.col("entry"), F.lit(None).cast(dict(asks.dtypes)["ask_id"]).alias("ask_id")).unionByName(
        asks.select(F.col(key).alias("key"), "at_s", F.lit(1).alias("kind"), F.col("k").cast("long").alias("k"), F.lit(None).cast(dict(entries.dtypes)["entry"]).alias("entry"), "ask_id"))
    until = Window.partitionBy("key").orderBy("at_s", "kind", "entry").rowsBetween(Window.unboundedPreceding, 0)
    held = F.max(F.when(F.col("kind") == 0, F.struct("k", "at_s", "entry"))).over(until)
    asked = both.withColumn("held", held).where("kind = 1")
    covers = (F.col("held.k") >= F.col("k")) & (F.col("at_s") - F.col("held.at_s") <= ttl_s)
    return asked.select("ask_id", F.col("key").alias(key), "at_s", "k", F.when(covers, F.col("held.entry")).alias("entry"))
