"""Scans in parts against the fold in one piece."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import scans, state


def log(spark, n=6000, hot=0.4, seed=3):
    draw = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += draw.choice([0.0, 0.1, 0.5, 1.0, 7.0])
        key = "hot" if draw.random() < hot else draw.choice(["a", "b", None, "c", "d"])
        rows.append((i, key, at, draw.random() < 0.7, draw.uniform(1, 900), draw.randrange(3)))
    return rows, spark.createDataFrame(rows, "seq long, k string, at double, ok boolean, ms double, tier int").repartition(7)


def in_one_piece(rows, start, step):
    states, out = {}, {}
    for seq, key, *values in rows:
        s, *found = step(states.get(key, start), *values)
        states[key], out[seq] = s, found
    return out


@pytest.fixture(autouse=True)
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def same(a, b):
    return a == b or (a is not None and b is not None and not isinstance(a, bool) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


def test_parts_of_a_hot_key_equal_the_whole(spark):
    rows, calls = log(spark)

    def ema(s, ok, ms):
        s = (0.7 * s[0] + 0.3 * ms, 0.7 * s[1] + 0.3 * ok)
        return s, *s

    def aimd(r, ok):
        r = min(4.0, r + 0.05) if ok else max(0.1, r * 0.5)
        return r, r

    def bucket(s, now):
        tokens = 3.0 if s[1] is None else min(3.0, s[0] + (now - s[1]) * 0.75)
        free = tokens >= 1
        return (tokens - free, now), tokens - free, free

    def tiers(low, ok, t):
        low = min(low, t) if ok else max(low, min(t + 1, 2))
        return low, low

    pick = lambda *at: [(r[0], r[1], *(r[i] for i in at)) for r in rows]
    for got, names, want in [
        (state.average_log(calls, "k", ["seq"], "ok", "ms"), ["ema_latency_ms", "ema_success"], in_one_piece(pick(3, 4), (500.0, 1.0), ema)),
        (state.aimd_log(calls, "k", ["seq"], "ok"), ["rate"], in_one_piece(pick(3), 0.75, aimd)),
        (state.token_bucket_log(calls, "k", ["seq"], "at"), ["tokens", "admitted"], in_one_piece(pick(2), (3.0, None), bucket)),
        (state.profile_log(calls, "k", ["seq"], "ok", "tier"), ["min_tier"], in_one_piece(pick(3, 5), 0, tiers)),
    ]:
        found = got.withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == len(rows) and len({r.task for r in found if r.k == "hot"}) >= 5
        for r in found:
            assert all(same(r[n], v) for n, v in zip(names, want[r.seq], strict=True)), (r, want[r.seq])


def test_maps_compose_to_maps():
    draw = random.Random(8)
    kinds = [lambda: scans.linear(draw.choice([0.0, 0.5, 0.7, 1.0]), draw.uniform(-2, 2)), lambda: scans.at_most(draw.uniform(0, 3)), lambda: scans.at_least(draw.uniform(0, 3)), lambda: [(-math.inf, 1.0, 0.0), (1.0, 1.0, -1.0)]]
    for _ in range(300):
        steps = [draw.choice(kinds)() for _ in range(draw.randint(1, 12))]
        whole = scans.SAME
        for s in steps:
            whole = scans.then(whole, s)
        halves = [scans.SAME, scans.SAME]
        for i, s in enumerate(steps):
            halves[i >= len(steps) // 2] = scans.then(halves[i >= len(steps) // 2], s)
        for x in [draw.uniform(-5, 5) for _ in range(20)]:
            plain = x
            for s in steps:
                plain = scans.value(s, plain)
            assert math.isclose(scans.value(whole, x), plain, abs_tol=1e-9) and math.isclose(scans.value(scans.then(*halves), x), plain, abs_tol=1e-9)


def test_bucket_maps_stay_small():
    whole, draw = scans.SAME, random.Random(2)
    for _ in range(20_000):
        refilled = scans.then(scans.then(scans.at_least(0.0), scans.linear(1.0, draw.choice([0.0, 0.1, 0.3, 0.9]))), scans.at_most(3.0))
        whole = scans.then(whole, scans.then(refilled, [(-math.inf, 1.0, 0.0), (1.0, 1.0, -1.0)]))
        assert len(whole) <= 12


def test_empty_logs_ties_and_clashing_names(spark):
    none = spark.createDataFrame([], "seq long, k string, ok boolean, part int")
    assert state.aimd_log(none, "k", ["seq"], "ok").columns == ["seq", "k", "ok", "part", "rate"] and state.aimd_log(none, "k", ["seq"], "ok").count() == 0
    tied = spark.createDataFrame([(1, "a", True, 5)] * 50, "seq long, k string, ok boolean, part int")
    assert sorted(round(r.rate, 6) for r in state.aimd_log(tied, "k", ["seq"], "ok").collect()) == sorted(round(min(4.0, 0.75 + 0.05 * i), 6) for i in range(1, 51))


def test_limiter_events(spark):
    said = [(0, "spend", None, None), (1, "snapshot", None, None), (1, "block", None, None), (2, "refund", None, None), (2, "spend", None, None), (3, "configure", 0.5, 1), (3, "success", None, None), (3, "spend", None, None), (3, "spend", None, None), (5, "spend", None, None), (6, "seed", 0.2, None), (6, "seed", 2.0, None), (7, "spend", None, None), (9, "odd", None, None), (9, "refund", None, None)]
    rows = spark.createDataFrame([(i, "k", float(t), w, r, b) for i, (t, w, r, b) in enumerate(said)], "seq int, k string, at double, kind string, rps double, burst int")
    got = [(round(r.rate, 6), round(r.tokens, 6), r.ceiling, r.admitted) for r in state.limiter_log(rows, "k", ["seq"], "at", "kind", "rps", "burst").orderBy("seq").collect()]
    assert got == [
        (0.75, 2.0, 4.0, True), (0.75, 2.75, 4.0, None), (0.375, 0.0, 4.0, None), (0.75, 2.125, 4.0, None), (0.75, 1.125, 4.0, True), (0.5, 1.0, 0.5, None), (0.5, 1.0, 0.5, None), (0.5, 0.0, 0.5, True), (0.5, 0.0, 0.5, False), (0.5, 0.0, 0.5, True),
        (0.2, 0.0, 0.5, None), (0.2, 0.0, 0.5, None), (0.2, 0.2, 0.5, False), (0.2, 0.6, 0.5, None), (0.75, 1.0, 0.5, None),
    ]
