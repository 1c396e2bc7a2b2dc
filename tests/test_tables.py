"""Tables of versions, late answers and deadlines."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import deadlines, state
from fathomline.operators.tables import StateTable
from fathomline.streaming import live

DDL = "k string, g long, at long, v string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), DDL)


def held(df):
    return sorted((r.k or "", r.g, r.at, r.v) for r in df.collect())


def test_upsert_retention_and_versions(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    assert t.read() is None and t.versions() == []
    assert t.upsert(rows(spark, ("a", 1, 5, "x"), ("a", 1, 3, "old"), (None, 2, 1, "null"), ("b", 1, 1, "y")), ["at"]) == 1
    assert held(t.read()) == [("", 2, 1, "null"), ("a", 1, 5, "x"), ("b", 1, 1, "y")]
    t.upsert(rows(spark, ("a", 1, 4, "older stays out"), ("b", 1, 1, "ties go to the last"), ("c", 1, 9, None)), ["at"])
    assert held(t.read()) == [("", 2, 1, "null"), ("a", 1, 5, "x"), ("b", 1, 1, "ties go to the last"), ("c", 1, 9, None)]
    assert held(t.read(1)) == [("", 2, 1, "null"), ("a", 1, 5, "x"), ("b", 1, 1, "y")]
    t.upsert(rows(spark, *[(k, 1, 10, "now") for k in ("a", "d")]), ["at"], keep=F.col("at") >= 5)
    assert {r.k for r in t.read().collect()} >= {"a", "c", "d"}
    before = held(t.read())
    assert t.vacuum(1) >= 1 and t.versions() == [3] and held(t.read()) == before and t.vacuum(1) == 0


def test_newest_of_each_group(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), ["g", "k"], by=["g"], buckets=3)
    for n in range(3):
        t.upsert(rows(spark, *[(f"k{i}", g, i, "v") for g in range(5) for i in range(n * 4, n * 4 + 4)]), ["at"], newest=(["g"], [F.desc("at"), F.asc("k")], 5))
    assert {(r.g, r.at) for r in t.read().collect()} == {(g, at) for g in range(5) for at in range(7, 12)}


def test_batches_go_in_once_and_failed_writes_are_not_seen(spark, tmp_path, monkeypatch):
    t = StateTable(spark, str(tmp_path / "t"), ["k"])
    assert t.upsert(rows(spark, ("a", 1, 1, "x")), ["at"], ("s", 0)) == 1
    assert t.upsert(rows(spark, ("a", 1, 9, "again")), ["at"], ("s", 0)) == 1 and t.upsert(rows(spark, ("a", 1, 2, "other")), ["at"], ("other", 0)) == 2
    with monkeypatch.context() as m:
        m.setattr(StateTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.upsert(rows(spark, ("a", 1, 3, "half")), ["at"], ("s", 1))
    assert held(t.read()) == [("a", 1, 2, "other")] and t.vacuum(1) == 2
    t.upsert(rows(spark, ("a", 1, 3, "whole")), ["at"], ("s", 1))
    t.upsert(rows(spark).limit(0), ["at"], ("s", 2))
    assert held(t.read()) == [("a", 1, 3, "whole")] and t.manifest()["batches"] == {"s": 2, "other": 0}


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    t.upsert(rows(spark, *[(f"k{i}", 1, 1, "x") for i in range(100)]), ["at"])
    first = t.manifest()["buckets"]
    t.upsert(rows(spark, ("k5", 1, 2, "y")), ["at"])
    second = t.manifest()["buckets"]
    assert len(first) == 8 and sum(first[b] != second[b] for b in first) == 1


def base(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def test_late_answers_in_any_order_and_twice(spark, tmp_path):
    draw = random.Random(5)
    said = [(q, f"p{draw.randrange(6)}", f"s{s}", pos, base(0)) for q in range(4) for s in range(5) for pos in range(4)]
    said = list({(q, p, s): (q, p, s, pos, at) for q, p, s, pos, at in said}.values())
    want = {}
    for q, p, _, pos, _ in said:
        score, n = want.get((q, p), (0.0, 0))
        want[q, p] = (score + 1 / (61 + pos), n + 1)
    ddl = "query_id long, page string, provider string, pos int, at timestamp"
    for n, order in enumerate([said, said[::-1], sorted(said, key=lambda r: (r[3], r[0]))]):
        answers, fused = live.answer_tables(spark, str(tmp_path / str(n)), 4)
        batches = [list(b) for b in itertools.batched(order, 17)]
        for i, b in enumerate(batches):
            live.merge_answers(answers, fused, spark.createDataFrame(b + b[:2], ddl), i)
            if i % 2:
                live.merge_answers(answers, fused, spark.createDataFrame(b, ddl), i)
        got = {(r.query_id, r.page): (r.score, r.agreement) for r in fused.read().collect()}
        assert set(got) == set(want) and all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)


def test_answers_after_the_life_of_an_entry_are_dropped(spark, tmp_path):
    ddl = "query_id long, page string, provider string, pos int, at timestamp"
    for n, row in enumerate([(1, "p", "a", 0, base(0)), (2, "q", "a", 0, base(200)), (3, "r", "a", 0, base(201)), (1, "p", "late", 0, base(10)), (3, "r", "b", 1, base(190)), (3, "r", "b", 1, base(190))]):
        spark.createDataFrame([row], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        del n
        stream = spark.readStream.schema(live.SHARE).parquet(str(tmp_path / "a"))
        fused = live.late_stream(stream, str(tmp_path / "state"), "1 hour", 2)
    assert {(r.query_id, r.agreement) for r in fused.read().collect()} == {(1, 1), (2, 1), (3, 2)}


def plain_end(asked, k, soft, hard, least, quorum, grace):
    """The loop itself, over all moments at which something happens."""
    times = sorted({a["at"] for a in asked if a["at"] is not None})
    marks = sorted({*times, soft, hard, *[t + grace for t in times]})
    due = None
    for now in marks:
        came = [a for a in asked if a["at"] is not None and a["at"] <= now]
        good = [a for a in came if a["ok"] and a["docs"] > 0]
        docs = sum(a["docs"] for a in good)
        if len(came) == len(asked):
            return now
        if len(asked) >= 2:
            if good and now >= soft and not (docs < least and now < hard):
                return now
            if grace > 0 and due is None and len(good) >= min(quorum, len(asked)):
                due = now + grace
            if due is not None and now >= due:
                return now
            out = [a for a in asked if a not in came]
            if now in times and good and docs >= k and all(a["calls"] >= 3 and a["latency"] >= soft for a in out):
                return now
    return max(times, default=None)


def test_deadlines_equal_the_loop(spark):
    draw = random.Random(12)
    asked, want = [], {}
    for q in range(400):
        own = [{"q": q, "p": p, "at": draw.choice([None, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, round(draw.uniform(0, 4), 2)]), "docs": draw.choice([0, 2, 6, 12]), "ok": draw.random() < 0.8, "latency": draw.choice([0.2, 1.5, 2.0]), "calls": draw.choice([0, 3, 9])} for p in range(draw.randint(1, 6))]
        grace = draw.choice([0.0, 0.3, 1.0])
        want[q] = plain_end(own, 10, 1.5, 3.0, 10, 2, grace)
        asked += [(q, a["p"], a["at"], a["docs"], a["ok"], a["latency"], a["calls"], grace) for a in own]
    rows = spark.createDataFrame(asked, "q int, p int, at double, docs int, ok boolean, latency double, calls int, grace double")
    for r in deadlines.replay(rows, "q", "at", "docs", "ok", "latency", "calls", 10, grace_s=F.col("grace")).collect():
        assert (r.ends_s is None) == (want[r.q] is None) and (r.ends_s is None or abs(r.ends_s - want[r.q]) < 1e-9), (r, want[r.q])
        assert r.on_time == (r.at is not None and r.at <= r.ends_s)
    odd = spark.createDataFrame([(None, None, None, None, None, None, None)], "q int, p int, at double, docs int, ok boolean, latency double, calls int")
    assert deadlines.replay(odd, "q", "at", "docs", "ok", "latency", "calls", 10).first().on_time is False


def test_entries_that_cover(spark):
    entries = [("e1", "a", 1.0, 5), ("e2", "a", 2.0, 3), ("e3", "a", 3.0, 5), ("e4", "a", 9.0, 9), ("n1", None, 1.0, 2)]
    asks = [(0, "a", 0.5, 1), (1, "a", 1.0, 5), (2, "a", 2.5, 4), (3, "a", 3.0, 5), (4, "a", 4.0, 6), (5, "a", 8.5, 2), (6, "a", 9.0, 9), (7, None, 2.0, 2), (8, "b", 1.0, 1)]
    got = state.covering_entries(spark.createDataFrame(asks, "ask_id int, q string, at_s double, k int"), spark.createDataFrame(entries, "entry string, q string, at_s double, k int"), "q", 5.0).collect()
    assert {r.ask_id: r.entry for r in got} == {0: None, 1: "e1", 2: "e1", 3: "e3", 4: None, 5: None, 6: "e4", 7: "n1", 8: None}
