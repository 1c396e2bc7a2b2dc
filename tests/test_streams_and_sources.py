"""Streaming caches and memos, captured answers, endpoints, cards."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import endpoints, state
from fathomline.scratch import fresh_path
from fathomline.sources import captures, listings, records
from fathomline.streaming import caches, live


def reads_log(draw, n):
    rows, at = [], 1_700_000_000.0
    for i in range(n):
        at += draw.choice([0, 1, 30, 200, 900])
        rows.append((i, draw.choice(["a", "b", None, "hot", "hot", "hot"]), at, datetime.datetime.fromtimestamp(at, datetime.UTC).replace(tzinfo=None), draw.choice([None, 50.0, 600.0])))
    return rows


@pytest.mark.parametrize("kind", ["cache", "memo"])
def test_streams_answer_as_the_windows(spark, tmp_path, kind):
    rows = reads_log(random.Random(4), 400)
    ddl = "event_id long, k string, at_s double, ts timestamp, lasts double"
    for i in range(0, 400, 100):
        part = rows[i : i + 100]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "reads"))
    whole = spark.createDataFrame(rows, ddl)
    if kind == "cache":
        want = {r.event_id: r.answer for r in state.cache_log(whole, "k", F.col("at_s"), 300, 600).collect()}
    else:
        want = {r.event_id: "memo" if r.memo else "asked" for r in state.memo_hits(whole, "k", "at_s", F.col("lasts"), "event_id").collect()}
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    processor = caches.CacheReads(300, 600) if kind == "cache" else caches.Memos()
    with caches.keyed_state(spark):
        got = live.run_to_end(caches.answered(stream, "k", processor, "10 minutes"), "append", f"stream-{kind}").collect()
    assert len(got) == 400 and {r.event_id: r.answer for r in got} == want and len(set(want.values())) >= 2


def test_captures_are_pruned_and_parsed(spark):
    root = fresh_path(spark, "captures")
    wiki = '{"query":{"search":[{"title":"A b","snippet":"<b>x</b>","timestamp":"2024-01-02T00:00:00Z"}]}}'
    ddg = '<a class="result__a" href="https://h.com/1">One</a><a class="result__snippet" href="x">said\nhere</a><a class="result__a" href="https://h.com/2">Two</a>'
    rows = [("wikipedia", "2024-01-01", 1, wiki), ("wikipedia", "2024-01-02", 1, '{"error":{"info":"slow down"}}'), ("ddg", "2024-01-01", 7, ddg), ("ddg", "2024-01-01", 8, ""), ("other", "2024-01-01", 1, "?"), ("crossref", "2024-01-01", 2, "not json")]
    spark.createDataFrame(rows, "provider string, day string, query long, body string").write.partitionBy(*captures.LAYOUT).text(root)
    found = captures.captures(spark, root)
    assert found.count() == 6 and found.where("provider = 'other'").first().day == datetime.date(2024, 1, 1)
    got = sorted((r.provider, str(r.day), r.query, r["rank"], r.url, r.title, r.snippet, r.refusal) for r in captures.answers(found).where("url IS NOT NULL").collect())
    assert got == [
        ("ddg", "2024-01-01", 7, 0, "https://h.com/1", "One", "said here", None), ("ddg", "2024-01-01", 7, 1, "https://h.com/2", "Two", "", None),
        ("wikipedia", "2024-01-01", 1, 0, "https://en.wikipedia.org/wiki/A_b", "A b", "x", None),
    ]
    assert {(r.provider, r.refusal) for r in captures.answers(found).where("refusal IS NOT NULL").collect()} == {("wikipedia", "slow down"), ("crossref", "no results in response")}
    plan = captures.answers(found.where("day = DATE'2024-01-01'"), ["ddg"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(provider" in plan.split("PartitionFilters:")[1].split("]")[0] and captures.answers(found, ["ddg"]).count() == 2


def test_endpoints_lead_and_are_skipped(spark):
    said = ["degraded ok", "ok ok", "empty ok", "degraded empty", "degraded empty", "degraded empty", "degraded ok", "degraded ok", "blocked ok", "ok", "", None]
    rows = spark.createDataFrame([(i, "p", s) for i, s in enumerate(said)], "seq int, k string, outcomes string")
    got = [(r.asked, r.answered, r.lead) for r in endpoints.endpoint_log(rows, "k", ["seq"], "outcomes").orderBy("seq").collect()]
    assert got == [("0 1", 1, 1), ("1", 1, 1), ("1", 1, 1), ("1 0", None, 1), ("1 0", None, 1), ("1 0", None, 1), ("1", 1, 1), ("1", 1, 1), ("1", 1, 1), ("0", 0, None), ("", None, None), ("", None, None)]
    first = spark.createDataFrame([(i, "p", "degraded empty") for i in range(20)] + [(20, "p", "degraded ok")], "seq int, k string, outcomes string")
    asked = [r.asked for r in endpoints.endpoint_log(first, "k", ["seq"], "outcomes").orderBy("seq").collect()]
    assert asked == ["0 1"] * 3 + (["0"] * 7 + ["0 1"]) * 2 + ["0"] * 2


def test_the_longest_cooled_is_probed(spark):
    log = [(0, "open", "b"), (1, "open", "a"), (5, "starved", None), (11, "starved", None), (12, "starved", None), (12, "starved", None), (21, "starved", None), (22, "close", "b"), (31, "starved", None), (31, "starved", None)]
    rows = spark.createDataFrame([(i, 1, float(t), w, s) for i, (t, w, s) in enumerate(log)], "seq int, k int, at double, kind string, source string")
    got = [r.probe for r in endpoints.starved_probes(rows, "k", ["seq"], "at", "kind", "source").orderBy("seq").collect()]
    assert got == [None, None, None, "b", "a", None, "b", None, "a", None]


def item(name, price, more=""):
    return f"data-i='{{\"name\":\"{name}\",\"price\":{price},\"id\":\"i{price}\"{more}}}'"


def test_card_links_and_distances(spark):
    far = "x" * 2991
    pages = [
        f"<div {item('One', 11)}></div><img src='/a.png'><a href=\"/img/logo\">l</a><a href=\"https://other.com/one\">o</a><a href=\"/one?x=1&amp;y=2\">One</a><p>Duluth, GA (97 mi)</p><div {item('Two', 12)}></div><a href=\"/two\">t</a><span>1,200 mi</span><b>5 miles away!</b>",
        f"<div {item('Three', 13)}></div><a href=\"/same\">s</a><div {item('Four', 14)}></div><a href=\"/same\">s</a>",
        f"<div {item('Five', 15)}></div>{far}<a href=\"/five\">s</a>", f"<div {item('Six', 16)}></div><i data-x='{{\"no\":1}}'></i><a href=\"/six\">s</a><p>(3 mi.)</p>",
        f"<div {item('Seven', 17, ',%22url%22:%22/own%22'.replace('%22', chr(34)))}></div><a href=\"/seven\">s</a>", "<a href=\"/none\">n</a><p>(5 mi)</p>", None,
    ]
    rows = records.generic_listings(spark.createDataFrame([(i, "https://shop.example.com/list", h) for i, h in enumerate(pages)], "page_id long, url string, html string")).collect()
    got = {r.name: (r.link and r.link.removeprefix("https://shop.example.com"), r.distance) for r in rows}
    assert got == {"One": ("/one?x=1&y=2", "97"), "Two": ("/two", "5"), "Three": (None, None), "Four": (None, None), "Five": (None, None), "Six": (None, "3"), "Seven": ("/own", None)}


def test_distances_of_texts():
    for said, want in {"Duluth, GA (97 mi)": "97", "(97 mi.) ": "97", "97 miles away": "97", "about 5 mi. away, sold": "5", "19,612 mi.": None, "12345 mi away": None, "(97 km)": None, "97 mi": None, "x" * 90 + " (9 mi)": None, "": None, "1 mile away": "1"}.items():
        assert records.printed_distance(said) == want, said
