"""Texts, pages and addresses that are long, deep, broken or never closed end no job and take no more than seconds."""

import time

import pytest
from pyspark.sql import functions as F

from fathomline.functions import asking, dates, markdown, money, net, text
from fathomline.operators import research
from fathomline.sources import cards, lean, listings, objects, records, serp

MEGA = 1 << 20


def fill(piece, size=MEGA):
    return piece * (size // len(piece))


def timed(make, seconds=15):
    began = time.time()
    made = make()
    assert time.time() - began < seconds
    return made


def over(spark, value, column):
    return timed(lambda: spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("c")).first()[0])


@pytest.mark.parametrize("piece", ["1,", "1 ", "1.", "1,,,,,,,,,,,,", "$1,", "1" * 999 + " ", "USD ", "$$$"])
def test_prices_of_long_numbers(spark, piece):
    got = over(spark, fill(piece) + "x", money.parse_price)
    assert got["currency"] == "USD"
    end = over(spark, fill(piece) + "; 12.50 EUR", money.parse_price)
    assert end["amount"] == 12.5 or piece in ("$1,", "1" * 999 + " ", "$$$") or end["amount"] is None


def test_a_long_amount_is_a_number(spark):
    assert over(spark, "1" + ",000" * 100, money.amount) == 1e300
    assert over(spark, "1" + ",000" * 300_000, money.amount) == float("inf") and over(spark, "1" + " 000" * 300_000, money.amount) == float("inf")


@pytest.mark.parametrize("piece", ["<title ", "<title>", "<", "<a ", "<!--", "<script", "<script>", "&lt;", "<p", "</h1 ", "<li><b>"])
def test_unclosed_tags(spark, piece):
    page = fill(piece)
    for column in (text.title_of, text.visible_text, text.strip_tags, markdown.to_markdown):
        assert over(spark, page, column) is not None
    assert over(spark, page + "<title>T</title>", text.title_of) in ("T", "")


@pytest.mark.parametrize("piece", ["<a href='/marketplace/item/7'>", '<a href="/marketplace/item/7" ', "<a class=\"result__a\" href='h'>", '<a class="', "<li class=b_algo>", "<item>", '<script type="application/ld+json">', "<td class=result__snippet>"])
def test_unclosed_results_and_cards(spark, piece):
    pages = spark.createDataFrame([(1, "https://h.com/", fill(piece, MEGA // 4))], "page_id long, url string, html string")
    timed(lambda: cards.dom_cards(pages).count())
    timed(lambda: listings.jsonld_items(pages).count())
    for parse in (serp.ddg_html, serp.ddg_lite, serp.bing_html, serp.bing_rss):
        timed(lambda p=parse: p(pages.select(F.col("page_id").alias("query_id"), F.col("html").alias("body"))).count(), 30)


def state(body):
    return f"<script>var s = {body};</script>"


@pytest.mark.parametrize("body", [
    '{"a":' * 100_000 + "1" + "}" * 100_000, '{"a":' * 100_000, '{"a":[' * 3000 + "1" + "]}" * 3000, fill("{"), fill('{"'), fill('{"a":1,'), '{"price":' + "9" * 5000 + "}", fill('{"name":"x","price":'), fill("<script"), fill("<script>"), fill(" data-x='"), fill(" data-x='{"), fill('"totalCount":'), fill("totalCount "),
])
def test_page_state_of_any_shape(spark, body):
    good = '<script>{"name":"Good item","price":5,"id":"abc"}</script>'
    pages = spark.createDataFrame([(1, "https://h.com/", good + state(body)), (2, "https://h.com/", good + body)], "page_id long, url string, html string")
    found = timed(lambda: records.page_objects(pages).select("page_id", "names").collect(), 30)
    assert {r.page_id for r in found if r.names == ["Good item"]} == {1, 2}
    timed(lambda: records.result_counts(pages).collect())


def test_an_item_below_the_depth_is_not_looked_at(spark):
    item = '{"name":"Deep","price":5,"id":"abc"}'
    nested = lambda n: state('{"a":' * n + item + "}" * n)
    pages = spark.createDataFrame([(n, "https://h.com/", nested(n)) for n in (0, 60, 70)], "page_id long, url string, html string")
    assert {r.page_id for r in records.page_objects(pages).collect()} == {0, 60}


def test_halves_of_surrogate_pairs(spark):
    body = '{"name":"Cut \\ud83d","price":5,"id":"a\\udc00"},{"name":"Whole \\ud83d\\ude00","price":6,"id":"b"}'
    rows = records.page_objects(spark.createDataFrame([(1, "https://h.com/", state(body))], "page_id long, url string, html string")).collect()
    assert sorted(n for r in rows for n in r.names) == ["Cut �", "Whole 😀"]


def test_several_data_attributes_of_both_quotes():
    html = """<div data-a='{"x":1}' data-b="{&quot;y&quot;:2}" data-c='no' data-d='{"z":3}'></div><script type="application/ld+json">{"w":4}</script><script>{"v":5}</script><script>{"u":6}"""
    assert list(records.json_in(html)) == [{"x": 1}, {"y": 2}, {"z": 3}, {"v": 5}]


def test_marks_before_broken_objects():
    assert objects.objects_after('"m": {"a":1} "m":{"b":' + '{"b":' * 50_000 + ' "m":{"c":2}', '"m":') == ['{"a":1}']
    assert objects.objects_after('"m": {"a":1 "m":  {"c":2}', '"m":') == ['{"c":2}']


@pytest.mark.parametrize("url", ["https://kubernetes.io/docs/" + "a/" * 100_000 + "p", "https://gitlab.com/" + "g/" * 100_000 + "p", "https://github.com/o/r/blob/" + "x/" * 100_000, "https://en.wikipedia.org/wiki/" + "(" * MEGA, "https://www.biorxiv.org/content/10.1101/" + "1." * 500_000])
def test_long_addresses(spark, url):
    rows = spark.createDataFrame([(1, url)], "page_id long, url string")
    timed(lambda: lean.targets(rows).collect())
    timed(lambda: rows.select(net.doi_in_url(F.col("url"))).collect())


def test_words_and_links(spark):
    for piece in ("[a](", "](", "https://", "http", "[", "1 week ", "ago ", "under $", "-a"):
        for column in (text.is_commerce, dates.age_days, lambda c: asking.locale_of(c)["locale"], net.doi_in_url, lambda c: F.size(research.markdown_links(c)), lambda c: F.size(research.bare_links(c))):
            over(spark, fill(piece, MEGA // 8), column)


def test_links_of_a_text(spark):
    said = "see [a](https://x.com/1) and [b [c](http://y.com/(2) (https://no.com) https://z.com/p?q=1, <http://w.com> [d](ftp://v.com) [e] (https://u.com \"https://t.com\" xhttps://s.com"
    row = spark.createDataFrame([(said,)], "t string").select(research.markdown_links(F.col("t")).alias("m"), research.bare_links(F.col("t")).alias("b")).first()
    assert row.m == ["https://x.com/1", "http://y.com/(2"]
    assert row.b == ["https://z.com/p?q=1,", "http://w.com", "https://t.com"]


def test_dois_of_addresses(spark):
    want = {
        "https://h.com/doi/10.1000/xyz/full": "10.1000/xyz", "https://h.com/doi/10.1000/a/b.pdf": "10.1000/a/b", "https://h.com/doi:10.1000/ab&x=1": "10.1000/ab", "https://h.com/10.1000/x": None, "https://h.com/10.1000": None, "https://h.com/10.1000/abs": "10.1000/abs",
        "https://h.com/10.1000/one/pdf/html/?q": "10.1000/one", "https://h.com/a": None,
    }
    rows = spark.createDataFrame([(u,) for u in want], "u string").select("u", net.doi_in_url(F.col("u")).alias("d")).collect()
    assert {r.u: r.d for r in rows} == want


def test_engines_and_shopping(spark):
    engines = {"5L V-8 Gas": True, "315 hp 2.3L I4": True, "8-Cylinder": True, "Flat-6": True, "2.0 L Turbo": True, "Gasoline": False, "Red": False, "V": False, "W12": True, "x" * 61 + " V8": False, "Model 3": False}
    assert {r.t: r.e for r in spark.createDataFrame([(t,) for t in engines], "t string").select("t", records.is_engine(F.col("t")).alias("e")).collect()} == engines
    asked = {"bikes for sale": True, "buying a car": True, "buy-in": False, "under $500": True, "under 500k": True, "underground 5": False, "costs $5": True, "price of oil": True, "in-stock": False, "discounted": False, "COUPON!": True, "why": False}
    assert {r.t: r.e for r in spark.createDataFrame([(t,) for t in asked], "t string").select("t", text.is_commerce(F.col("t")).alias("e")).collect()} == asked
