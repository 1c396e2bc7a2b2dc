"""Lighter page forms, redirects, refusals, waits, places and prices on single cases."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions import asking, money, net
from fathomline.operators import redirects
from fathomline.sources import lean, listings


def one(spark, rows, ddl, column):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else [(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}").orderBy("i").select(column).collect()]


def test_refused_targets(spark):
    urls = ["http://169.254.169.254/x", "http://[::ffff:a9fe:a9fe]/", "http://[fe80::1]/", "http://[::]/", "file:///etc", "foo", "", None, "http://127.0.0.1/", "http://[::1]/", "https://169.254.example.com/"]
    want = ["link_local:169.254.169.254", "link_local:169.254.169.254", "link_local:fe80::1", "unspecified:::", "scheme:file", "scheme:none", "scheme:none", None, None, None, None]
    assert one(spark, urls, "u string", net.refused_target(F.col("u"))) == want


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        ("https://h.com/a/b", "c", "https://h.com/a/c"), ("https://h.com/a/b/", "../c?x=1", "https://h.com/a/c?x=1"), ("https://h.com", "c", "https://h.com/c"), ("https://h.com/a", "//o.com/x", "https://o.com/x"),
        ("https://h.com/a", "https://o.com", "https://o.com"), ("https://h.com/a/b?q", "#f", "https://h.com/a/b#f"), ("https://h.com/a/b", "../../../c", "https://h.com/c"), ("https://h.com/a/b/c", "..", "https://h.com/a/"),
    ],
)
def test_resolved(spark, base, link, want):
    assert spark.range(1).select(net.resolved(F.lit(base), F.lit(link))).first()[0] == want


def test_meta_refresh_first_tag_decides(spark):
    pages = ['<meta http-equiv=refresh><meta http-equiv=refresh content="0;url=/b">', '<meta http-equiv="refresh" content="0; /c">', "<meta http-equiv='refresh' content='5.0, URL = /d'>", '<meta http-equiv="refresh" content="5.1;url=/e">', None]
    assert one(spark, pages, "h string", net.meta_refresh(F.lit(200), F.lit("text/html"), F.col("h"), F.lit("https://h.com/a"))) == [None, "https://h.com/c", "https://h.com/d", None, None]
    assert spark.range(1).select(net.meta_refresh(F.lit(404), F.lit("text/html"), F.lit(pages[1]), F.lit("https://h.com/a"))).first()[0] is None


def test_charset_markdown_and_locale(spark):
    assert one(spark, ["text/html; Charset=\"UTF-8\"", "text/html", "text/html; charset=", None], "c string", net.header_charset(F.col("c"))) == ["utf-8", None, None, None]
    assert one(spark, [("text/markdown", ""), ("text/plain", "\n# A"), ("text/plain", "A"), ("text/html", "# A"), (None, None)], "c string, b string", net.is_markdown(F.col("c"), F.col("b"))) == [True, True, False, False, False]
    got = one(spark, ["zh_hant_TW", "en", "a", "x" * 40, None], "t string", asking.locale_of(F.col("t")))
    assert [tuple(g) if g else None for g in got] == [("zh-Hant-TW", "tw"), ("en", None), None, None, None]


def test_offer_prices(spark):
    offers = ['{"price":1.299}', '{"price":"1.299"}', '{"price":0,"highPrice":5}', '{"price":"","lowPrice":"12,50","priceCurrency":"eur"}', '{"price":"from $9"}', "{}", "not json", None, '{"priceSpecification":{"price":"7"},"priceCurrency":"US DOLLARS"}']
    got = [(g and (g["amount"], g["currency"])) for g in one(spark, offers, "o string", money.price_from_offer(F.col("o")))]
    assert got[:6] == [(1.299, "USD"), (1299.0, "USD"), (0.0, "USD"), (12.5, "EUR"), (9.0, "USD"), (None, "USD")]
    assert got[8] == (7.0, "USD") and all(g is None or g[0] is None for g in got[6:8])


def test_redirects_restart_and_are_pushed_out(spark):
    moves = [(f"https://o.com/a/{i}", f"https://n.com/b/{i}") for i in range(3)] + [("https://o.com/a/9", "https://m.com/b/9")]
    moves += [(f"https://p.com/{c}/x", f"https://q.com/{c}2/x") for c in "abcdefghi"] + [("https://p.com/a/y", "https://q.com/a2/y")]
    moves += [("https://o.com/z", "https://n.com/login"), ("https://o.com/s/", "https://n.com/s"), ("https://o.com/k?x=1", "https://n.com/k")]
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(moves)], "i long, a string, b string")
    learned = {(r.origin, r.old): (r.new, r.seen) for r in redirects.learn(rows, "i", F.col("a"), F.col("b")).collect()}
    assert learned.pop(("https://o.com", "/a/")) == ("https://m.com/b/", 1)
    # b was pushed out by a's second coming, which counts as the first
    assert learned == {("https://p.com", f"/{c}/"): (f"https://q.com/{c}2/", 1) for c in "cdefghia"}
    assert redirects.learn(rows.limit(0), "i", F.col("a"), F.col("b")).count() == 0


def test_follow_never_inserts_twice(spark):
    rules = spark.createDataFrame([("https://o.com", "/", "https://o.com/en/", 5)], "origin string, old string, new string, seen int")
    urls = spark.createDataFrame([("https://o.com/a?q=1",), ("https://o.com/en/a",), (None,)], "url string")
    assert {r.url: r.target for r in redirects.follow(urls, rules).collect()} == {"https://o.com/a?q=1": "https://o.com/en/a?q=1", "https://o.com/en/a": None, None: None}


def test_source_titles(spark):
    texts = ["---\ntitle: 'A b' \nx: 1\n---\n# C", "intro\n# Head {#id}\n", "Name\n====\ntext", "plain", "# T (/docs/t)", ""]
    assert one(spark, texts, "t string", lean.source_title(F.col("t"), F.lit("the-page_name"))) == ["A b", "Head", "Name", "The page name", "T", "The page name"]


def test_lean_pages_fall_back_and_fail(spark):
    pages = spark.createDataFrame([(1, "https://github.com/a/b/tree/main/x"), (2, "https://github.com/a/b/pull/3"), (3, "https://example.com/"), (4, None), (5, "https://www.science.org/doi/10.1126/abc.1")], "page_id long, url string")
    found = lean.targets(pages)
    assert {r.page_id for r in found.collect()} == {1, 2, 5}
    listing = '[{"name":"b","type":"file"},{"name":"Z","type":"dir"},{"name":"A","type":"file"}]'
    bodies = [("https://api.github.com/repos/a/b/contents/x?ref=main", listing), ("https://api.github.com/repos/a/b/issues/3", '{"title":"T"}'), ("https://api.crossref.org/works/10.1126/abc.1", '{"message":{"title":["T <i>x</i>"],"abstract":"<p>A</p>"}}')]
    got = {r.page_id: (r.title, r.text) for r in lean.read(found, spark.createDataFrame(bodies, "lean_url string, body string")).collect()}
    # the pull request's comments were not fetched, and it has no other candidate
    assert got == {1: ("a/b/x at main", "# a/b/x (main)\n\n- Z/\n- A\n- b"), 5: ("T x", "# T x\n\nDOI: 10.1126/abc.1\n\n## Abstract\n\nA")}


def test_jsonld_reads_lists_and_declared_prices(spark):
    ld = '<script type="application/ld+json">%s</script>'
    pages = [(1, "https://s.com/p/1", ld % '{"@type":["Product"],"name":"A","url":"/p/a","brand":"Acme","offers":[{"price":"1.299,00","priceCurrency":"EUR","availability":"http://schema.org/InStock"}]}'), (2, "https://s.com/p/2", ld % '{"@type":"Product","name":"B"}' + '<meta itemprop="price" content="$5">'), (3, "https://s.com/p/3", "no data"), (4, None, None), (5, "https://s.com/p/5", ld % "{broken")]
    got = {r.page_id: (r.title, r.url, r.amount, r.currency, r.brand, r.availability) for r in listings.jsonld_items(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: ("A", "https://s.com/p/a", 1299.0, "EUR", "Acme", "InStock"), 2: ("B", "https://s.com/p/2", 5.0, "USD", None, "")}
