"""Markdown, cards, captions, cookies and links on odd input."""

from pyspark.sql import functions as F

from fathomline.functions import markdown, net
from fathomline.operators import research
from fathomline.sources import cards, serp, video


def column(spark, values, made, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", made(F.col("v")).alias("x")).orderBy("i").collect()]


def test_markdown_keeps_structure(spark):
    page = """<html><head><title>T</title><style>x{}</style></head><body><nav>menu</nav><h1 class=a>Big &amp; small</h1><p>One
      <b>bold</b> and <a href="/x">link</a>.</p><ul><li>first</li><li> second</li></ul><table><tr><th>a</th><td>b</td></tr></table><script>if (a<b) {}</script><!-- note --><h2>Next</h2>end<footer>f</footer></body></html>"""
    got = column(spark, [page, None, "", "plain", "<script>" * 30_000 + "x", "<p>" * 50_000 + "deep"], markdown.to_markdown)
    assert got[0] == "# Big & small\n\nOne **bold** and link.\n\n- first\n\n- second\n\n| a | b |\n\n## Next\n\nend"
    assert got[1:] == [None, "", "plain", "", "deep"]
    assert column(spark, ["abc", "abcdef", None], lambda c: markdown.excerpt(c, 4)) == ["abc", "[the first 4 of 6 characters]\n\nabcd", None]


def test_card_fields(spark):
    spans = [["Sold", "$65", "$80", "A bike", "red", "Salem, OR", "Ships to you"], ["Free", "Sofa, worn", "Local pickup", "New York, NY"], ["just a title"], ["$5"], [], ["Pending", "Just listed", "£10", "Ship 2, deck 3"]]
    got = column(spark, spans, cards.card_fields, "array<string>")
    assert [(g.badges, g.price, g.was, g.title, g.place, g.delivery) for g in got] == [
        (["Sold"], "$65", "$80", "A bike red", "Salem, OR", "Ships to you"), ([], "Free", None, "Sofa, worn", "New York, NY", "Local pickup"), ([], None, None, "just a title", None, None), ([], "$5", None, "", None, None), ([], None, None, "", None, None),
        (["Pending", "Just listed"], "£10", None, "Ship 2, deck 3", None, None),
    ]


def test_captions_and_their_odd_forms(spark):
    vtt = "WEBVTT\n\nSTYLE\n\n1\n00:01.500 --> 00:02.000\n<c>Hello</c> &amp;\nbye\n\n01:00:00.000 --> 01:00:01,250\n \n"
    tracks = spark.createDataFrame([("a", vtt), ("b", '{"events":[{"tStartMs":100,"segs":[{"utf8":"x"},{"utf8":"\\n y"}]},{"tStartMs":5}]}'), ("c", "nothing"), ("d", None)], "video_id string, body string")
    got = sorted((r.video_id, r.start, r.end, r.text) for r in video.caption_segments(tracks).collect())
    assert got == [("a", 1.5, 2.0, "Hello & bye"), ("b", 0.1, 0.1, "x y")]
    assert column(spark, ["", None, "https://youtu.be/", "abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijkl"], video.video_id) == [None, None, None, "abcdefghijk", None]


def test_cookies_that_are_none(spark):
    made = lambda c: net.set_cookie(c, F.lit("a.example.com"), F.lit(1000), ["com"])
    got = column(spark, ["", "novalue", "=x", None, "n=v; domain=; expires=nonsense", "n=v; Domain=b.example.com", "n=; Max-Age=-5; Expires=Sat, 1 Jan 2050 00:00:00 GMT"], made)
    assert got[:4] == [None] * 4 and got[5] is None
    assert (got[4].domain, got[4].host_only, got[4].expires, got[4].deleted, got[4].path) == ("a.example.com", True, None, False, "/")
    assert (got[6].value, got[6].deleted) == ("", True)


def test_links_that_begin_alike_are_told_apart(spark):
    answers = spark.createDataFrame([(1, "https://a.com/x and https://a.com/xy, [t](https://a.com/x?q=1)"), (2, "no link"), (3, None)], "run int, answer string")
    seen = spark.createDataFrame([(1, "https://a.com/xy")], "run int, url string")
    got = {r.run: (r.proven, r.dropped) for r in research.proven_links(answers, seen, ["run"]).collect()}
    assert got == {1: (f"{research.MARKER} and https://a.com/xy, t", 2), 2: ("no link", 0), 3: (None, None)}


def test_gated_feeds(spark):
    bodies = ['{"marketplace_search":{"feed_units":null}}', '{"marketplace_search":{"feed_units":{"edges":[]}}}', '{"marketplace_search":{"feed_units":{"edges":[{"n":1}]}}}', "", None]
    got = serp.feed_gated(spark.createDataFrame(list(enumerate(bodies)), "query_id int, body string")).orderBy("query_id").collect()
    assert [r.gated for r in got] == [True, True, False, False, None]
