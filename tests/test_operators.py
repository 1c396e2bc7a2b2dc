"""Operators on small tables made from the reference's own cases."""

import pytest
from pyspark.sql import functions as F

from fathomline.functions.page import classify
from fathomline.operators import filters, fusion, grounding, items, robots, state
from fathomline.plans.queries import parse_operators
from fathomline.streaming import live

LIST = "query_id long, provider string, provider_pos int, rank int, url string, title string, snippet string, published string"


def lists(spark, rows):
    return spark.createDataFrame([(1, p, i, r, u, t, s, d) for p, i, r, u, t, s, d in rows], LIST)


def test_same_page_merges_and_fills_gaps(spark):
    rows = lists(spark, [("a", 0, 0, "https://x.com/a?utm_source=t", "T", "", None), ("a", 0, 1, "https://x.com/a", "U", "snip", "2026-01-01")])
    (r,) = fusion.dedupe_lists(rows).collect()
    assert (r.title, r.snippet, r.published, r.copies) == ("T", "snip", "2026-01-01", 2)


def test_rows_without_url_stay_apart_in_a_list(spark):
    assert fusion.dedupe_lists(lists(spark, [("a", 0, 0, "", "x", "", None), ("a", 0, 1, "", "y", "", None)])).count() == 2


def test_agreement_beats_single_first_places(spark):
    rows = lists(spark, [("a", 0, 0, "https://a.com/x", "a", "", None), ("a", 0, 1, "https://both.com/y", "b", "", None), ("b", 1, 0, "https://b.com/z", "c", "", None), ("b", 1, 1, "https://both.com/y", "b", "", "2026-09-08")])
    first = fusion.rrf(fusion.dedupe_lists(rows)).orderBy("place").first()
    assert first.page == "https://both.com/y" and first.agreement == 2 and first.published == "2026-09-08" and list(first.sources) == ["a", "b"]


def test_weights_decide(spark):
    rows = lists(spark, [("a", 0, 0, "https://a.com/x", "a", "", None), ("b", 1, 0, "https://b.com/z", "c", "", None)])
    weights = spark.createDataFrame([(1, "b", 5.0)], "query_id long, provider string, weight double")
    assert fusion.rrf(fusion.dedupe_lists(rows), weights).orderBy("place").first().page == "https://b.com/z"


WIRE = "Storm closes the northern bridge after heavy overnight rain floods the valley road"


def test_syndicated_copies_collapse_across_domains_only(spark):
    rows = lists(spark, [("a", 0, 0, "https://one.com/1", WIRE, "", None), ("b", 1, 0, "https://two.com/2", WIRE, "", None), ("b", 1, 1, "https://one.com/3", WIRE, "", None)])
    got = fusion.fuse(rows).orderBy("place").collect()
    assert [r.page for r in got] == ["https://one.com/1", "https://one.com/3"]
    assert list(got[0].near_duplicates) == ["https://two.com/2"]


def test_fusion_of_nothing(spark):
    assert fusion.fuse(lists(spark, [])).count() == 0


ITEM = "group long, identity string, pos long, url string, title string, seller string, brand string, image string, currency string, amount double, availability string, condition string, rating double, reviews int"


def item(identity="id", pos=0, url="", seller="", brand="", currency="USD", amount=None, availability="", rating=None):
    return (1, identity, pos, url, "t", seller, brand, "", currency, amount, availability, "", rating, None)


def merged(spark, *rows):
    return items.merge_items(spark.createDataFrame(list(rows), ITEM)).orderBy("place").collect()


def test_live_offer_beats_a_cheaper_sold_one(spark):
    (r,) = merged(spark, item(pos=0, url="https://a.com/1", amount=10.0, availability="SoldOut"), item(pos=1, url="https://b.com/1", amount=20.0))
    assert r.amount == 20.0 and [o.price for o in r.offers] == [10.0] and r.offer_count == 2


def test_all_sold_keeps_the_cheapest(spark):
    (r,) = merged(spark, item(pos=0, url="https://a.com/1", amount=10.0, availability="SoldOut"), item(pos=1, url="https://b.com/1", amount=20.0, availability="OutOfStock"))
    assert r.amount == 10.0


def test_majority_currency_and_gaps(spark):
    (r,) = merged(spark, item(pos=0, url="https://a.com/1", amount=1.0, currency="EUR", brand="B", rating=4.5), item(pos=1, url="https://b.com/1", amount=250.0), item(pos=2, url="https://c.com/1", amount=240.0))
    assert (r.amount, r.currency, r.brand, r.rating) == (240.0, "USD", "B", 4.5)


def test_a_listing_is_never_its_own_offer(spark):
    (r,) = merged(spark, item(pos=0, url="https://a.com/1?ref=x", amount=5.0), item(pos=1, url="https://www.a.com/1", amount=5.0, brand="B"))
    assert r.offer_count == 1 and not r.offers and r.brand == "B"


def test_loners_and_unpriced_order(spark):
    got = merged(spark, item(identity="", pos=0, url="https://a.com/1"), item(identity="", pos=1, url="https://b.com/1", amount=3.0), item(identity="", pos=2, url="https://c.com/1", amount=5.0, currency="EUR"), item(identity="x", pos=3, url="https://d.com/1", amount=10.0))
    assert [r.amount for r in got] == [3.0, 10.0, 5.0, None]


PAGE = "<html><title>Fine</title><body>" + "plain readable words about nothing much at all " * 60 + "</body></html>"
SHORT = "<html><body>{}</body></html>"


@pytest.mark.parametrize(("status", "headers", "body", "kind", "ok", "blocked", "vendor", "reason"), [
    (403, {"Server": "cloudflare"}, "", "", False, True, "cloudflare", "http_403"), (403, {}, "perimeterx_challenge", "", False, True, "perimeterx", "http_403"), (403, {}, "perimeterx_challenge" + "x" * 5000, "", False, True, None, "http_403"),
    (429, {}, "", "", False, False, None, "http_429"), (401, {}, "", "", False, False, None, "auth_required_401"), (200, {}, "<title>Just a moment...</title>", "text/html", False, True, None, "title:just a moment"),
    (200, {}, '<div id="anomaly-modal"></div>', "text/html", False, True, None, "widget:anomaly-modal"), (503, {"CF-Mitigated": "challenge"}, "", "", False, True, "cloudflare", "http_503_challenge"), (503, {"cf-ray": "x"}, "down", "", False, False, "cloudflare", "http_503"),
    (200, {}, PAGE + "captcha", "text/html", True, False, None, "ok"), (200, {}, '<div id="root"></div>', "text/html", False, False, None, "empty_mount"), (200, {}, SHORT.format("You need to enable JavaScript"), "text/html", False, False, None, "js_required"),
    (200, {}, SHORT.format("hello"), "text/html", False, False, None, "too_thin:5"), (200, {}, "%PDF-1.7", "text/html", False, False, None, "binary:application/pdf"), (200, {}, "[]", "application/json", True, False, None, "structured"),
    (200, {}, PAGE.replace("plain", "pl�in"), "text/html", False, False, None, None), (200, {}, "x", "image/png", False, False, None, "not_html:image/png"), (200, {}, SHORT.format("Sorry! Something went wrong"), "text/html", False, False, None, "soft_error:something went wrong"),
    (200, {}, SHORT.format("Access Denied Reference #18.2a34d517.1793229018.7253767"), "text/html", False, True, "akamai", "edge_ref"), (404, {}, "", "", False, False, None, "http_404"),
])
def test_classify(spark, status, headers, body, kind, ok, blocked, vendor, reason):
    df = spark.createDataFrame([(status, headers, body, kind)], "status int, headers map<string,string>, body string, kind string")
    v = df.select(classify(*[F.col(c) for c in ("status", "headers", "body", "kind")]).alias("v")).first().v
    assert (v.ok, v.blocked, v.vendor) == (ok, blocked, vendor)
    assert reason is None and v.reason.startswith("mojibake:") or v.reason == reason


def test_operators_in_query_text(spark):
    rows = spark.createDataFrame([("moon site:a.gov OR site:https://www.b.int/x -site:c.com",), ("building site safety",), ("x site:a.gov,b.int site a.gov",)], "asked string")
    got = [(r.clean, list(r.domains), list(r.excluded)) for r in parse_operators(rows, "asked").collect()]
    assert got == [("moon", ["a.gov", "b.int"], ["c.com"]), ("building site safety", [], []), ("x", ["a.gov", "b.int"], [])]


def test_stale_documents(spark):
    rows = spark.createDataFrame([("2026-09-01", "week"), ("2026-09-07", "week"), ("2026-09-02", "week"), ("2021", "week"), (None, "week"), ("2020-01-01", "all")], "published string, freshness string")
    got = [r.x for r in rows.select(filters.is_stale(F.col("published"), F.col("freshness"), F.to_date(F.lit("2026-09-10"))).alias("x")).collect()]
    assert got == [True, False, False, False, False, False]


ROBOTS = "User-agent: *\nDisallow: /search\nAllow: /search/about\nDisallow: /*.pdf$\nDisallow: /caf%C3%A9\nDisallow: /admin\nCrawl-delay: 3\n\nUser-agent: nice\nDisallow:\n"


@pytest.mark.parametrize(("agent", "path", "allowed"), [("x", "/search", False), ("x", "/search/about", True), ("x", "/a/b.pdf", False), ("x", "/a/b.pdf?x", True), ("x", "/café/1", False), ("x", "/%61dmin", False), ("x", "/other", True), ("nice-bot", "/search", True)])
def test_robots(spark, agent, path, allowed):
    rules = robots.parse(spark.createDataFrame([("o", ROBOTS)], "origin string, body string"))
    r = robots.decide(spark.createDataFrame([("o", path)], "origin string, path string"), rules, agent).first()
    assert r.allowed is allowed and r.crawl_delay == (None if agent == "nice-bot" else 3.0)


def test_no_robots_allows(spark):
    rules = robots.parse(spark.createDataFrame([], "origin string, body string"))
    assert robots.decide(spark.createDataFrame([("o", "/x")], "origin string, path string"), rules, "x").first().allowed is True


CALL = "provider string, seq long, ok boolean, latency_ms double"


def test_health_and_breaker(spark):
    rows = spark.createDataFrame([("p", i, ok, ms) for i, (ok, ms) in enumerate([(True, 100.0), (True, 200.0), (False, 1.0), (False, 1.0), (False, 1.0), (False, 1.0), (True, 1.0)])], CALL)
    got = state.health_log(rows, "provider", ["seq"], "ok", "latency_ms").orderBy("seq").collect()
    assert [round(r.ema_latency_ms) for r in got[:2]] == [380, 326]
    assert [r.tripped for r in got] == [False, False, False, False, True, True, False] and [r.trips for r in got] == [0, 0, 0, 0, 1, 2, 0]


def test_rate_falls_by_half_and_climbs(spark):
    rows = spark.createDataFrame([("p", i, ok, 0.0) for i, ok in enumerate([False, True, False, False, False])], CALL)
    got = [r.rate for r in state.aimd_log(rows, "provider", ["seq"], "ok").orderBy("seq").collect()]
    assert got == pytest.approx([0.375, 0.425, 0.2125, 0.10625, 0.1])


def test_bucket_admits_its_burst(spark):
    rows = spark.createDataFrame([("p", i, float(i) / 100) for i in range(5)], "provider string, seq long, at double")
    assert [r.admitted for r in state.token_bucket_log(rows, "provider", ["seq"], "at").orderBy("seq").collect()] == [True, True, True, False, False]


def test_folds_of_nothing(spark):
    assert state.health_log(spark.createDataFrame([], CALL), "provider", ["seq"], "ok", "latency_ms").count() == 0


def test_citations(spark):
    cited = spark.createDataFrame([(1, "f", "https://www.a.com/x?utm_source=1"), (1, "f", "https://a.com/x"), (1, "g", "https://made.up/")], "run long, finding string, url string")
    seen = spark.createDataFrame([(1, "http://a.com/x/")], "run long, url string")
    assert {(r.finding, r.grounded) for r in grounding.ground_citations(cited, seen, ["run"]).collect()} == {("f", True), ("g", False)}


def test_late_answers_merge(spark):
    fused = spark.createDataFrame([(1, "a", 0.5, ["y"])], "query_id long, page string, score double, providers array<string>")
    late = spark.createDataFrame([(1, "z", 0, "a"), (1, "z", 1, "b"), (1, "y", 3, "a")], "query_id long, provider string, pos int, page string")
    got = {r.page: (round(r.score, 6), r.providers, r.agreement) for r in live.late_merge(fused, late).collect()}
    # y answered early and late: its place counts, its name once
    assert got == {"a": (round(0.5 + 1 / 61 + 1 / 64, 6), ["y", "z"], 2), "b": (round(1 / 62, 6), ["z"], 1)}


def plain_health(calls):
    latency, success, streak, trips, out = 500.0, 1.0, 0, 0, []
    for ok, ms in calls:
        latency, success = 0.7 * latency + 0.3 * ms, 0.7 * success + 0.3 * ok
        streak = 0 if ok else streak + 1
        trips = 0 if ok else trips + (streak >= 3)
        out.append((round(latency, 7), round(success, 9), streak, trips, streak >= 3))
    return out


def test_health_equals_a_plain_fold(spark):
    import random

    draw = random.Random(8)
    logs = {k: [(draw.random() < 0.6, draw.random() * 10 ** draw.randint(0, 5)) for _ in range(n)] for k, n in (("a", 500), ("b", 31), ("c", 33), ("d", 1))}
    rows = [(k, i, ok, ms) for k, log in logs.items() for i, (ok, ms) in enumerate(log)]
    draw.shuffle(rows)
    log = state.health_log(spark.createDataFrame(rows, "p string, i int, ok boolean, ms double"), "p", ["i"], "ok", "ms")
    got = {k: [] for k in logs}
    for r in sorted(log.collect(), key=lambda r: r.i):
        got[r.p].append((round(r.ema_latency_ms, 7), round(r.ema_success, 9), r.streak, r.trips, r.tripped))
    assert got == {k: plain_health(v) for k, v in logs.items()}


def test_reports_climbs_and_memos(spark):
    calls = spark.createDataFrame([("a", i, i < 2, 100.0) for i in range(6)] + [("b", 0, True, 10.0)], "p string, i int, ok boolean, ms double")
    got = {r.p: (r.streak, r.calls, r.open, r.cooldown_s) for r in state.health_report(calls, "p", ["i"], "ok", "ms").collect()}
    assert got == {"a": (4, 6, True, 30.0), "b": (0, 1, False, 0.0)}
    tries = [("x", 0, "blocked", 0), ("x", 1, "ok", 900), ("x", 2, "ok", 950), ("y", 0, "thin", 40), ("y", 1, "thin", 90), ("z", 0, "blocked", 0), ("z", 1, "http_404", 0), ("z", 2, "ok", 500)]
    climbs = {r.page: (r.tier, r.verdict, r.answered) for r in state.climbed(spark.createDataFrame(tries, "page string, tier int, verdict string, text_len int"), "page").collect()}
    assert climbs == {"x": (1, "ok", True), "y": (1, "thin", True), "z": (1, "http_404", False)}
    reads = spark.createDataFrame([("u", 0, 0.0, 300.0), ("u", 1, 100.0, None), ("u", 2, 150.0, 30.0), ("u", 3, 181.0, None), ("v", 4, 0.0, None)], "url string, n int, at double, holds double")
    assert [r.memo for r in state.memo_hits(reads, "url", "at", F.col("holds"), "n").orderBy("n").collect()] == [False, True, False, False, False]
    rates = spark.createDataFrame([("h", 0.5, 10.0), ("h", 0.2, 20.0), ("k", 3.9, 0.0)], "host string, rate double, at double")
    assert {r.host: (round(r.rate, 3), r.tokens) for r in state.seeded(rates, "host", F.col("at"), F.lit(120.0)).collect()} == {"h": (0.7, 0.0), "k": (4.0, 0.0)}


def test_robots_patterns_past_the_bound_are_not_read(spark):
    from fathomline.operators import robots

    body = "User-agent: *\n" + "\n".join(f"Disallow: /p{i}$" for i in range(robots.MAX_RULES)) + "\nDisallow: /late\n"
    rules = robots.parse(spark.createDataFrame([("o", body)], "origin string, body string"))
    asked = spark.createDataFrame([("o", "/p5"), ("o", "/late"), ("o", "/p5"), ("q", "/p5")], "origin string, path string")
    got = [(r.origin, r.path, r.permitted, r.warning) for r in robots.permitted(robots.decide(asked, rules, "fathom"), "warn").collect()]
    assert sorted(got) == [("o", "/late", True, False), ("o", "/p5", True, True), ("o", "/p5", True, True), ("q", "/p5", True, False)]


def test_containment_of_long_short_and_odd_items(spark):
    docs = [(1, "so the quick brown fox, jumps over the lazy dog today"), (2, "quickfox"), (3, None), (4, ""), (2, "quickfox again"), (5, "the quick brown fox jumps")]
    items = [(10, "ick brown fox, jumps over the la"), (11, "fox"), (12, "fox"), (13, None), (14, "quick brown"), (15, "absent"), (16, "k b")]
    got = grounding.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"))
    want = {(d, i) for d, t in docs for i, s in items if t is not None and s is not None and s in t}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)


def test_suppression_in_rounds_equals_the_walk(spark):
    import random

    draw = random.Random(9)
    pages, near, want = [], [], set()
    for q in range(80):
        n, kinds, sites = draw.randint(1, 16), draw.randint(1, 8), draw.randint(1, 5)
        if q == 0:  # a chain: each page is similar to the next only
            own, links = [(i, f"d{i}", i) for i in range(14)], {(i, i + 1) for i in range(13)}
        else:
            raw = [(draw.randrange(kinds), f"d{draw.randrange(sites)}") for _ in range(n)]
            first = {}
            own = [(i, d, first.setdefault(k, i)) for i, (k, d) in enumerate(raw)]
            names = sorted(set(first.values()))
            links = {tuple(sorted(draw.sample(names, 2))) for _ in range(draw.randint(0, 2 * len(names)))} if len(names) > 1 else set()
        links |= {(c, c) for _, _, c in own}
        gone = {}
        for place, domain, c in own:
            before = [p for p, d, k in own if p < place and d != domain and p not in gone and ((c, k) in links or (k, c) in links)]
            if before:
                gone[place] = min(before)
        pages += [(q, place, d, c) for place, d, c in own]
        near += [(q, a, b) for a, b in links] + [(q, b, a) for a, b in links if a != b]
        want |= {(q, place, by) for place, by in gone.items()}
    made = spark.createDataFrame(pages, "query_id int, place int, domain string, class int")
    got = fusion.suppressed(made, spark.createDataFrame(near, "query_id int, class int, other int")).collect()
    assert {(r.query_id, r.place, r.kept) for r in got} == want
    assert fusion.suppressed(made.limit(0), spark.createDataFrame([], "query_id int, class int, other int")).count() == 0


def test_copies_of_one_page_on_many_domains_make_no_pairs(spark):
    fused = spark.range(3000).select(F.lit(1).alias("query_id"), F.col("id").cast("int").alias("place"), F.concat(F.lit("https://d"), F.col("id").cast("string"), F.lit(".com/")).alias("url"), F.lit("one title of many words here").alias("title"), F.lit("").alias("snippet"))
    kept = fusion.collapse_syndication(fused).collect()
    assert [(r.place, len(r.near_duplicates)) for r in kept] == [(0, 2999)]


def test_robots_patterns_equal_a_plain_matcher(spark):
    import random
    import re

    draw = random.Random(10)
    word = lambda n: "".join(draw.choice("ab/") for _ in range(n))
    rules = [(f"o{i % 5}", "*", i, draw.random() < 0.5, "/" + "*".join(word(draw.randint(0, 3)) for _ in range(draw.randint(1, 4))) + draw.choice(["", "$"]), None) for i in range(200)]
    rules += [("o0", "*", 900, False, "*b$", None), ("o0", "*", 901, True, "/$", None)]
    asks = [(f"o{draw.randrange(6)}", "/" + word(draw.randint(0, 8))) for _ in range(500)]
    got = robots.decide(spark.createDataFrame(asks, "origin string, path string"), spark.createDataFrame(rules, "origin string, agent string, seq int, allow boolean, pattern string, crawl_delay double"), "me").collect()
    assert len(got) == 500

    def allowed(origin, path):
        fits = [(len(p), a) for o, _, _, a, p, _ in rules if o == origin and re.match("^" + ".*".join(map(re.escape, p.removesuffix("$").split("*"))) + ("$" if p.endswith("$") else ""), path)]
        return max(fits, default=(0, True))[1]

    assert all(r.allowed == allowed(r.origin, r.path) for r in got)


def test_robots_patterns_of_many_wildcards_take_no_time(spark):
    rules = spark.createDataFrame([("o", "*", 0, False, "/" + "*a" * 40 + "*b$", None)], "origin string, agent string, seq int, allow boolean, pattern string, crawl_delay double")
    asks = spark.createDataFrame([("o", "/" + "a" * 200_000)], "origin string, path string")
    assert robots.decide(asks, rules, "me").first().allowed is True
