"""Queries over pages as documents, listings in their state, cards, videos, cookies and what a research run makes of them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import asking, markdown, net, text
from ..operators import items, research, robots, routing, state
from ..scratch import written
from ..sources import apis, cards, listings, records, serp, video
from . import tables as T
from .queries import _query
from .sources import _ANSWERS_SQL, _FOLD_SQL, _HEALTH_SQL, _answers, _bodies, _plain


def _pick(key, *values):
    """One of the values, by the number of the row."""
    return F.get(F.array(*[v if not isinstance(v, str | int | float | bool) else F.lit(v) for v in values]), (key % len(values)).cast("int"))


# --- pages as documents -------------------------------------------------------


def _markdown_sql(html: str) -> str:
    for pattern, mark in markdown.STEPS:
        html = f"regexp_replace({html}, '{pattern.replace(chr(39), chr(39) * 2)}', {_sql_text(mark)}, 'g')"
    for name, value in text.ENTITIES:
        html = f"replace({html}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return rf"regexp_replace(regexp_replace({html}, '\A\s+', ''), '\s+\z', '')"


def _sql_text(mark: str) -> str:
    return " || ".join(f"'{part}'" for part in mark.split("\n")).replace(" || ", " || chr(10) || ")


@_query(f"SELECT page_id, md5({_markdown_sql('html')}) AS markdown_md5, length({_markdown_sql('html')}) AS n FROM pages")
def page_markdown(spark, sf_dir):
    found = T.table(spark, sf_dir, "pages").select("page_id", markdown.to_markdown(F.col("html")).alias("m"))
    return found.select("page_id", F.md5("m").alias("markdown_md5"), F.length("m").cast("long").alias("n"))


@_query("""SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 2 THEN 'Home' || chr(10) || chr(10) || 'short note' ELSE '# About ' || p_name || chr(10) || chr(10) || rtrim(repeat('What is known of ' || p_name || ' follows. ', 3)) || chr(10) || chr(10)
  || CASE WHEN p_partkey % 3 = 1 THEN 'Read on' || chr(10) || chr(10) ELSE '' END || rtrim(repeat('It was made in ' || p_brand || ' and sold. ', CAST(3 + p_size % 4 AS INTEGER))) END AS content FROM part""")
def page_content(spark, sf_dir):
    """What a page says between a menu and a list of teasers that no tag tells from it; a page of a few words is taken whole."""
    key, name = F.col("p_partkey"), F.col("p_name")
    link = lambda n: F.concat(F.lit("<li><a href='/x'>More of "), name, F.lit(f" {n}</a></li>"))
    menu = F.concat(F.lit("<div class=top><ul>"), *[link(i) for i in range(4)], F.lit("</ul></div>"))
    said = lambda *parts: F.array_join(F.array_repeat(F.concat(*parts), 3), " ")
    sold = F.array_join(F.array_repeat(F.concat(F.lit("It was made in "), "p_brand", F.lit(" and sold.")), (F.col("p_size") % 4 + 3).cast("int")), " ")
    body = F.concat(F.lit("<h1>About "), name, F.lit("</h1><p>"), said(F.lit("What is known of "), name, F.lit(" follows.")), F.lit("</p>"), F.when(key % 3 == 1, "<p><a href='/on'>Read on</a></p>").otherwise(""), F.lit("<p>"), sold, F.lit("</p>"))
    page = F.when(key % 3 == 2, F.lit("<div>Home</div><div>short note</div>")).otherwise(F.concat(menu, F.lit("<div>"), body, F.lit("</div><div>"), menu, F.lit("</div>")))
    return T.spread(T.table(spark, sf_dir, "part"), "p_partkey").select(key.alias("page_id"), markdown.to_markdown(F.concat(F.lit("<title>T</title><body>"), page, F.lit("</body>")), main=True).alias("content"))


@_query("""SELECT p_partkey AS page_id, p_name AS name, CASE WHEN p_partkey * 37 % 6000 + 9 < 3000 THEN 'https://shop.example.com/c/' || p_partkey END AS link, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS distance FROM part""")
def card_marks(spark, sf_dir):
    """Cards whose link stands some way behind their data, near enough or not, and whose text gives a distance or a mileage."""
    key = F.col("p_partkey")
    data = F.to_json(F.struct(F.col("p_name").alias("name"), F.floor("p_retailprice").alias("price"), F.concat(F.lit("i"), key.cast("string")).alias("sku")))
    html = F.concat(F.lit("<div data-item='"), data, F.lit("'></div>"), F.repeat(F.lit("."), (key * 37 % 6000).cast("int")), F.lit('<a href="/c/'), key.cast("string"), F.lit('">open</a><p>Salem, OR '), F.when(key % 2 == 0, F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(" mi)"))).otherwise(F.concat(F.col("p_size").cast("string"), F.lit(",000 mi"))), F.lit("</p>"))
    pages = T.spread(T.table(spark, sf_dir, "part"), "p_partkey").select(key.alias("page_id"), F.lit("https://shop.example.com/list").alias("url"), html.alias("html"))
    return records.generic_listings(written(pages, "card-pages")).select("page_id", "name", "link", "distance")


_STATE_SQL = """p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 17, '0') AS vin, '$' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS price FROM part)"""


def _state_pages(spark, sf_dir):
    """A page a part: a card whose link stands apart, a vehicle with a report, an item inside a wrapper and twice, and one that the prose names."""
    part = T.table(spark, sf_dir, "part")
    key, price = F.col("p_partkey"), F.floor("p_retailprice")
    said = key.cast("string")
    vin = F.lpad(said, 17, "0")
    sku = F.concat(F.lit("K"), (key + 100_000).cast("string"))
    card = F.concat(F.lit("<div data-item='"), F.to_json(F.struct(F.col("p_name").alias("productName"), F.col("p_brand").alias("brand"), F.format_string("$%,d", price).alias("salePrice"), (price * 3).alias("originalPrice"), sku.alias("sku"))), F.lit("'></div><a href=\"/d/"), sku, F.lit('-x">open</a><a href="/about">about</a>'))
    vehicle = F.to_json(F.struct(F.struct(
        F.struct(vin.alias("value"), F.lit(False).alias("invalidVin")).alias("vin"), F.lit(2020).alias("year"), F.struct(F.lit("Maker").alias("name")).alias("make"), F.concat(F.lit("M"), said).alias("model"), F.struct((F.col("p_size") * 1000).alias("mileage"), (F.col("p_size") + 3).alias("dealerDistance")).alias("details"),
        F.lit("Manual").alias("transmission"), F.struct(price.alias("current"), F.lit(9).alias("monthlyPayment")).alias("pricing"), F.struct(F.col("p_brand").alias("name"), F.lit("Salem").alias("city"), F.lit("OR").alias("state")).alias("seller"),
    ).alias("vehicle"), F.struct(F.struct((key % 3).alias("accidentCount"), F.lit(True).alias("isCleanTitle"), F.lit(False).alias("salvage"), F.lit(False).alias("lemon")).alias("facts")).alias("report")))
    item = F.struct(F.col("p_name").alias("title"), price.alias("price"), F.concat(F.lit("/i/"), said).alias("itemUrl"), said.alias("id"))
    nested = F.to_json(F.struct(F.lit("wrapper of all").alias("name"), F.lit(1).alias("price"), F.lit("w1").alias("id"), F.array(item, item).alias("rows")))
    named = F.concat(F.to_json(F.struct(F.col("p_name").alias("name"), price.alias("price"), said.alias("id"))))
    script = lambda json: F.concat(F.lit("<script>window.__STATE__ = "), json, F.lit(";</script>"))
    html = _pick(key, card, script(vehicle), script(nested), F.concat(script(named), F.lit("<p>"), "p_name", F.lit("</p>")))
    total = F.concat(F.lit('<script>var c={"totalCount":'), said, F.lit(',"resultCount":'), said, F.lit(',"facetCount":5}</script>'))
    made = part.repartition(spark.sparkContext.defaultParallelism, key).select(key.alias("page_id"), F.lit("https://shop.example.com/list").alias("url"), F.concat(html, total).alias("html"))
    return written(made, "state-pages")  # a table, as captured pages are


_ROW_SQL = """CASE p_partkey % 4
  WHEN 0 THEN p_brand || ' ' || p_name || ' | ' || price || ' | https://shop.example.com/d/K' || (100000 + p_partkey) || '-x'
  WHEN 1 THEN '2020 Maker M' || p_partkey || ' | ' || price || ' | ' || format('{:,}', p_size * 1000) || ' mi | Manual | VIN ' || vin || ' | ' || p_brand || ' (Salem, OR) | distance ' || (p_size + 3) || ' | history: ' || n || CASE WHEN n = 1 THEN ' accident' ELSE ' accidents' END || ', clean title, no salvage title/lemon record'
  ELSE p_name || ' | ' || price || ' | https://shop.example.com/i/' || p_partkey END"""


@_query(f"""WITH {_STATE_SQL}, h AS (SELECT *, p_partkey % 3 AS n FROM p)
SELECT p_partkey AS page_id, 1 AS place, CASE WHEN p_partkey % 4 = 1 THEN vin ELSE CASE WHEN p_partkey % 4 = 0 THEN p_brand || ' ' ELSE '' END || p_name END AS key, {_ROW_SQL} AS row FROM h WHERE p_partkey % 4 <> 3""")
def state_listings(spark, sf_dir):
    """Listings that only a page's own state holds, with the link, distance and history that stand elsewhere in it."""
    return listings.listing_rows(_state_pages(spark, sf_dir), generic=True)


@_query("SELECT p_partkey AS page_id, p_partkey AS total FROM part")
def state_totals(spark, sf_dir):
    return records.result_counts(_state_pages(spark, sf_dir))


@_query("SELECT p_partkey AS page_id, lpad(CAST(p_partkey AS VARCHAR), 17, '0') AS key, (p_partkey % 3) || CASE WHEN p_partkey % 3 = 1 THEN ' accident' ELSE ' accidents' END || ', clean title, no salvage title/lemon record' AS history FROM part WHERE p_partkey % 4 = 1")
def vehicle_histories(spark, sf_dir):
    objects = records.page_objects(_state_pages(spark, sf_dir)).select("page_id", "path", "vin", "flags", "codes")
    return records.histories(written(objects.where("vin IS NOT NULL OR size(flags) + size(codes) > 0"), "vehicle-objects"))


@_query("""SELECT p_partkey AS page_id, 'Page of ' || p_partkey AS title, 'Page of ' || p_partkey || ': ' || CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE 'open about' END IS NOT NULL AS has_text,
  p_partkey % 4 <> 3 AS has_listings, CASE WHEN p_partkey % 4 <> 3 AND p_partkey > 0 THEN format('{:,}', p_partkey) END AS total FROM part""")
def page_documents(spark, sf_dir):
    """Title, text and, where the text lacks them, the listings under the total that the page gives."""
    pages = _state_pages(spark, sf_dir).withColumn("html", F.concat(F.lit("<title>Page of "), F.col("page_id").cast("string"), F.lit("</title>"), "html"))
    found = listings.with_listings(pages, markdown.to_markdown(F.col("html")), text.title_of(F.col("html")).alias("title"))
    return found.select("page_id", "title", F.col("text").isNotNull().alias("has_text"), F.col("text").contains("\n\n## Listings\n\n").alias("has_listings"), F.nullif(F.regexp_extract("text", r"own data reports ([\d,]+) results", 1), F.lit("")).alias("total"))


@_query(f"""WITH {_STATE_SQL}, h AS (SELECT *, p_partkey % 3 AS n FROM p), r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'openabout' WHEN 3 THEN p_name ELSE 'Page of ' || p_partkey END AS prose, {_ROW_SQL} AS row FROM h)
SELECT p_partkey AS page_id, prose || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE chr(10) || chr(10) || '## Listings' || chr(10) || chr(10) || CASE WHEN p_partkey > 0 THEN 'The page''s own data reports ' || format('{{:,}}', p_partkey) || ' results in all.' || chr(10) || chr(10) ELSE '' END || '- ' || row END AS text FROM r""")
def page_texts(spark, sf_dir):
    """The whole text of pages with listings: their prose, and the section of what it does not name."""
    pages = _state_pages(spark, sf_dir).withColumn("html", F.concat(F.lit("<title>Page of "), F.col("page_id").cast("string"), F.lit("</title>"), "html"))
    return listings.with_listings(pages, markdown.to_markdown(F.col("html"))).select("page_id", "text")


@_query("""SELECT page_id, length(html) AS length, count(*) OVER (PARTITION BY html) AS copies FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html ELSE substr(html, 1, 40) END AS html FROM pages)""")
def body_keys(spark, sf_dir):
    """How many fetched bodies are the same, by length and hash."""
    bodies = T.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.substring("html", 1, 40)).alias("html")).withColumn("key", net.body_key(F.col("html")))
    return bodies.select("page_id", F.col("key.length").cast("long").alias("length"), F.count(F.lit(1)).over(Window.partitionBy("key")).alias("copies"))


@_query("SELECT p_partkey AS query_id, p_partkey % 4 IN (0, 1) AS gated FROM part")
def feed_states(spark, sf_dir):
    """Marketplace pages whose feed is null, empty, filled or not there."""
    key = F.col("p_partkey")
    feed = _pick(key, '"feed_units":null', '"feed_units" : { "edges" : [ ] , "n":1}', F.concat(F.lit('"feed_units":{"edges":[{"title":'), F.to_json(F.struct("p_name")), F.lit("}]}")), "")
    return serp.feed_gated(T.table(spark, sf_dir, "part").select(key.alias("query_id"), F.concat(F.lit('<script>{"marketplace_search":{'), feed, F.lit("}}</script>")).alias("body")))


_COVER_SQL = """SELECT a.event_id, arg_max(e.event_id, e.k * 1e12 + e.at_s) AS entry_id, max(e.k) AS entry_k, arg_max(e.at_s, e.k * 1e12 + e.at_s) AS entry_at, any_value(a.k) AS k, any_value(a.at_s) AS at_s
  FROM (SELECT *, event_id % 25 + 1 AS k FROM calls WHERE event_id % 3 <> 0) a LEFT JOIN (SELECT *, event_id // 3 % 30 + 1 AS k FROM calls WHERE event_id % 3 = 0) e ON e.provider = a.provider AND e.at_s <= a.at_s GROUP BY a.event_id"""


@_query(f"WITH {T.CALLS_SQL}, c AS ({_COVER_SQL}) SELECT event_id, CASE WHEN entry_k >= k AND at_s - entry_at <= 2000000 THEN entry_id END AS entry FROM c")
def superset_cache(spark, sf_dir):
    """Every third call leaves an answer of some width; the others ask for another, and get it from the widest that still holds."""
    calls = T.calls(spark, sf_dir)
    entries = calls.where("event_id % 3 = 0").select(F.col("event_id").alias("entry"), "provider", "at_s", (F.floor(F.col("event_id") / 3) % 30 + 1).alias("k"))
    asks = calls.where("event_id % 3 <> 0").select(F.col("event_id").alias("ask_id"), "provider", "at_s", (F.col("event_id") % 25 + 1).alias("k"))
    return state.covering_entries(asks, entries, "provider", 2_000_000).select(F.col("ask_id").alias("event_id"), "entry")


@_query(f"WITH RECURSIVE {T.CALLS_SQL}, {_HEALTH_SQL} SELECT provider, i AS calls, round(lat, 1) AS ema_latency_ms, round(suc, 3) AS ema_success FROM f QUALIFY row_number() OVER (PARTITION BY provider ORDER BY i DESC) = 1")
def health_figures(spark, sf_dir):
    """The averages of the health report, in its short figures."""
    found = state.health_report(T.calls(spark, sf_dir).select("event_id", "provider", "ok", "latency_ms"), "provider", ["event_id"], "ok", "latency_ms")
    return found.select("provider", "calls", "ema_latency_ms", "ema_success")


@_query("""SELECT s_nationkey AS "group", row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS rank, 'https://www.shop' || s_suppkey || '.example.com/p' AS url, s_name AS title,
  CASE s_suppkey % 3 WHEN 0 THEN '$' || format('{:,}', CAST(floor(abs(s_acctbal)) AS BIGINT)) WHEN 1 THEN format('{:,}', CAST(floor(abs(s_acctbal)) AS BIGINT)) || '.50 EUR' ELSE '' END || ' · ' || CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'shop' || s_suppkey || '.example.com' END AS snippet FROM supplier""")
def item_documents(spark, sf_dir):
    key, price = F.col("s_suppkey"), F.floor(F.abs("s_acctbal"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    rows = T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group"), place.alias("place"), F.concat(F.lit("https://www.shop"), key.cast("string"), F.lit(".example.com/p")).alias("url"), F.col("s_name").alias("title"), F.when(key % 2 == 0, F.col("s_name")).otherwise("").alias("seller"), F.when(key % 3 == 1, "EUR").otherwise("USD").alias("currency"), F.when(key % 3 == 0, price.cast("double")).when(key % 3 == 1, price + 0.5).alias("amount"))
    return items.item_documents(rows).select("group", F.col("rank").cast("long").alias("rank"), "url", "title", "snippet")


# --- cards and products ---------------------------------------------------------


@_query("""SELECT p_partkey AS page_id, 'fbmp:' || p_partkey AS identity, p_name AS title, CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE floor(p_retailprice)::DOUBLE END AS amount, CASE WHEN p_partkey % 2 = 0 THEN floor(p_retailprice)::DOUBLE + 20 END AS was,
  ['SoldOut', 'Pending', 'InStock'][p_partkey % 3 + 1] AS availability, 'Duluth, GA' AS place, CASE WHEN p_partkey % 2 = 1 THEN 'Local pickup' END AS delivery FROM part""")
def dom_cards(spark, sf_dir):
    """Two anchors an item, the first around a picture."""
    key, price = F.col("p_partkey"), F.floor("p_retailprice")
    link = F.concat(F.lit('<a class="x" href="/marketplace/item/'), key.cast("string"), F.lit('/?ref=search">'))
    span = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<span dir=auto>"), c, F.lit("</span>"))).otherwise("")
    body = F.concat(span(F.nullif(_pick(key, "Sold", "Pending", ""), F.lit(""))), span(F.when(key % 5 == 0, "Free").otherwise(F.format_string("$%,d", price))), span(F.when(key % 2 == 0, F.format_string("$%,d", price + 20))), span(F.col("p_name")), span(F.lit("Duluth, GA")), span(F.when(key % 2 == 1, F.lit("Local pickup"))))
    html = F.concat(link, F.lit('<img src="p.jpg"></a>'), link, F.lit("<div>"), body, F.lit("</div></a>"))
    found = cards.dom_cards(T.table(spark, sf_dir, "part").select(key.alias("page_id"), html.alias("html")))
    return found.select("page_id", "identity", "title", "amount", "was", "availability", "place", "delivery")


@_query("SELECT p_partkey // 100 AS page_id, 'fbmp:' || p_partkey AS identity, CASE WHEN p_partkey % 3 = 0 THEN 'card' ELSE 'payload' END AS found_in FROM part")
def payload_and_cards(spark, sf_dir):
    """A page's payload lacks every third listing, which its cards hold."""
    rows = T.table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("page_id"), F.col("p_partkey").alias("pos"), F.concat(F.lit("fbmp:"), F.col("p_partkey").cast("string")).alias("identity"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("amount"))
    return cards.with_payload(rows.where("pos % 3 <> 0"), rows.where("pos % 2 = 0 OR pos % 3 = 0")).select("page_id", "identity", "found_in")


@_query("""WITH o AS (SELECT l_orderkey AS query_id, l_partkey, min(l_linenumber) AS place FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, CAST(l_partkey + 10000 AS VARCHAR)) AS nth FROM o)
SELECT query_id, 'https://shop.example.com/product/item-' || (l_partkey + 10000) AS url, CASE WHEN l_partkey % 2 = 0 THEN p_name ELSE 'found' END AS title, CASE WHEN l_partkey % 2 = 0 THEN p_retailprice END AS amount, l_partkey % 2 = 0 AS own
FROM r JOIN part ON p_partkey = l_partkey WHERE nth <= 4""")
def marketplace_items(spark, sf_dir):
    """The products of the first four product pages of an order; pages of odd parts hold none, so the link stands for itself."""
    part, lines = T.spread(T.table(spark, sf_dir, "part"), "p_partkey"), T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    parts = T.parts_of(lines)  # dealt by order once, as numbers, for the links and their ranks
    page = lambda key: F.concat(F.lit("https://shop.example.com/product/item-"), (key + 10_000).cast("string"))
    docs = lines.repartition(parts, "l_orderkey").groupBy(F.col("l_orderkey").alias("query_id"), "l_partkey").agg(F.min("l_linenumber").alias("place")).select("query_id", "place", page(F.col("l_partkey")).alias("url"), F.lit("found").alias("title"))
    node = lambda name, url: F.struct(F.lit("Product").alias("@type"), name.alias("name"), url.alias("url"), F.struct(F.col("p_retailprice").cast("string").alias("price"), F.lit("USD").alias("priceCurrency")).alias("offers"))
    other = F.lit("https://shop.example.com/product/other-1")
    nodes = F.to_json(F.array(node(F.lit("also bought"), other), node(F.col("p_name"), page(F.col("p_partkey")))))
    pages = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("page_id"), F.concat(page(F.col("p_partkey")), F.lit("?utm_source=x")).alias("url"), F.concat(F.lit('<script type="application/ld+json">'), nodes, F.lit("</script>")).alias("html"))
    return cards.find_items(docs, pages, F.array(F.lit("www.shop.example.com")), most=4, parts=parts).select("query_id", "url", "title", "amount", "own")


# --- videos -----------------------------------------------------------------------


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 8 < 6 THEN 'vid' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS video FROM customer""")
def video_ids(spark, sf_dir):
    key = F.col("c_custkey")
    v = F.concat(F.lit("vid"), F.lpad(key.cast("string"), 8, "0"))
    forms = _pick(key, F.concat(F.lit(" "), v), F.concat(F.lit("https://www.youtube.com/watch?t=5&v="), v), F.concat(F.lit("youtu.be/"), v, F.lit("?si=x")), F.concat(F.lit("https://m.youtube.com/shorts/"), v), F.concat(F.lit("https://www.youtube-nocookie.com/embed/"), v, F.lit("/")), F.concat(F.lit("http://youtube.com/live/"), v), F.concat(F.lit("https://vimeo.example/"), v), F.lit("https://www.youtube.com/watch?v=short"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", video.video_id(forms).alias("video"))


@_query("""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS said FROM conversations)
SELECT conv_id AS video_id, count(*) AS segment_count, max(i) * 2.5::DOUBLE + 2.25::DOUBLE AS duration_s, md5(string_agg(said, ' ' ORDER BY i)) AS text_md5 FROM t WHERE said <> '' GROUP BY conv_id""")
def transcript_texts(spark, sf_dir):
    """Conversations as caption tracks: even ones as JSON events, odd ones as WebVTT."""
    turns = T.table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("t")).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.coalesce(t["text"], F.lit(""))).alias("lines"))
    events = F.to_json(F.named_struct(F.lit("events"), F.transform("lines", lambda s, i: F.named_struct(F.lit("tStartMs"), i * 2500, F.lit("dDurationMs"), F.lit(2250), F.lit("segs"), F.array(F.named_struct(F.lit("utf8"), s))))))
    clock = lambda ms: F.concat(F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000))
    cues = F.transform("lines", lambda s, i: F.concat(clock(i * 2500), F.lit(" --> "), clock(i * 2500 + 2250), F.lit(" align:start\n"), F.regexp_replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), r"\n+", "\n")))
    tracks = turns.select(F.col("conv_id").alias("video_id"), F.when(F.col("conv_id") % 2 == 0, events).otherwise(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n\n"))).alias("body"))
    return video.transcripts(video.caption_segments(tracks)).select("video_id", "segment_count", "duration_s", F.md5("text").alias("text_md5"))


@_query("SELECT p_partkey, age_days FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE (p_size % 12) * 1.0::DOUBLE END AS age_days FROM part) WHERE age_days IS NULL OR age_days <= 7")
def fresh_videos(spark, sf_dir):
    videos = T.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 5 != 0, (F.col("p_size") % 12).cast("double")).alias("age_days"))
    return serp.fresh_videos(videos, F.lit("week"))


@_query("""SELECT p_partkey // 100 AS query_id, 'https://www.youtube.com/watch?v=id' || p_partkey AS url, p_partkey % 4 = 0 AS shorts, p_partkey % 4 IN (1, 2) AS live,
  CASE WHEN p_partkey % 4 = 0 THEN '5K views' WHEN p_partkey % 4 = 1 THEN 'a channel · 9 watching' WHEN p_partkey % 4 = 2 THEN 'a channel' ELSE 'a channel · 7 views · 2 days ago' END AS snippet FROM part""")
def video_kinds(spark, sf_dir):
    """Short videos, and ones that are live by their viewers or by a badge."""
    key = F.col("p_partkey")
    simple = lambda c: F.struct(F.lit(c).alias("simpleText"))
    video_of = lambda **more: F.struct(F.concat(F.lit("id"), key.cast("string")).alias("videoId"), *[v.alias(k) for k, v in more.items()])
    owner = F.struct(F.array(F.struct(F.lit("a channel").alias("text"))).alias("runs"))
    badge = F.array(F.struct(F.struct(F.lit("LIVE").alias("label")).alias("metadataBadgeRenderer")))
    wrapped = lambda name, c: F.to_json(F.struct(c.alias(name)))
    card = _pick(key, wrapped("reelItemRenderer", video_of(headline=simple("short"), viewCountText=simple("5K views"))), wrapped("videoRenderer", video_of(ownerText=owner, viewCountText=simple("9 watching"))), wrapped("videoRenderer", video_of(ownerText=owner, badges=badge)),
                 wrapped("videoRenderer", video_of(ownerText=owner, viewCountText=simple("7 views"), publishedTimeText=simple("2 days ago"))))
    pages = T.table(spark, sf_dir, "part").groupBy(F.floor(key / 100).alias("query_id")).agg(F.array_join(F.collect_list(card), ",").alias("cards"))
    return serp.video_cards(pages.select("query_id", F.concat(F.lit('var ytInitialData = {"contents":['), "cards", F.lit("]}")).alias("body"))).select("query_id", "url", "shorts", "live", "snippet")


# --- answers ------------------------------------------------------------------------


@_query(f"WITH {_ANSWERS_SQL} SELECT query_id, rank, url, {_FOLD_SQL} AS title, snippet, published FROM answers")
def stackexchange_answers(spark, sf_dir):
    element = F.struct(F.col("url").alias("link"), "title", F.concat(F.lit("<i>"), "snippet", F.lit("</i>")).alias("excerpt"), (F.unix_seconds(F.to_timestamp("published")) + 3600).alias("creation_date"))
    return _plain(apis.stackexchange(_bodies(_answers(spark, sf_dir), element, lambda e: F.to_json(F.struct(e.alias("items"), F.lit(250).alias("quota_remaining"))))))


@_query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN greatest(doc_id % 100, 1)::DOUBLE WHEN 1 THEN 3600.0 WHEN 2 THEN 3600.0 END AS hold_s FROM documents")
def quota_holds(spark, sf_dir):
    key = F.col("doc_id")
    bodies = _pick(key, F.concat(F.lit('{"items":[],"backoff":'), F.greatest(key % 100, F.lit(1)).cast("string"), F.lit(',"quota_remaining":7}')), '{"items":[],"quota_remaining":0}', '{"items":[],"backoff":5,"quota_remaining":0}', '{"items":[],"quota_remaining":9}')
    return T.table(spark, sf_dir, "documents").select("doc_id", apis.quota_hold(bodies).alias("hold_s"))


@_query(f"WITH {_ANSWERS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS r FROM answers WHERE i <> 3) SELECT query_id, r AS rank, url, {_FOLD_SQL} AS title FROM k")
def serp_ddg_lite(spark, sf_dir):
    link = F.when(F.col("i") == 3, F.concat(F.lit("//duckduckgo.com/y.js?ad_domain=x&amp;u="), F.url_encode("url"))).otherwise(F.concat(F.lit("//duckduckgo.com/l/?uddg="), F.url_encode("url"), F.lit("&amp;rut=abc")))
    block = F.concat(F.lit("<tr><td><a rel=nofollow href='"), link, F.lit("' class='result-link'>"), "title", F.lit("</a></td></tr><tr><td class='result-snippet'>s</td></tr>"))
    return serp.ddg_lite(_bodies(_answers(spark, sf_dir), block, lambda e: F.array_join(e, "\n"))).select("query_id", F.col("rank").cast("long").alias("rank"), "url", "title")


@_query(f"WITH {_ANSWERS_SQL} SELECT query_id, rank, url, CASE WHEN query_id % 2 = 0 THEN 'from the feed' ELSE 'from the page' END AS title FROM answers")
def bing_feed_or_page(spark, sf_dir):
    """Every other feed is empty; its page serves."""
    rows = _answers(spark, sf_dir)
    item = F.concat(F.lit("<item><title>from the feed</title><link>"), "url", F.lit("</link></item>"))
    block = F.concat(F.lit('<li class="b_algo"><h2><a href="'), "url", F.lit('">from the page</a></h2></li>'))
    feed = _bodies(rows, item, lambda e: F.when(F.col("query_id") % 2 == 0, F.array_join(e, "")).otherwise("<rss></rss>")).withColumnRenamed("body", "feed")
    page = _bodies(rows, block, lambda e: F.array_join(e, "")).withColumnRenamed("body", "page")
    return serp.bing(feed.join(page, "query_id")).select("query_id", F.col("rank").cast("long").alias("rank"), "url", "title")


# --- requests and sources -------------------------------------------------------------


@_query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'sid' WHEN 1 THEN 'a' WHEN 4 THEN 'gone' WHEN 5 THEN 'old' END AS name, CASE c_custkey % 6 WHEN 0 THEN 'example.com' WHEN 1 THEN 'shop.example.com' WHEN 4 THEN 'shop.example.com' WHEN 5 THEN 'shop.example.com' END AS domain,
  CASE c_custkey % 6 WHEN 0 THEN 1000 + c_custkey WHEN 4 THEN 1000 WHEN 5 THEN 600 END AS expires, CASE WHEN c_custkey = 0 THEN true WHEN c_custkey % 6 IN (0, 1) THEN false WHEN c_custkey % 6 IN (4, 5) THEN true END AS deleted FROM customer""")
def cookies_set(spark, sf_dir):
    """A parent's cookie with an age, a host's own, one for a stranger, one for a public suffix, one that is deleted, and one that is over."""
    key = F.col("c_custkey")
    header = _pick(key, F.concat(F.lit("sid=x=1; Domain=.Example.com; Max-Age="), key.cast("string"), F.lit("; Secure")), "a=; path=/p; HttpOnly; max-age=soon", "b=1; domain=other.org", "c=1; domain=com", "gone=1; Max-Age=0", "old=1; Expires=Thu, 01 Jan 1970 00:10:00 GMT")
    rows = T.table(spark, sf_dir, "customer").select("c_custkey", net.set_cookie(header, F.lit("Shop.example.com"), F.lit(1000), ["com", "org", "co.uk"]).alias("c"))
    return rows.select("c_custkey", "c.name", "c.domain", "c.expires", "c.deleted")


@_query("SELECT doc_id, ['allow', 'allow', 'refuse'][doc_id % 3 + 1] AS enforced, ['allow', 'allow', 'warn'][doc_id % 3 + 1] AS warned FROM documents")
def robots_policies(spark, sf_dir):
    asked = T.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 != 2).alias("allowed"))
    enforced, warned = robots.permitted(asked, "enforce"), robots.permitted(asked, "warn")
    both = enforced.select("doc_id", F.when(F.col("permitted"), "allow").otherwise("refuse").alias("enforced")).join(warned.select("doc_id", F.when(F.col("warning"), "warn").otherwise("allow").alias("warned")), "doc_id")
    return both


@_query(f"""WITH {T.CALLS_SQL}, b AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY provider ORDER BY event_id) AS block FROM logged),
s AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY provider, block ORDER BY event_id) AS streak, count(*) OVER (PARTITION BY provider) AS calls FROM b)
SELECT provider, streak, calls, streak >= 3 AS open, CASE WHEN streak >= 3 THEN least(120.0, 15.0 * pow(2, greatest(streak - 3, 0))) ELSE 0.0 END AS cooldown_s FROM s WHERE i = calls""")
def health_report(spark, sf_dir):
    found = state.health_report(T.calls(spark, sf_dir).select("event_id", "provider", "ok", "latency_ms"), "provider", ["event_id"], "ok", "latency_ms")
    return found.select("provider", "streak", "calls", "open", "cooldown_s")


@_query(f"WITH {T.CALLS_SQL} SELECT provider, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS blocks, row_number() OVER (ORDER BY count(*) DESC, provider) AS place FROM calls GROUP BY provider QUALIFY place <= 20")
def busiest_profiles(spark, sf_dir):
    """A top-k report: the order is total, so Spark keeps 20 rows a partition."""
    rates = state.block_rates(T.calls(spark, sf_dir), "provider", F.col("ok"))
    top = rates.orderBy((F.col("successes") + F.col("blocks")).desc(), "provider").limit(20)
    from pyspark.sql.window import Window

    return top.select("provider", "successes", "blocks", F.row_number().over(Window.orderBy((F.col("successes") + F.col("blocks")).desc(), "provider")).cast("long").alias("place"))


@_query("""WITH a AS (SELECT event_id // 3 AS page, event_id % 3 AS tier, ['blocked', 'thin', 'ok', 'http_404'][(event_id * 7 + event_id // 5) % 4 + 1] AS verdict, event_id % 50 AS n FROM events),
e AS (SELECT *, min(tier) FILTER (verdict = 'http_404') OVER (PARTITION BY page) AS ends FROM a)
SELECT page, arg_min(tier, {'r': CASE verdict WHEN 'ok' THEN 0 WHEN 'thin' THEN 1 ELSE 2 END, 't': CASE verdict WHEN 'ok' THEN tier WHEN 'thin' THEN -n ELSE -tier END, 'i': tier}) AS tier, bool_or(verdict IN ('ok', 'thin')) AS answered FROM e WHERE ends IS NULL OR tier <= ends GROUP BY page""")
def tier_climb(spark, sf_dir):
    key = F.col("event_id")
    verdict = F.element_at(F.array(*[F.lit(v) for v in ("blocked", "thin", "ok", "http_404")]), ((key * 7 + F.floor(key / 5)) % 4 + 1).cast("int"))
    tries = T.table(spark, sf_dir, "events").select(F.floor(key / 3).alias("page"), (key % 3).alias("tier"), verdict.alias("verdict"), (key % 50).alias("text_len"))
    return state.climbed(tries, "page").select("page", "tier", "answered")


@_query(f"WITH {T.CALLS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY at_s DESC) AS r FROM calls), m AS (SELECT max(at_s) AS now FROM calls) SELECT provider, round(least(4.0::DOUBLE, 0.5::DOUBLE + (now - at_s) * 0.005::DOUBLE), 6) AS rate FROM l, m WHERE r = 1")
def seeded_rates(spark, sf_dir):
    calls = T.calls(spark, sf_dir).withColumn("rate", F.lit(0.5))
    now = calls.agg(F.max("at_s")).first()[0]
    return state.seeded(calls, "provider", F.col("at_s"), F.lit(now)).select("provider", F.round("rate", 6).alias("rate"))


@_query(f"WITH {T.CALLS_SQL} SELECT event_id, coalesce(at_s <= lag(CASE WHEN NOT ok THEN at_s + 300 END) OVER (PARTITION BY provider ORDER BY at_s, event_id), false) AS memo FROM calls")
def memo_hits(spark, sf_dir):
    return state.memo_hits(T.calls(spark, sf_dir), "provider", "at_s", F.when(~F.col("ok"), F.lit(300.0)), "event_id").select("event_id", "memo")


@_query(f"""WITH {T.CALLS_SQL}, a AS (SELECT *, at_s - lag(at_s) OVER (PARTITION BY provider, event_type ORDER BY at_s, event_id) AS age FROM calls)
SELECT event_id, CASE WHEN age <= 3600 THEN 'hit' WHEN age <= 7200 THEN 'stale' WHEN ok THEN 'miss' WHEN age <= 86400 THEN 'stale_if_error' ELSE 'error' END AS answer FROM a""")
def cache_under_errors(spark, sf_dir):
    reads = T.calls(spark, sf_dir).withColumn("page", F.concat_ws("|", F.col("provider").cast("string"), "event_type"))
    return state.with_stale_if_error(state.cache_log(reads, "page", F.col("at_s"), 3600, 3600), F.col("ok"), 86_400).select("event_id", "answer")


@_query("""WITH a AS (SELECT event_id // 4 AS query_id, ['duckduckgo', 'bing', 'arxiv', 'github'][event_id % 4 + 1] AS provider, ['used', 'failed', 'late', 'skipped'][(event_id // 7) % 4 + 1] AS state FROM events)
SELECT query_id, bool_or(provider IN ('duckduckgo', 'bing')) AND NOT coalesce(bool_or(state = 'used') FILTER (provider IN ('duckduckgo', 'bing')), false) AS walled FROM a GROUP BY query_id""")
def walled_queries(spark, sf_dir):
    key = F.col("event_id")
    asked = T.table(spark, sf_dir, "events").select(F.floor(key / 4).alias("query_id"), _pick(key, "duckduckgo", "bing", "arxiv", "github").alias("provider"), _pick(F.floor(key / 7), "used", "failed", "late", "skipped").alias("state"))
    return routing.walled(asked, "query_id")


@_query("""SELECT c_custkey AS query_id, CASE WHEN c_custkey % 2 = 0 THEN 'answered' WHEN c_custkey % 3 < 2 THEN 'refused' ELSE 'empty' END AS outcome FROM customer""")
def cooling_outcomes(spark, sf_dir):
    """Web queries lose a general engine, code queries a source of their own and the engine, shopping queries none."""
    sources = spark.createDataFrame([("duckduckgo", ["web"], True, 4, "http_429", 30.0), ("github", ["code"], True, 3, "timeout", -1.0), ("arxiv", ["academic"], False, 0, "", 0.0)], "provider string, intents array<string>, open boolean, streak int, last_error string, left_s double")
    asked = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), _pick(F.col("c_custkey"), "web", "code", "shopping").alias("intent"), (F.col("c_custkey") % 2 == 0).cast("int").alias("docs"))
    return routing.refused_if_cooling(asked.select("query_id", "docs"), routing.cooling(asked, sources)).select("query_id", "outcome")


@_query("SELECT c_custkey, CASE WHEN c_custkey % 7 < 3 THEN 12.0 ELSE least(12.0, greatest(2.0, 3.0 * (c_custkey % 5000) / 1000.0 + 1.0)) END AS timeout_s, CASE WHEN c_custkey % 4 = 0 THEN 90.0 ELSE least(120.0, 15.0 * pow(2, greatest(c_custkey % 7 - 1, 0))) END AS cooldown_s FROM customer")
def waits_of_sources(spark, sf_dir):
    key = F.col("c_custkey")
    cooldown = routing.cooldown_s(F.when(key % 4 == 0, 90.0).otherwise(0.0), F.lit(15.0), key % 7)
    return T.table(spark, sf_dir, "customer").select("c_custkey", routing.timeout_s(F.lit(12.0), (key % 5000).cast("double"), key % 7).alias("timeout_s"), cooldown.alias("cooldown_s"))


@_query("""SELECT c_custkey, c_custkey % 4 IN (0, 2) AS commerce, c_custkey % 3 = 0 AS covered, ['utf-8', 'iso-8859-1', NULL][c_custkey % 3 + 1] AS charset, c_custkey % 3 < 2 AS markdown FROM customer""")
def small_decisions(spark, sf_dir):
    """Whether a query shops, a cached answer covers a request, and what a reply's type says."""
    key = F.col("c_custkey")
    asked = _pick(key, "used bike for sale", "how birds navigate", "phones under $300", "history of sales tax")
    kind = _pick(key, 'text/markdown; charset="UTF-8"', "text/plain; charset=ISO-8859-1", "text/plain")
    body = _pick(key, "x", "# Title", "plain words")
    return T.table(spark, sf_dir, "customer").select("c_custkey", text.is_commerce(asked).alias("commerce"), asking.covers(F.lit(10), 10 + key % 3).alias("covered"), net.header_charset(kind).alias("charset"), net.is_markdown(kind, body).alias("markdown"))


# --- research ---------------------------------------------------------------------------


@_query("""SELECT doc_id, 'See [one](https://a.example.com/' || doc_id || '), ' || CASE WHEN doc_id % 3 = 0 THEN '[two](https://b.example.com/x) and https://B.example.com/x#top.' ELSE 'two and [unverified link removed]' || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END END AS proven, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 2 END AS dropped FROM documents""")
def proven_answers(spark, sf_dir):
    """Every third run retrieved the second page; the first is retrieved by all under another spelling."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id")
    said = F.col("doc_id").cast("string")
    answers = docs.select("doc_id", F.concat(F.lit("See [one](https://a.example.com/"), said, F.lit("), [two](https://b.example.com/x) and https://B.example.com/x#top.")).alias("answer"))
    first = docs.select("doc_id", F.concat(F.lit("HTTPS://A.example.com/"), said, F.lit("/#part")).alias("url"))
    second = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("https://b.example.com/x/").alias("url"))
    return research.proven_links(answers, first.union(second), ["doc_id"])


@_query("SELECT o_orderkey, coalesce(n, 0) AS findings, n IS NOT NULL AS finished FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def subtask_reports(spark, sf_dir):
    reports = T.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("findings"))
    return research.reported(T.table(spark, sf_dir, "orders").select("o_orderkey"), reports, ["o_orderkey"])


@_query(f"""WITH {T.DOCUMENTS_SQL} SELECT doc_id // 100 AS run, page, arg_min(doc_id, {{'b': (doc_id % 4 = 0)::INT, 'w': source, 'p': doc_id}}) AS first_doc, count(DISTINCT source) AS workers FROM docs GROUP BY ALL""")
def research_rollup(spark, sf_dir):
    """A worker a source; every fourth hit was never read, so a read copy leads."""
    docs = T.documents(spark, sf_dir).select(F.floor(F.col("doc_id") / 100).alias("run"), F.col("source").alias("worker"), F.col("doc_id").alias("pos"), F.regexp_replace("url", "^http:", "https:").alias("url"), F.col("doc_id").cast("string").alias("title"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"))
    return research.rolled_up(docs, "run").select("run", "page", F.col("title").cast("long").alias("first_doc"), "workers")


@_query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_orderkey = l.l_orderkey AND s.l_partkey = l.l_partkey AND s.l_linenumber < 3)")
def unseen_items(spark, sf_dir):
    lines = T.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return research.unseen(lines, lines.where("l_linenumber < 3"), ["l_orderkey", "l_partkey"])


@_query(T.fused_sql() + " SELECT query_id, page, substr(coalesce(title, ''), 1, 200) || CASE WHEN agreement > 1 THEN ' (confirmed by ' || agreement || ' providers)' ELSE '' END || chr(10) || substr(coalesce(snippet, ''), 1, 240) AS line FROM fused")
def shown_results(spark, sf_dir):
    from ..operators import fusion

    return research.shown(fusion.rrf(fusion.dedupe_lists(T.lists(spark, sf_dir)))).select("query_id", "page", "line")


@_query("SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE '[the first 500 of ' || length(text) || ' characters]' || chr(10) || chr(10) || substr(text, 1, 500) END AS shown FROM documents")
def page_excerpts(spark, sf_dir):
    return T.table(spark, sf_dir, "documents").select("doc_id", markdown.excerpt(F.col("text"), 500).alias("shown"))
