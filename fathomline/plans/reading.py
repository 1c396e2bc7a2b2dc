"""Queries over lighter page forms, redirects, refusals, waits, cookies and how queries are put."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import asking, money, net
from ..operators import redirects
from ..sources import apis, lean, listings
from . import tables as T
from .queries import _query
from .sources import _ANSWERS_SQL, _answers, _bodies, _plain


@_query("""SELECT page_id, page_id % 4 AS kind, CASE page_id % 4 WHEN 0 THEN 'https://raw.githubusercontent.com/o' || page_id || '/r/HEAD/README.md' WHEN 1 THEN 'https://www.rfc-editor.org/rfc/rfc' || (page_id % 90000 + 1) || '.txt'
  ELSE 'https://raw.githubusercontent.com/kubernetes/website/HEAD/content/en/docs/a/p' || page_id || CASE place WHEN 0 THEN '.md' ELSE '/_index.md' END END AS lean_url, place
  FROM pages, (VALUES (0), (1)) t(place) WHERE page_id % 4 <> 3 AND (place = 0 OR page_id % 4 = 2)""")
def lean_targets(spark, sf_dir):
    """Pages of four kinds, one of which has no lighter form."""
    found = lean.targets(_known_pages(spark, sf_dir))
    return found.select("page_id", (F.col("page_id") % 4).alias("kind"), F.get("lean_urls", F.lit(0)).alias("lean_url"), "place")


#: Addresses of other kinds and the first lighter form of each; {k} is the page's number.
_SHAPES = [
    ("https://en.m.wikipedia.org/wiki/Topic_{k}#History", "https://en.wikipedia.org/w/api.php?action=query&prop=extracts&explaintext=1&redirects=1&format=json&formatversion=2&titles=Topic_{k}"),
    ("https://arxiv.org/pdf/2101.0{k}v2.pdf", "https://arxiv.org/html/2101.0{k}v2"), ("https://github.com/o{k}/r/blob/main/src/a.py?raw=1", "https://raw.githubusercontent.com/o{k}/r/main/src/a.py"),
    ("https://huggingface.co/datasets/o{k}/d/", "https://huggingface.co/datasets/o{k}/d/raw/main/README.md"), ("https://crates.io/crates/crate{k}", "https://docs.rs/crate/crate{k}/latest"), ("https://www.npmjs.com/package/@s{k}/p", "https://unpkg.com/@s{k}/p/README.md"),
    ("https://github.com/o{k}/r/issues/7#c", "https://api.github.com/repos/o{k}/r/issues/7"), ("https://github.com/o{k}/r/releases/tag/v1", "https://api.github.com/repos/o{k}/r/releases/tags/v1"), ("https://github.com/o{k}/r/releases", "https://api.github.com/repos/o{k}/r/releases?per_page=10"),
    ("https://doc.rust-lang.org/stable/book/ch{k}.html", "https://raw.githubusercontent.com/rust-lang/book/HEAD/src/ch{k}.md"), ("https://github.com/o{k}/r/wiki/Page-1", "https://raw.githubusercontent.com/wiki/o{k}/r/Page-1.md"),
    ("https://react.dev/learn/topic{k}", "https://raw.githubusercontent.com/reactjs/react.dev/main/src/content/learn/topic{k}.md"), ("https://vuejs.org/guide/topic{k}.html", "https://raw.githubusercontent.com/vuejs/docs/main/src/guide/topic{k}.md"),
    ("https://docs.djangoproject.com/en/5.0/topics/t{k}/", "https://raw.githubusercontent.com/django/django/stable/5.0.x/docs/topics/t{k}.txt"), ("https://stackoverflow.com/questions/{k}/a-title", "https://api.stackexchange.com/2.3/questions/{k}?site=stackoverflow&filter=withbody"),
    ("https://pubmed.ncbi.nlm.nih.gov/{k}/", "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi?db=pubmed&id={k}&rettype=abstract&retmode=text"), ("https://www.pnas.org/doi/full/10.1073/x{k}", "https://api.crossref.org/works/10.1073/x{k}"), ("https://gitlab.com/g{k}/sub/p", "https://gitlab.com/g{k}/sub/p/-/raw/HEAD/README.md"),
    ("https://www.biorxiv.org/content/10.1101/2020.{k}v3.full", "https://api.biorxiv.org/details/biorxiv/10.1101/2020.{k}"), ("https://github.com/o{k}/r/tree/main/lib", "https://api.github.com/repos/o{k}/r/contents/lib?ref=main"), ("https://example.com/{k}", None),
]


def _number_sql(key: str) -> str:
    return f"lpad(CAST({key} % 9000 + 1 AS VARCHAR), 4, '0')"


_SHAPES_SQL = " ".join(f"WHEN {i} THEN '" + lean_url.replace("{k}", f"' || {_number_sql('c_custkey')} || '") + "'" for i, (_, lean_url) in enumerate(_SHAPES) if lean_url)


@_query(f"SELECT c_custkey AS page_id, CASE c_custkey % {len(_SHAPES)} {_SHAPES_SQL} END AS lean_url FROM customer WHERE c_custkey % {len(_SHAPES)} <> {len(_SHAPES) - 1}")
def lean_rules(spark, sf_dir):
    """The first lighter form of addresses of twenty more kinds; one kind has none."""
    key = F.col("c_custkey")
    number = F.lpad((key % 9000 + 1).cast("string"), 4, "0")
    address = F.get(F.array(*[F.lit(page) for page, _ in _SHAPES]), (key % len(_SHAPES)).cast("int"))
    pages = T.table(spark, sf_dir, "customer").select(key.alias("page_id"), F.replace(address, F.lit("{k}"), number).alias("url"))
    return lean.targets(pages).where("place = 0").select("page_id", F.get("lean_urls", F.lit(0)).alias("lean_url"))


@_query("""SELECT p_partkey AS page_id, p_name AS title, '# ' || p_name || chr(10) || chr(10) || 'Journal, 2020' || chr(10) || chr(10) || 'Ann Bell' || chr(10) || chr(10) || 'DOI: 10.1073/x' || p_partkey || chr(10) || chr(10) || '## Abstract' || chr(10) || chr(10)
  || CASE WHEN p_partkey % 2 = 0 THEN 'By the first' ELSE 'by the second' END || CASE WHEN p_partkey % 2 = 1 THEN chr(10) || chr(10) || 'Open-access copy: https://oa.example.org/' || p_partkey ELSE '' END AS text FROM part""")
def doi_records(spark, sf_dir):
    """A paper's record from one index, its abstract and open copy from another where the first has none."""
    key = F.col("p_partkey").cast("string")
    part = T.spread(T.table(spark, sf_dir, "part"), "p_partkey")
    doi = F.concat(F.lit("10.1073/x"), key)
    found = lean.targets(part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://www.pnas.org/doi/abs/"), doi).alias("url")))
    first = F.to_json(F.struct(F.struct(F.array("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "<jats:p>By the first</jats:p>").alias("abstract"), F.array(F.lit("Journal")).alias("container-title"), F.array(F.struct(F.lit("Ann").alias("given"), F.lit("Bell").alias("family"))).alias("author"), F.struct(F.array(F.array(F.lit(2020)))).alias("issued")).alias("message")))
    first = F.replace(first, F.lit('"issued":{"col1"'), F.lit('"issued":{"date-parts"'))
    second = F.when(F.col("p_partkey") % 2 == 1, F.concat(F.lit('{"abstract_inverted_index":{"second":[2],"by":[0],"the":[1]},"open_access":{"oa_url":"https://oa.example.org/'), key, F.lit('"}}'))).otherwise("{}")
    urls = found.where("place = 0").select("page_id", F.get("lean_urls", F.lit(0)).alias("u1"), F.get("lean_urls", F.lit(1)).alias("u2")).join(part.select(F.col("p_partkey").alias("page_id"), first.alias("b1"), second.alias("b2")), "page_id")
    bodies = urls.select(F.inline(F.array(F.struct(F.col("u1").alias("lean_url"), F.col("b1").alias("body")), F.struct(F.col("u2").alias("lean_url"), F.col("b2").alias("body")))))
    return lean.read(found, bodies).select("page_id", "title", "text")


def _known_pages(spark, sf_dir):
    key = F.col("page_id").cast("string")
    shapes = F.array(F.concat(F.lit("https://github.com/o"), key, F.lit("/r")), F.concat(F.lit("https://datatracker.ietf.org/doc/html/rfc"), (F.col("page_id") % 90_000 + 1).cast("string")), F.concat(F.lit("https://kubernetes.io/docs/a/p"), key, F.lit("/?x=1")), F.col("url"))
    return T.table(spark, sf_dir, "pages").select("page_id", F.get(shapes, (F.col("page_id") % 4).cast("int")).alias("url"))


@_query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'o' || page_id || '/r' WHEN 1 THEN 'RFC ' || (page_id % 90000 + 1) || ': About ' || page_id ELSE 'Page ' || page_id END AS title,
  CASE page_id % 4 WHEN 0 THEN '# R' || repeat('x', 100) WHEN 1 THEN 'Group' || chr(10) || chr(10) || 'About ' || page_id || chr(10) || repeat('y', 600) ELSE 'body' || repeat('z', 300) END AS text
  FROM pages WHERE page_id % 4 <> 3 AND page_id % 8 <> 4""")
def lean_read(spark, sf_dir):
    """A page whose lighter form is an error document is absent; a section page is read from its second candidate."""
    pages = _known_pages(spark, sf_dir)
    found, key = lean.targets(pages), F.col("page_id").cast("string")
    body = (
        F.when(F.col("page_id") % 8 == 4, "<!DOCTYPE html><p>missing")
        .when(F.col("page_id") % 4 == 0, F.concat(F.lit("# R"), F.repeat(F.lit("x"), 100)))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("Group\n\nAbout "), key, F.lit("\n"), F.repeat(F.lit("y"), 600)))
        .when(F.col("place") == 0, "404: Not Found")
        .otherwise(F.concat(F.lit("---\ntitle: \"Page "), key, F.lit("\"\n---\nbody"), F.repeat(F.lit("z"), 300)))
    )
    bodies = found.select("page_id", F.get("lean_urls", F.lit(0)).alias("lean_url"), body.alias("body"))
    return lean.read(found, bodies).select("page_id", "title", "text")


@_query("""WITH m AS (SELECT user_id % 20 AS o, event_id, event_id % 6 AS p, event_id // 400 % 2 AS t FROM events WHERE user_id IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS i, max(CASE WHEN t <> lt THEN event_id END) OVER w AS turned FROM (SELECT *, lag(t) OVER (PARTITION BY o, p ORDER BY event_id) AS lt FROM m) WINDOW w AS (PARTITION BY o, p ORDER BY event_id))
SELECT 'https://o' || o || '.example.com' AS origin, '/old/' || p || '/' AS old, 'https://n' || arg_max(t, event_id) || '.example.com/m' || p || '/' AS new,
  count(*) FILTER (event_id >= coalesce(last, 0)) AS seen FROM (SELECT *, max(turned) OVER (PARTITION BY o, p) AS last FROM r) GROUP BY o, p""")
def redirect_learn(spark, sf_dir):
    """Moves of six prefixes of each origin, to one of two targets; a new target counts anew. Reads whose path changed altogether teach nothing."""
    part = lambda c: c.cast("string")
    events = T.table(spark, sf_dir, "events").where("user_id IS NOT NULL")
    p, t = part(F.col("event_id") % 6), part(F.floor(F.col("event_id") / 400) % 2)
    url = F.concat(F.lit("https://O"), part(F.col("user_id") % 20), F.lit(".example.com/old/"), p, F.lit("/page-"), part(F.col("event_id")))
    final = F.concat(F.lit("https://n"), t, F.lit(".example.com/m"), p, F.lit("/page-"), part(F.col("event_id")))
    reads = events.select("event_id", url.alias("url"), final.alias("final"))
    reads = reads.unionByName(reads.withColumn("final", F.lit("https://login.example.com/login")))
    return redirects.learn(reads, "event_id", F.col("url"), F.col("final")).select("origin", "old", "new", F.col("seen").cast("long").alias("seen"))


@_query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://c.example.com/y/' || page_id || '?q=1' WHEN 1 THEN 'https://b.example.com/w/' || page_id END AS target FROM pages WHERE page_id IS NOT NULL""")
def redirect_follow(spark, sf_dir):
    """The longest prefix first, two moves in a row, and none for a move seen once."""
    rules = spark.createDataFrame([("https://a.example.com", "/x/", "https://b.example.com/y/", 2), ("https://a.example.com", "/x/deep/", "https://b.example.com/w/", 3), ("https://b.example.com", "/y/", "https://c.example.com/y/", 5), ("https://a.example.com", "/once/", "https://z.example.com/", 1)], "origin string, old string, new string, seen int")
    key = F.col("page_id").cast("string")
    shapes = F.array(F.concat(F.lit("https://a.example.com/x/"), key, F.lit("?q=1")), F.concat(F.lit("https://a.example.com/x/deep/"), key), F.concat(F.lit("https://a.example.com/once/"), key))
    urls = T.table(spark, sf_dir, "pages").where("page_id IS NOT NULL").select("page_id", F.get(shapes, (F.col("page_id") % 3).cast("int")).alias("url"))
    return redirects.follow(urls, rules).select("page_id", "target")


@_query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'link_local:169.254.' || (event_id % 250) || '.7' WHEN 1 THEN 'scheme:ftp' WHEN 2 THEN 'link_local:169.254.' || (event_id % 250) || '.9' WHEN 3 THEN 'unspecified:0.0.0.0' END AS refusal FROM events""")
def refused_targets(spark, sf_dir):
    n = F.col("event_id") % 250
    shapes = F.array(F.concat(F.lit("http://169.254."), n.cast("string"), F.lit(".7/latest")), F.lit("ftp://example.com/a"), F.concat(F.lit("http://[::ffff:a9fe:"), F.lower(F.lpad(F.hex(n * 256 + 9), 4, "0")), F.lit("]/")), F.lit("https://0.0.0.0:8443/"), F.concat(F.lit("http://10.0.0."), n.cast("string"), F.lit("/")))
    return T.table(spark, sf_dir, "events").select("event_id", net.refused_target(F.get(shapes, (F.col("event_id") % 5).cast("int"))).alias("refusal"))


@_query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(greatest(event_id % 5000, 1), 3600)::DOUBLE WHEN 1 THEN 60.0 WHEN 2 THEN 90.0 WHEN 3 THEN 30.0 END AS wait_s FROM events""")
def rate_limit_waits(spark, sf_dir):
    """Seconds, nothing, a date, a quota's reset, and no limit at all."""
    kind = F.col("event_id") % 5
    headers = F.when(kind == 0, F.create_map(F.lit("Retry-After"), (F.col("event_id") % 5000).cast("string"))).when(kind == 2, F.create_map(F.lit("retry-after"), F.lit("Thu, 01 Jan 1970 00:10:00 GMT"))).when(kind == 3, F.create_map(F.lit("X-RateLimit-Remaining"), F.lit("0"), F.lit("X-RateLimit-Reset"), F.lit("540")))
    status = F.when(kind.isin(0, 1, 2), 429).otherwise(403)
    return T.table(spark, sf_dir, "events").select("event_id", net.rate_limit_wait(status, headers, F.lit(510.0)).alias("wait_s"))


@_query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://h.example.com/p/x' || page_id WHEN 1 THEN 'https://y.example.org/' WHEN 2 THEN NULL END AS target FROM pages""")
def meta_refresh(spark, sf_dir):
    """A relative target, an absolute one in other quotes, one that waits too long, and pages without a refresh."""
    kind = F.col("page_id") % 4
    tag = F.when(kind == 0, F.concat(F.lit('<meta http-equiv="refresh" content="0; url=../x'), F.col("page_id").cast("string"), F.lit('">'))).when(kind == 1, "<META content='3;URL=\"https://y.example.org/\"' http-equiv=Refresh>").when(kind == 2, '<meta http-equiv=refresh content="30;url=/late">').otherwise("")
    html = F.concat(F.lit("<html><head><meta charset=utf-8>"), tag, F.coalesce("html", F.lit("")))
    return T.table(spark, sf_dir, "pages").select("page_id", net.meta_refresh(F.lit(200), F.lit("text/html; charset=UTF-8"), html, F.lit("https://h.example.com/p/q/r")).alias("target"))


@_query("""SELECT c_custkey, ['zh-Hant-TW', 'en-US', 'es-419', NULL][c_custkey % 4 + 1] AS locale, ['tw', 'us', NULL, NULL][c_custkey % 4 + 1] AS region FROM customer""")
def locale_tags(spark, sf_dir):
    tag = F.get(F.array(*[F.lit(t) for t in ("ZH_hant_tw", " en-us ", "ES-419", "not a tag")]), (F.col("c_custkey") % 4).cast("int"))
    return T.table(spark, sf_dir, "customer").select("c_custkey", asking.locale_of(tag).alias("l")).select("c_custkey", "l.locale", "l.region")


@_query("""SELECT c_custkey, 'find ' || c_name || CASE WHEN c_custkey % 3 > 0 THEN ' (site:a.com' || CASE WHEN c_custkey % 3 > 1 THEN ' OR site:b.com' ELSE '' END || ')' ELSE '' END || CASE WHEN c_custkey % 2 = 1 THEN ' -site:c.com' ELSE '' END AS engine_text,
  CASE c_custkey % 5 WHEN 0 THEN 'ex1:"ez1"' WHEN 1 THEN 'ex1:"ez2"' WHEN 2 THEN 'ex1:"ez3"' WHEN 3 THEN 'ex1:"ez5_45292_45657"' ELSE '' END AS recency, ['d', 'w', 'm', 'y', ''][c_custkey % 5 + 1] AS letter,
  greatest(3, CAST(ceil((c_custkey % 40) * 0.5) AS INTEGER)) AS k FROM customer""")
def asked_text(spark, sf_dir):
    key = F.col("c_custkey")
    domains = F.slice(F.array(F.lit("a.com"), F.lit("b.com")), F.lit(1), (key % 3).cast("int"))
    excluded = F.slice(F.array(F.lit("c.com")), F.lit(1), (key % 2).cast("int"))
    span = F.get(F.array(*[F.lit(s) for s in ("day", "week", "month", "year", "all")]), (key % 5).cast("int"))
    rows = T.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", asking.with_operators(F.concat(F.lit("find "), "c_name"), domains, excluded).alias("engine_text"), asking.freshness_filter(span, F.to_date(F.lit("2024-12-31"))).alias("recency"), asking.freshness_letter(span).alias("letter"), asking.specialist_k((key % 40).cast("int"), F.lit(0.5)).alias("k"))


@_query("""SELECT c_nationkey, count(*) AS spellings, 1::BIGINT AS keys FROM customer GROUP BY c_nationkey""")
def query_keys(spark, sf_dir):
    """All spellings and result counts of one question share a key."""
    key = F.col("c_custkey")
    spelled = F.when(key % 2 == 0, F.concat(F.lit("  Best  LAPTOP "), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("best laptop "), F.col("c_nationkey").cast("string")))
    domains = F.when(key % 3 == 0, F.array(F.lit("B.com"), F.lit("a.com"))).otherwise(F.array(F.lit("a.com"), F.lit("b.com")))
    asked = asking.query_key(spelled, F.lit("web"), F.lit("all"), domains, F.array().cast("array<string>"), (key % 20).cast("int"))
    return T.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("spellings"), F.count_distinct(asked).alias("keys"))


@_query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '10.1145/' || (page_id + 100) WHEN 1 THEN '10.1002/abc' || page_id || '(x)' END AS doi FROM pages""")
def doi_in_urls(spark, sf_dir):
    key = F.col("page_id")
    shapes = F.array(F.concat(F.lit("https://dl.acm.org/doi/full/10.1145/"), (key + 100).cast("string"), F.lit("?x=1")), F.concat(F.lit("https://p.org/article/10.1002/abc"), key.cast("string"), F.lit("%28x%29/pdf")), F.lit("https://p.org/10.1/x"))
    return T.table(spark, sf_dir, "pages").select("page_id", net.doi_in_url(F.get(shapes, (key % 3).cast("int"))).alias("doi"))


@_query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN 0.0 WHEN 5 THEN NULL ELSE round(p_retailprice, 2) END AS amount, CASE WHEN p_partkey % 6 = 2 THEN 'EUR' ELSE 'USD' END AS currency FROM part""")
def offer_prices(spark, sf_dir):
    """A number, a localised text in a specification, the low price of a range, a list, a price of zero, and none."""
    price = F.format_string("%.2f", "p_retailprice")
    local = F.translate(F.format_string("%,.2f", "p_retailprice"), ",.", ".,")
    shapes = F.array(
        F.concat(F.lit('{"price":'), price, F.lit("}")), F.concat(F.lit('{"priceSpecification":[{"price":"$'), price, F.lit('"}]}')), F.concat(F.lit('{"lowPrice":"'), local, F.lit('","highPrice":"9","priceCurrency":"eur"}')),
        F.concat(F.lit('{"price":["'), price, F.lit('"],"priceCurrency":"US DOLLARS"}')), F.lit('{"price":0,"highPrice":99}'), F.lit('{"price":""}'),
    )
    found = T.table(spark, sf_dir, "part").select("p_partkey", money.price_from_offer(F.get(shapes, (F.col("p_partkey") % 6).cast("int"))).alias("p"))
    return found.select("p_partkey", "p.amount", "p.currency")


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN round(p_retailprice, 2) END AS amount, CASE WHEN p_partkey % 3 = 1 THEN 'GBP' ELSE 'USD' END AS currency FROM part""")
def meta_prices(spark, sf_dir):
    price = F.format_string("%,.2f", "p_retailprice")
    shapes = F.array(F.concat(F.lit('<meta itemprop="price" content="$'), price, F.lit('">')), F.concat(F.lit('<meta property="og:price:currency" content="gbp"><meta property="og:price:amount" content="'), F.translate(price, ",.", ".,"), F.lit('">')), F.lit('<meta property="og:title" content="12">'))
    found = T.table(spark, sf_dir, "part").select("p_partkey", money.price_from_meta(F.get(shapes, (F.col("p_partkey") % 3).cast("int"))).alias("p"))
    return found.select("p_partkey", "p.amount", "p.currency")


@_query("""WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 17, '0') AS vin FROM part)
SELECT p_partkey AS page_id, 1 AS place, vin AS key, p_name || ' | $' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) || ' | ' || format('{:,}', p_size * 1000) || CASE WHEN p_partkey % 2 = 0 THEN ' mi' ELSE ' km' END || ' | Automatic | 2.5L I4 | VIN ' || vin || ' | ' || p_brand || ' (Duluth, GA) | https://cars.example.com/v/' || p_partkey AS row
FROM p WHERE p_partkey % 4 <> 3""")
def listing_rows(spark, sf_dir):
    """Vehicles in JSON-LD, each twice; a page whose prose names its vehicle already gets no row."""
    key = F.col("p_partkey")
    vin = F.lpad(key.cast("string"), 17, "0")
    seller = F.struct(F.col("p_brand").alias("name"), F.struct(F.lit("Duluth").alias("addressLocality"), F.lit("GA").alias("addressRegion")).alias("address"))
    offer = F.struct(F.floor("p_retailprice").alias("price"), seller.alias("seller"), F.concat(F.lit("../v/"), key.cast("string")).alias("url"))
    node = F.to_json(F.struct(
        F.lit("Car").alias("@type"), F.col("p_name").alias("name"), vin.alias("vehicleIdentificationNumber"), offer.alias("offers"), F.lit("Automatic").alias("vehicleTransmission"), F.struct(F.lit("2.5L I4").alias("name")).alias("vehicleEngine"),
        F.struct((F.col("p_size") * 1000).alias("value"), F.when(key % 2 == 0, "SMI").otherwise("KMT").alias("unitCode")).alias("mileageFromOdometer"),
    ))
    html = F.concat(F.lit('<script type="application/ld+json">['), node, F.lit(","), node, F.lit("]</script><p>"), F.when(key % 4 == 3, vin).otherwise("see below"), F.lit("</p>"))
    pages = T.spread(T.table(spark, sf_dir, "part"), "p_partkey").select(key.alias("page_id"), F.lit("https://cars.example.com/list/all").alias("url"), html.alias("html"))
    return listings.listing_rows(pages)


@_query("""SELECT c_custkey, c_custkey % 6 IN (0, 3) AS sent FROM customer""")
def cookies_sent(spark, sf_dir):
    """A parent's cookie, one of a child, one that is over, a host's own, a secure one on a plain request, and a host-only one of the parent."""
    kind = (F.col("c_custkey") % 6).cast("int")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), kind)
    sent = net.cookie_sent(F.lit("shop.example.com"), F.lit("http"), pick("example.com", "a.shop.example.com", "example.com", "shop.example.com", "example.com", "example.com"), kind.isin(3, 5), kind == 4, pick(-1.0, -1.0, 10.0, 1e12, -1.0, -1.0), F.lit(1000.0))
    return T.table(spark, sf_dir, "customer").select("c_custkey", sent.alias("sent"))


@_query("""SELECT error, kind, count(*) AS n FROM (SELECT ['ConnectError: x', 'blocked(cloudflare)', 'SSL: CERTIFICATE_VERIFY_FAILED', 'http_500', 'timeout'][event_id % 5 + 1] AS error, ['link', 'wall', 'certificate', 'other', 'link'][event_id % 5 + 1] AS kind FROM events) GROUP BY ALL""")
def error_kinds(spark, sf_dir):
    error = F.get(F.array(*[F.lit(e) for e in ("ConnectError: x", "blocked(cloudflare)", "SSL: CERTIFICATE_VERIFY_FAILED", "http_500", "timeout")]), (F.col("event_id") % 5).cast("int"))
    return T.table(spark, sf_dir, "events").select(error.alias("error")).groupBy("error").agg(F.count("*").alias("n")).select("error", net.error_kind(F.col("error")).alias("kind"), "n")


@_query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://d.example.com/docs/p' || page_id || '.md' END AS alternate FROM pages""")
def markdown_alternates(spark, sf_dir):
    link = F.concat(F.lit("<link rel=stylesheet href=a.css><link rel='alternate' type='text/markdown' href='p"), F.col("page_id").cast("string"), F.lit(".md'>"))
    html = F.concat(F.lit("<head>"), F.when(F.col("page_id") % 2 == 0, link).otherwise("<link rel=alternate type=application/rss+xml href=feed>"), F.lit("</head>"))
    return T.table(spark, sf_dir, "pages").select("page_id", lean.markdown_alternate(F.lit("https://d.example.com/docs/index"), html).alias("alternate"))


@_query(f"WITH {_ANSWERS_SQL} SELECT query_id, rank, url, title, snippet, published FROM answers")
def github_answers(spark, sf_dir):
    element = F.struct(F.col("url").alias("html_url"), F.col("title").alias("full_name"), F.col("snippet").alias("description"), F.concat("published", F.lit("T00:00:00Z")).alias("pushed_at"))
    return _plain(apis.github(_bodies(_answers(spark, sf_dir), element, lambda e: F.to_json(F.struct(e.alias("items"))))))


@_query(f"WITH {_ANSWERS_SQL} SELECT query_id, rank, url, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, snippet, '' AS published FROM answers")
def marginalia_answers(spark, sf_dir):
    element = F.struct("url", F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.col("snippet").alias("description"))
    return _plain(apis.marginalia(_bodies(_answers(spark, sf_dir), element, lambda e: F.to_json(F.struct(e.alias("results"))))))
