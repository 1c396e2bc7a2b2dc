"""URLs: one page key, several notions of a host, domain scoping and product pages.

Host notions differ on purpose: ``doc_domain`` keeps a port, ``host_of`` is the bare host name,
``site_of`` drops default ports and a leading ``www.`` of names with two dots or more.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound

# Query parameters that never change what a page shows.
JUNK_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "gbraid", "wbraid",
    "msclkid", "mc_cid", "mc_eid", "ref", "ref_", "referrer", "source", "spm", "_ga", "igshid", "yclid", "ck_subscriber_id",
    "sc_channel", "sc_campaign", "trk", "trkCampaign", "msockid",
]
# Parameters that engines and ad networks add on the way out.
CLICK_PARAMS = ["fbclid", "gclid", "gbraid", "wbraid", "msclkid", "msockid", "mc_cid", "mc_eid", "igshid", "yclid", "_ga", "ck_subscriber_id"]
# Parts of URLs that are no single product's page.
NON_PRODUCT = [
    "/s?", "/search", "/b/", "/c/", "/browse", "/deals", "/gp/bestsellers", "/category", "/categories", "/collections", "/shop/all",
    "/brands", "/blog", "/news", "/help", "/support", "/article", "/wiki", "/forum", "/community", "/question", "/review", "/compare",
    "/guide", "/about", "/press", "/career", "/policy", "/terms", "/privacy", "/cart", "/account", "/login", "/checkout", "/wishlist", "/track",
]
# Parts of paths that mark a product by themselves.
PRODUCT = ["/dp/", "/gp/product/", "/clp/", "/ip/", "/itm/", "/-/a-", "/product/", "/products/"]

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _after_scheme(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), _SCHEME, "")


def netloc_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^//([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """The key of "the same page": scheme and host folded, tracking parameters gone, the rest sorted; null stays null."""
    scheme = scheme_of(url)
    host = F.regexp_replace(F.lower(netloc_of(url)), "^.*@", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), ":443$", ""), ":80$", "")
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(p.contains("="), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v"))
    kept = F.array_sort(F.filter(F.transform(F.split(query_of(url), "&"), pair), lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin([j for j in JUNK_PARAMS if j == j.lower()])))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    parts = F.struct(F.when(scheme.isin("http", "https", ""), "https").otherwise(scheme).alias("scheme"), host.alias("host"), F.regexp_replace(path_of(url), "^$", "/").alias("path"), query.alias("query"))

    def page(p: Column) -> Column:
        asin = F.upper(F.regexp_extract(p["path"], r"(?i)^/(?:[^/]+/)?(?:dp|gp/product)/([A-Z0-9]{10})", 1))
        store = (p["host"].startswith("amazon.") | p["host"].contains(".amazon.")) & (asin != "")
        short = F.when(F.length(p["path"]) > 1, F.regexp_replace(p["path"], "/+$", "")).otherwise(p["path"])
        rooted = F.when(short.startswith("/") | (short == ""), short).otherwise(F.concat(F.lit("/"), short))
        opaque = (p["host"] == "") & (p["scheme"] != "https")
        front = F.when(opaque, F.concat(p["scheme"], F.lit(":"), short)).otherwise(F.concat(p["scheme"], F.lit("://"), p["host"], rooted))
        full = F.concat(front, F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])))
        return F.when(store, F.concat(p["scheme"], F.lit("://"), p["host"], F.lit("/dp/"), asin)).otherwise(full)

    return bound(parts, page)


def strip_trackers(url: Column) -> Column:
    """The URL without click-tracking parameters; order, spelling and fragment stay."""
    tail = F.substr(url, F.instr(url, "?") + 1)
    query, fragment = F.substring_index(tail, "#", 1), F.when(tail.contains("#"), F.substr(tail, F.instr(tail, "#"))).otherwise("")
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    parts = F.split(query, "&")
    kept = F.filter(parts, lambda p: ~(name(p).isin(CLICK_PARAMS) | name(p).startswith("utm_")))
    joined = F.array_join(kept, "&")
    clean = F.concat(F.substring_index(url, "?", 1), F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)), fragment)
    return F.when(url.contains("?") & (F.size(kept) < F.size(parts)), clean).otherwise(url)


def doc_domain(url: Column) -> Column:
    """Lower-case network location without ``www.``; a port stays."""
    return F.regexp_replace(F.lower(netloc_of(url)), r"^www\.", "")


def host_of(url: Column) -> Column:
    """The bare, lower-case host name; "" for a URL without one."""
    return F.lower(F.regexp_replace(F.regexp_replace(netloc_of(url), "^.*@", ""), r":\d*$", ""))


def site_of(url: Column) -> Column:
    """Host name with a port that is not the scheme's own, without a trailing dot, and without ``www.`` if two dots or more are in it."""
    host = F.regexp_replace(host_of(url), r"\.$", "")
    host = F.when(host.rlike(r"^www\..*\."), F.substr(host, F.lit(5))).otherwise(host)
    port = F.regexp_extract(netloc_of(url), r":(\d+)$", 1)
    own = (port == "") | ((scheme_of(url) == "http") & (port == "80")) | ((scheme_of(url) == "https") & (port == "443"))
    return F.when(own, host).otherwise(F.concat(host, F.lit(":"), port))


def host_allowed(url: Column, domains: Column) -> Column:
    """Whether the host is one of the domains or below one; case is folded."""
    host = host_of(url)
    return F.exists(domains, lambda d: (host == F.lower(d)) | host.endswith(F.concat(F.lit("."), F.lower(d))))


def domain_allowed(domain: Column, allowed: Column) -> Column:
    """As host_allowed for a domain with a port, against entries that may say ``www.``."""
    entries = F.transform(allowed, lambda a: F.regexp_replace(F.trim(F.lower(a)), r"^www\.", ""))
    return bound(F.substring_index(F.lower(domain), ":", 1), lambda host: F.exists(entries, lambda a: (a != "") & ((host == a) | host.endswith(F.concat(F.lit("."), a)))))


def operator_host(raw: Column) -> Column:
    """A bare host from what stands after ``site:``."""
    outer = r"[.,;:!?()\[\]{}<>\"'\s]+"
    host = F.regexp_replace(F.regexp_replace(raw, "^" + outer, ""), outer + "$", "")
    host = F.when(host.contains("//"), F.substr(host, F.instr(host, "//") + 2)).otherwise(host)
    host = F.regexp_replace(F.regexp_replace(host, "[/?#].*$", ""), "^.*@", "")
    host = F.lower(F.regexp_replace(F.trim(F.substring_index(host, ":", 1)), r"^\.+|\.+$", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"^\*\.", ""), r"^\.+", "")


def is_self_redirect(url: Column, own: str, marker: str) -> Column:
    """Whether a link leads back to an engine's own redirector."""
    host = host_of(url)
    return ((host == own) | host.endswith("." + own)) & _decoded(F.lower(path_of(url))).contains(marker)


def is_product_url(url: Column) -> Column:
    """Whether a URL names one product rather than a listing, an article or an account page."""

    def one(low: Column) -> Column:
        bad = F.lit(False)
        for part in NON_PRODUCT:
            bad = bad | low.contains(part)
        return ~bad & bound(path_of(low), by_path)

    def by_path(path: Column) -> Column:
        strong = F.lit(False)
        for part in PRODUCT:
            strong = strong | path.contains(part)
        return (F.length(path) > 8) & (strong | path.rlike(r"\d{5,}"))

    return bound(F.lower(url), one)
