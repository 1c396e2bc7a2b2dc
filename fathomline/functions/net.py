"""What responses and errors ask for: refused targets, waits, refresh targets, character sets, markdown replies, cookies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound
from .url import host_of, netloc_of, path_of, scheme_of

# Words of errors that mean a certificate, a link or a wall.
CERTIFICATE = [
    "certificate_verify_failed", "certificate verify failed", "certificate problem", "self signed certificate", "self-signed certificate",
    "invalid peer certificate", "unable to get local issuer certificate", "certificate subject name", "hostname mismatch", "unknownissuer",
    "certificate has expired", "certificate is not yet valid",
]
LINK = ["connecterror", "connecttimeout", "gaierror", "getaddrinfo", "unreachable", "networkerror", "readtimeout", "pooltimeout", "remoteprotocolerror"]
#: The part of a page in which a refresh is looked for, and the longest delay that is followed.
REFRESH_HEAD, REFRESH_DELAY_S = 65536, 5.0


def _literal(url: Column) -> Column:
    """The host between brackets (IPv6) or the bare host."""
    inside = F.regexp_extract(F.lower(netloc_of(url)), r"\[([0-9a-f:.]+)\]", 1)
    return F.when(inside != "", inside).otherwise(host_of(url))


def refused_target(url: Column) -> Column:
    """Why a URL must never be fetched (its scheme, or an address that is link-local or unspecified); null if it may."""

    def reason(p: Column) -> Column:
        host = p["host"]
        mapped = F.regexp_extract(host, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
        hexed = F.regexp_extract(host, "^::ffff:([0-9a-f]{1,4}:[0-9a-f]{1,4})$", 1)
        group = lambda i: F.conv(F.element_at(F.split(hexed, ":"), i), 16, 10).cast("int")
        dotted = F.when(hexed != "", F.concat_ws(".", F.floor(group(1) / 256), group(1) % 256, F.floor(group(2) / 256), group(2) % 256))
        plain = F.coalesce(dotted, F.when(mapped != "", mapped).otherwise(host))
        return (
            F.when(~p["scheme"].isin("http", "https"), F.concat(F.lit("scheme:"), F.when(p["scheme"] == "", "none").otherwise(p["scheme"])))
            .when(plain.rlike(r"^169\.254\.\d{1,3}\.\d{1,3}$") | plain.rlike("^fe[89ab][0-9a-f]:"), F.concat(F.lit("link_local:"), plain))
            .when(plain.isin("0.0.0.0", "::", "0:0:0:0:0:0:0:0"), F.concat(F.lit("unspecified:"), F.when(plain == "0.0.0.0", plain).otherwise("::")))
        )

    return bound(F.struct(scheme_of(url).alias("scheme"), _literal(url).alias("host")), reason)


def rate_limit_wait(status: Column, headers: Column, now_s: Column) -> Column:
    """Seconds until a host that limits rates may be asked again, 1 to 3600; null where no limit speaks. Header names are folded."""
    low = F.transform_keys(F.coalesce(headers, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    value = lambda k: F.trim(F.coalesce(F.try_element_at(low, F.lit(k)), F.lit("")))
    after = value("retry-after")
    stamp = F.try_to_timestamp(F.regexp_replace(after, r"^[A-Za-z]{3},\s*|\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    until = F.unix_micros(stamp) / 1e6 - now_s
    on_429 = F.when(after.rlike(r"^\d+$"), after.try_cast("double")).otherwise(F.coalesce(until, F.lit(60.0)))
    on_403 = F.coalesce(value("x-ratelimit-reset").try_cast("double") - now_s, F.lit(60.0))
    wait = F.when(status == 429, on_429).when((status == 403) & (value("x-ratelimit-remaining") == "0"), on_403)
    return F.when(wait.isNotNull(), F.greatest(F.least(wait, F.lit(3600.0)), F.lit(1.0)))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, however it is quoted; null if the tag has none."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return F.when(tag.rlike(pattern), value)


def resolved(base: Column, link: Column) -> Column:
    """A link against the URL of its page; ``.`` and ``..`` segments are folded."""
    origin = F.concat(scheme_of(base), F.lit("://"), netloc_of(base))
    path = path_of(base)
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    bare = F.regexp_replace(link, r"[?#].*$", "")
    joined = F.when(bare.startswith("/"), bare).when(bare == "", path).otherwise(F.concat(F.regexp_replace(F.when(path == "", "/").otherwise(path), "[^/]*$", ""), bare))

    def fold(full: Column) -> Column:
        parts = F.split(full, "/")
        back = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == ".", done).when(p == "..", back(done)).otherwise(F.concat(done, F.array(p))))
        return F.when(full.rlike(r"(?:^|/)\.\.?$"), F.concat(F.array_join(kept, "/"), F.lit("/"))).otherwise(F.array_join(kept, "/"))

    relative = F.concat(origin, F.when(joined.rlike(r"(?:^|/)\.\.?(?:/|$)"), bound(joined, fold)).otherwise(joined), tail)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link).when(link.startswith("//"), F.concat(scheme_of(base), F.lit(":"), link)).otherwise(relative)


def meta_refresh(status: Column, content_type: Column, html: Column, final_url: Column) -> Column:
    """Where the first refresh tag of a page leads at once; null where none does (no page, no tag, a long delay, a bare reload)."""
    tags = F.regexp_extract_all(F.substring(html, 1, REFRESH_HEAD), F.lit(r"(?is)<meta\b[^<>]*+>"), F.lit(0))
    first = F.get(F.filter(tags, lambda t: F.lower(F.trim(F.coalesce(attribute(t, "http-equiv"), F.lit("")))) == "refresh"), F.lit(0))

    def target(content: Column) -> Column:
        delay = F.regexp_extract(content, r"(?s)^\s*(\d+(?:\.\d+)?)\s*(?:[;,].*)?$", 1).try_cast("double")
        rest = F.trim(F.regexp_replace(F.regexp_extract(content, r"(?s)^\s*\d+(?:\.\d+)?\s*[;,]\s*(.*)$", 1), r"(?is)^url\s*=\s*", ""))
        raw = F.trim(F.regexp_replace(rest, r"""(?s)^(["'])(.*)\1$""", "$2"))
        return F.when((delay <= REFRESH_DELAY_S) & (raw != ""), resolved(final_url, raw))

    return F.when((status == 200) & F.lower(content_type).contains("html"), bound(attribute(first, "content"), target))


def header_charset(content_type: Column) -> Column:
    """The lower-case charset parameter of a content type; null without one."""
    parts = F.slice(F.split(F.coalesce(content_type, F.lit("")), ";"), 2, 64)
    named = F.get(F.filter(parts, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))) == "charset"), F.lit(0))
    return F.nullif(F.lower(F.regexp_replace(F.trim(F.regexp_replace(named, "^[^=]*=?", "")), '^"+|"+$', "")), F.lit(""))


def is_markdown(content_type: Column, body: Column, plain_ok: bool = True) -> Column:
    """Whether a reply is markdown: by its type, or a plain text that opens with a heading or front matter."""
    kind, head = F.lower(F.coalesce(content_type, F.lit(""))), F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+", "")
    shaped = kind.contains("text/plain") & (head.startswith("# ") | head.startswith("---"))
    return kind.contains("markdown") | (shaped if plain_ok else F.lit(False))


def error_kind(message: Column) -> Column:
    """wall, certificate, link or other."""
    low = F.lower(F.coalesce(message, F.lit("")))
    names = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return F.when(low.contains("blocked("), "wall").when(names(CERTIFICATE), "certificate").when(names(LINK) | low.startswith("timeout"), "link").otherwise("other")


def cookie_sent(host: Column, scheme: Column, domain: Column, host_only: Column, secure: Column, expires: Column, now_s: Column) -> Column:
    """Whether a browser would attach a cookie to a request now: a parent's cookie goes to its children, never the other way."""
    gone = expires.isNotNull() & (expires >= 0) & (expires <= now_s)
    below = (domain != "") & ((host == domain) | host.endswith(F.concat(F.lit("."), domain)))
    scoped = F.when(F.coalesce(host_only, F.lit(False)), host == domain).otherwise(below)
    return F.coalesce(~gone & ~(F.coalesce(secure, F.lit(False)) & (scheme != "https")) & scoped, F.lit(False))


# What publishers append to a DOI in a path.
DOI_VIEWS = ["full", "abstract", "abs", "pdf", "epdf", "epub", "fulltext", "summary", "meta", "html"]


def doi_in_url(url: Column) -> Column:
    """The DOI that a URL's path names, without what publishers append to it; null if there is none.

    Its prefix ends a segment; the segments after it are its name, up to a blank or an ampersand.
    """
    path = F.coalesce(F.try_url_decode(F.replace(path_of(url), F.lit("+"), F.lit("%2B"))), path_of(url))

    def read(segments: Column) -> Column:
        prefixes = F.transform(segments, lambda s: F.regexp_extract(s, "10[.][0-9]{4,9}$", 0))
        named = F.zip_with(F.slice(prefixes, 1, F.greatest(F.size(prefixes) - 1, F.lit(0))), F.slice(segments, 2, 1 << 20), lambda p, after: (p != "") & F.coalesce(after, F.lit("")).rlike(r"^[^\s&]"))
        at = F.array_position(named, True).cast("int")
        name = F.split_part(F.regexp_replace(F.array_join(F.slice(segments, at + 1, 1 << 20), "/"), r"\s", "&"), F.lit("&"), F.lit(1))
        return F.when(at > 0, bound(F.split(name, "/"), lambda parts: F.concat(F.get(prefixes, at - 1), F.lit("/"), _without_views(parts))))

    doi = bound(F.split(path, "/"), read)
    return F.when(F.length(doi) >= F.instr(doi, "/") + 2, doi)


def _without_views(parts: Column) -> Column:
    """The name of a DOI from its segments: without views and empty segments at its end, or the ending of a file."""
    kept = F.array_position(F.transform(F.reverse(parts), lambda p: p.isin(*DOI_VIEWS, "")), False).cast("int")
    # the first segment is the name itself, whatever it says
    return F.regexp_replace(F.array_join(F.slice(parts, 1, F.when(kept > 0, F.size(parts) - kept + 1).otherwise(1)), "/"), "[.]pdf$", "")


def set_cookie(header: Column, host: Column, now_s: Column, suffixes: list[str]) -> Column:
    """struct(name, value, domain, host_only, path, secure, http_only, expires, deleted) of a Set-Cookie header from a host; null for what is no cookie.

    A host may name itself or a parent as the cookie's domain, but none of ``suffixes`` (public ones). An
    age of zero or a time that is over deletes the cookie; attributes that cannot be read are ignored.
    """
    parts = F.split(header, ";")
    pair = F.get(parts, F.lit(0))
    key = lambda p: F.lower(F.trim(F.substring_index(p, "=", 1)))
    said = lambda p: F.when(p.contains("="), F.trim(F.substr(p, F.instr(p, "=") + 1))).otherwise("")
    rest = F.slice(parts, 2, 64)
    last = lambda name: F.try_element_at(F.transform(F.filter(rest, lambda p: key(p) == name), said), F.lit(-1))
    domain = F.nullif(F.lower(F.regexp_replace(last("domain"), r"^\.+", "")), F.lit(""))
    own = F.lower(host)
    allowed = domain.isNull() | (((own == domain) | own.endswith(F.concat(F.lit("."), domain))) & ~domain.isin(suffixes))
    age = F.when(last("max-age").rlike(r"^-?\d+$"), last("max-age").try_cast("long"))
    stamp = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.translate(last("expires"), "-", " "), r"^[A-Za-z]+,\s*|\s*GMT$", ""), F.lit("d MMM yyyy HH:mm:ss")))
    expires = F.when(age.isNotNull(), now_s.cast("long") + age).otherwise(stamp)
    name = F.trim(F.substring_index(pair, "=", 1))
    cookie = F.struct(name.alias("name"), said(pair).alias("value"), F.coalesce(domain, own).alias("domain"), domain.isNull().alias("host_only"), F.coalesce(F.nullif(last("path"), F.lit("")), F.lit("/")).alias("path"), F.exists(rest, lambda p: key(p) == "secure").alias("secure"),
                      F.exists(rest, lambda p: key(p) == "httponly").alias("http_only"), expires.alias("expires"), F.coalesce(expires <= now_s, F.lit(False)).alias("deleted"))
    return F.when(pair.contains("=") & (name != "") & allowed, cookie)


def body_key(body: Column) -> Column:
    """What tells bodies apart: length and hash."""
    return F.struct(F.length(body).alias("length"), F.xxhash64(body).alias("hash"))
