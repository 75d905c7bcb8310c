"""Column helpers for URLs: parts, resolving, normalising, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlsight.functions.text import let

# Query parameters that do not change a page.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid",
)

# Path extensions that are not pages.
NON_PAGE_EXTENSIONS = (
    r"pdf|jpe?g|png|gif|svg|webp|ico|bmp|css|js|mjs|json|xml|zip|rar|7z|gz|mp4|mp3|wav|avi|mov|wmv|"
    r"doc|docx|xls|xlsx|ppt|pptx|woff2?|ttf|eot|otf|csv|rss|atom"
)

_AUTHORITY = r"(?i)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:\[\]]+)(:[0-9]+)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*):", 1))


def hostname(url: Column) -> Column:
    """Lower-case host, '' when there is none."""
    return F.lower(F.regexp_extract(url, _AUTHORITY, 2))


def parts(url: Column) -> Column:
    """A URL read once: scheme, host, port (with its colon), path, rest (query and fragment)."""
    return F.struct(
        scheme(url).alias("scheme"), hostname(url).alias("host"), F.regexp_extract(url, _AUTHORITY, 3).alias("port"), path(url).alias("path"),
        F.regexp_extract(url, r"^[^?#]*([?#].*)$", 1).alias("rest"),
    )


def origin_of(u: Column) -> Column:
    """scheme://host[:port] of :func:`parts`; a default port is dropped."""
    default = ((u["scheme"] == "http") & (u["port"] == ":80")) | ((u["scheme"] == "https") & (u["port"] == ":443"))
    return F.when(u["host"] == "", F.lit("")).otherwise(F.concat(u["scheme"], F.lit("://"), u["host"], F.when(default, F.lit("")).otherwise(u["port"])))


def origin(url: Column) -> Column:
    return let(parts(url), origin_of)


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    """Query with its leading '?', '' when empty."""
    q = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(q == "?", F.lit("")).otherwise(q)


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^/?#\s]+(?:[/?#]|$)")


def squeeze_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments of an absolute path; a fold over the path's own segments."""
    segs = F.split(F.regexp_replace(p, "^/", ""), "/")
    folded = F.aggregate(
        segs,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(p.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(F.lit("/"), F.array_join(folded, "/"), tail)
    return F.when(p.rlike(r"/\.{1,2}(/|$)"), F.regexp_replace(out, "^//$", "/")).otherwise(p)


def percent_encode(url: Column) -> Column:
    """Blanks and non-ASCII characters as UTF-8 percent escapes; the rest is kept."""
    pieces = F.call_function(
        "transform",
        F.regexp_extract_all(url, F.lit("[\\x21-\\x7e]+|[^\\x21-\\x7e]+"), F.lit(0)),
        F.expr("u_p -> CASE WHEN u_p RLIKE '^[!-~]' THEN u_p ELSE replace(url_encode(u_p), '+', '%20') END"),
    )
    return F.when(url.rlike(r"[^\x21-\x7e]"), F.array_join(pieces, "")).otherwise(url)


def clean_path(p: Column) -> Column:
    """Dot segments resolved, blanks and non-ASCII characters escaped."""
    return let(squeeze_dots(p), percent_encode)


def canonical_form(url: Column) -> Column:
    """Lower-case scheme and host, default port off, '/' for an empty path, dot segments resolved."""
    return let(parts(url), lambda u: F.concat(origin_of(u), clean_path(u["path"]), percent_encode(u["rest"])))


def absolute_form(href: Column, base: Column) -> Column:
    """``href`` joined to the page ``base``, not yet normalised; NULL when it cannot be parsed.

    A scheme other than http(s) that parses (``data:``, ``ftp:``) is kept as it is written.
    """
    known = F.struct(F.trim(href).alias("h"), origin(base).alias("origin"), path(base).alias("path"))

    def joined(k: Column) -> Column:
        h, no = k["h"], F.lit(None).cast("string")
        whole = (
            F.when(h.rlike(r"(?i)^https?://(?:\[[0-9a-f:.]+\](?::[0-9]*)?|[^/?#\s<>\[\]^|]+)(?:[/?#].*)?$"), h)
            .when(h.rlike(r"(?i)^https?:"), no)
            .when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.when(h.rlike(r"^//[^/?#\s<>]+"), F.concat(scheme(base), F.lit(":"), h)))
            .when(h.startswith("/"), F.concat(k["origin"], h))
            .when(h.startswith("?"), F.concat(k["origin"], k["path"], h))
            .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
            .when(h.rlike(r"(?i)^[^\s:/?#]*\s[^:/?#]*:"), no)
            .otherwise(F.concat(k["origin"], F.regexp_replace(k["path"], "[^/]*$", ""), h))
        )
        return F.when(k["origin"] != "", whole)

    return let(known, joined)


def resolve(href: Column, base: Column) -> Column:
    """Absolute, normalised form of ``href`` seen on page ``base``."""
    return let(absolute_form(href, base), lambda a: F.when(is_http(a), canonical_form(a)).otherwise(a))


def normalize(url: Column) -> Column:
    """Key under which two spellings of a page address are one page."""
    tracked = "|".join(TRACKING_PARAMS)

    def key(u: Column) -> Column:
        p, q = u["path"], u["query"]
        kept = F.array_join(F.filter(F.split(F.substr(q, F.lit(2)), "&"), lambda x: ~x.rlike(rf"^(?:{tracked})(?:=|$)")), "&")
        slim = F.when(F.length(p) > 1, F.regexp_replace(p, "/$", "")).otherwise(p)
        return F.concat(u["origin"], slim, let(kept, lambda k: F.when(k == "", F.lit("")).otherwise(F.concat(F.lit("?"), k))))

    def cleaned(u: Column) -> Column:
        raw = F.regexp_extract(u["rest"], r"^(\?[^#]*)", 1)
        return F.struct(origin_of(u).alias("origin"), clean_path(u["path"]).alias("path"), percent_encode(raw).alias("query"))

    return F.when(~is_http(url), url).otherwise(let(let(parts(url), cleaned), key))


def crawlable(url: Column, site_origin: Column) -> Column:
    return is_http(url) & (origin(url) == site_origin) & ~path(url).rlike(rf"(?i)\.({NON_PAGE_EXTENSIONS})(\?.*)?$")


def is_private_ipv4(host: Column) -> Column:
    part = F.split(host, r"\.")
    a, b = part.getItem(0).cast("int"), F.get(part, F.lit(1)).cast("int")
    return (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127))
        | (a >= 224)
    )


def is_safe(url: Column) -> Column:
    """Literal address rule: http(s) and not a loopback, private, link-local or internal host."""
    host6 = F.lower(F.regexp_extract(url, r"(?i)^https?://\[([0-9a-f:.]+)\]", 1))
    host = hostname(url)
    mapped = F.regexp_extract(host6, r"^::ffff:([0-9.]+)$", 1)
    named_bad = host.isin("localhost", "localhost.localdomain", "metadata.google.internal") | host.rlike(
        r"\.(local|internal)$"
    )
    ipv4_bad = F.when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), is_private_ipv4(host)).otherwise(F.lit(False))
    ipv6_bad = F.when(host6 != "", host6.isin("::1", "::") | host6.rlike("^(fe80:|fc|fd)")
        | F.when(mapped != "", is_private_ipv4(mapped)).otherwise(F.lit(False))
    ).otherwise(F.lit(False))
    has_host = is_http(url) & ((host != "") | (host6 != ""))
    return F.coalesce(has_host & ~named_bad & ~ipv4_bad & ~ipv6_bad, F.lit(False))


def path_label(url: Column) -> Column:
    """Path and query without a trailing slash, '/' for the home page."""
    p = F.regexp_replace(path(url), "/+$", "")
    label = F.concat(p, query(url))
    return F.when(~is_http(url), url).when(label == "", F.lit("/")).otherwise(label)


def extension(url: Column) -> Column:
    """Lower-case extension of an absolute URL's path, NULL when it has none."""
    return F.when(
        is_http(url), F.nullif(F.lower(F.regexp_extract(path(url), r"\.([a-zA-Z0-9]+)(?:$|\?)", 1)), F.lit(""))
    )
