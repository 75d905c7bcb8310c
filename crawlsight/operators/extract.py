"""Extraction: one row of features per page, computed inside the row.

``page_features`` tokenizes a page once and derives every field the page rules need. There is no
explode and no shuffle: pages stay in the partition they were read in. Operators that need rows
(links, images, headings, tokens) explode the arrays made here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import markup as M
from crawlsight.functions import text as T
from crawlsight.functions import urls as U

# Elements that never have an end tag.
VOID_TAGS = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
# Elements that end an open paragraph.
BLOCKS = (
    "address|article|aside|blockquote|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|"
    "main|menu|nav|ol|p|pre|search|section|summary|table|ul"
)
BLOCK_NAMES = [name for x in BLOCKS.split("|") for name in ([f"h{i}" for i in range(1, 7)] if x == "h[1-6]" else [x])]

# Wording that marks a question heading.
QUESTION_WORDS = "what|why|how|when|where|who|which|can|does|do|is|are|will|should"

# Verbs that attribute a quotation.
ATTRIBUTION = (
    r"(?i)\b(said|says|according to|explains?|explained|noted|notes|argues?|argued|writes|wrote|"
    r"states?|stated|told)\b"
)
QUOTE = r'["“][^"”]{15,200}["”]'
STATISTIC = (
    r"(?i)\b\d+(\.\d+)?\s?%|\$\s?\d[\d,.]*|\b\d+(\.\d+)?\s?(percent|million|billion|thousand|times)\b"
)
HREFLANG = r"^[a-z]{2,3}(-[a-z]{2}|-\d{3})?$"

# Wording that counts as a trust signal, a contact path, a client-rendered page.
TRUST_WORDS = ("testimonial", "review", "trusted by", "as seen in", "guarantee", "rated", "customers", "star")
CONTACT_MARKS = ("tel:", "mailto:", "contact")
APP_SHELL_MARKS = ("__next_data__", "__nuxt", 'id="root"', 'id="app"', "ng-version", "data-reactroot")

JSONLD_OPTIONS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
LD_BLOCK = (
    r"""(?is)<script(?=[\s/>])[^>]*?\btype\s*=\s*["']?application/ld\+json["']?[^>]*+>(.*?)</script\s*+>"""
)
NODE = "array<map<string,string>>"

PASS_THROUGH = (
    "page_id", "url", "site", "headers", "elapsed_ms", "depth", "parent_url", "status", "rendered_text",
)


# --- JSON-LD ---------------------------------------------------------------------------------


def as_array(json: Column) -> Column:
    """A JSON object seen as an array of one, an array as it is."""
    return F.when(json.startswith("{"), F.concat(F.lit("["), json, F.lit("]"))).when(json.startswith("["), json)


def parse_nodes(json: Column) -> Column:
    """Objects of a JSON text as maps whose nested values stay JSON text."""
    return F.coalesce(F.from_json(as_array(json), NODE, JSONLD_OPTIONS), F.array().cast(NODE))


def strings_of(value: Column) -> Column:
    """A JSON string, or the strings of a JSON array, as an array."""
    listed = F.from_json(value, "array<string>", JSONLD_OPTIONS)
    return (
        F.when(value.isNull() | (value == ""), F.array().cast("array<string>"))
        .when(value.startswith("["), F.filter(F.coalesce(listed, F.array().cast("array<string>")), lambda x: x.isNotNull()))
        .when(value.startswith("{"), F.array().cast("array<string>"))
        .otherwise(F.array(value))
    )


def node_prop(node: Column, name: str) -> Column:
    return F.try_element_at(node, F.lit(name))


def has_prop(node: Column, name: str) -> Column:
    """Present and neither null, blank string nor empty array."""
    v = node_prop(node, name)
    return F.coalesce((T.trim_ws(v) != "") & (v != "[]"), F.lit(False))


def node_types(node: Column) -> Column:
    return strings_of(node_prop(node, "@type"))


def _graph(nodes: Column) -> Column:
    return F.flatten(F.transform(nodes, lambda n: parse_nodes(F.coalesce(node_prop(n, "@graph"), F.lit("")))))


def nested_nodes(top: Column, levels: Column) -> Column:
    """Nodes below ``top`` in ``@graph``, level by level; ``levels`` is how often the word stands in the page."""
    rounds = F.when(levels > 0, F.sequence(F.lit(1), levels)).otherwise(F.array().cast("array<int>"))
    none = F.struct(F.array().cast(NODE).alias("below"), top.alias("level"))
    step = lambda acc, _: T.let(_graph(acc["level"]), lambda g: F.struct(F.concat(acc["below"], g).alias("below"), g.alias("level")))
    return F.aggregate(rounds, none, step)["below"]


def jsonld_columns(nc: Column) -> list[Column]:
    return [F.regexp_extract_all(nc, F.lit(LD_BLOCK), F.lit(1)).alias("ld_blocks")]


# --- page features -----------------------------------------------------------------------------


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def _meta(name: str, key: str = "name") -> Column:
    """Content of the first <meta> with that name, '' when missing."""
    hit = F.filter(F.col("metas"), lambda m: m[key] == name)
    return F.coalesce(_first(hit)["content"], F.lit(""))


def _contains_any(c: Column, needles) -> Column:
    """Plain substring searches; far cheaper than one regex of alternatives on a long page."""
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def _count(arr: Column, pred) -> Column:
    return F.size(F.filter(arr, pred)).cast("long")


def _rel_has(link: Column, *rels: str) -> Column:
    return F.lower(link["rel"]).isin(*rels)


def with_optional(pages: DataFrame) -> DataFrame:
    """Add the optional page columns a source does not have, as NULL."""
    types = {
        "site": "string", "headers": "map<string,string>", "elapsed_ms": "long", "depth": "int",
        "parent_url": "string", "status": "int", "rendered_text": "string",
    }
    missing = {c: F.lit(None).cast(t) for c, t in types.items() if c not in pages.columns}
    return pages.withColumns(missing) if missing else pages


def lower_header_keys(pages: DataFrame) -> DataFrame:
    """Header names are case-insensitive: keep them lower-cased, the last spelling wins."""
    lowered = F.transform(
        F.map_entries("headers"), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last_of_each(entries: Column) -> Column:
        names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
        return F.map_from_arrays(
            names,
            F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]),
        )

    return pages.withColumn("headers", T.let(lowered, last_of_each))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Pages with comments and raw text removed and the tag arrays every operator selects from."""
    p = with_optional(pages)
    html = F.col("html")
    low_html, commented = F.col("low_html"), html.contains("<!--")
    raw_text = commented | low_html.contains("<script") | low_html.contains("<style")
    base = p.select(*PASS_THROUGH, "html", F.lower("html").alias("low_html")).select(
        *PASS_THROUGH, "html", "low_html",
        F.when(commented, M.drop_comments(html)).otherwise(html).alias("nc"),
        F.when(raw_text, M.skeleton(html)).otherwise(html).alias("skel"),
    ).withColumn("low", F.lower("skel"))
    skel, nc, low = F.col("skel"), F.col("nc"), F.col("low")
    none = F.array().cast("array<string>")
    tags = lambda names, needle: M.guarded(low, needle, M.tags(skel, names), none)
    els = lambda names, needle: M.guarded(low, needle, M.elements(skel, names), none)
    return base.select(
        *PASS_THROUGH,
        "html", "nc", "skel", "low", "low_html",
        M.head_of(skel).alias("head"),
        M.body_of(skel).alias("body"),
        T.collapse_ws(M.text_of(M.body_of(nc))).alias("body_text"),
        tags("meta", "<meta").alias("meta_tags"),
        tags("link", "<link").alias("link_tags"),
        tags("img", "<img").alias("imgs"),
        els("a", "<a").alias("anchors"),
        els("button", "<button").alias("buttons"),
        M.elements(skel, "h[1-6]").alias("heading_els"),
        tags("input", "<input").alias("inputs"),
        M.guarded(low, "<input", M.tags(
            M.guarded(low, "<label", F.regexp_replace(
                skel, rf"(?is)<label(?=[\s/>]){M.ATTRS}>(?:(?!</?label(?=[\s/>])).)*+</label\s*+>", ""
            ), skel),
            "input",
        ), none).alias("inputs_outside_label"),
        F.transform(tags("label", "<label"), lambda t: M.attr(t, "for", False)).alias("label_for"),
        els("table", "<table").alias("tables"),
        F.when(
            low_html.contains("ld+json") | commented, F.regexp_extract_all(nc, F.lit(LD_BLOCK), F.lit(1))
        ).otherwise(none).alias("ld_blocks"),
        M.guarded(low, "itemscope", F.regexp_extract_all(
            skel, F.lit(rf"(?is)<[a-z][^\s/>]*+[^>]*?\sitemscope(?=[\s/>=]){M.ATTRS}>"), F.lit(0)), none).alias("itemscopes"),
    )


def _with_head(parsed: DataFrame) -> DataFrame:
    skel = F.col("skel")
    metas = F.transform(
        "meta_tags",
        lambda t: F.struct(
            M.attr(t, "name", False).alias("name"), M.attr(t, "property", False).alias("property"),
            M.attr_or_null(t, "content").alias("content"), M.attr_or_null(t, "charset", False).alias("charset"),
            F.lower(M.attr(t, "http-equiv", False)).alias("http_equiv"),
        ),
    )
    links = F.transform(
        "link_tags",
        lambda t: F.struct(
            M.attr(t, "rel", False).alias("rel"), M.attr(t, "href").alias("href"), M.attr_or_null(t, "hreflang", False).alias("hreflang")
        ),
    )
    headings = F.transform(
        "heading_els",
        lambda e: F.struct(
            F.substring(M.tag_name(e), 2, 1).cast("int").alias("level"), M.element_text(e).alias("text"),
            M.attr_or_null(M.open_tag(e), "id", False).alias("id"),
        ),
    )
    images = F.transform(
        "imgs",
        lambda t: F.struct(
            M.attr(t, "src").alias("src"), M.attr_or_null(t, "alt").alias("alt"),
            M.attr(t, "loading", False).alias("loading"), M.attr(t, "width", False).alias("width"), M.attr(t, "height", False).alias("height"),
        ),
    )
    ctas = F.transform(
        F.concat("anchors", "buttons"),
        lambda e: F.struct(F.lower(M.element_text(e)).alias("text"), M.tag_name(e).alias("tag"), M.open_tag(e).alias("open")),
    )
    nodes = F.flatten(F.transform(F.col("ld_blocks"), lambda b: parse_nodes(F.trim(b))))
    return parsed.select(
        "*",
        metas.alias("metas"), links.alias("links_head"), headings.alias("headings"), images.alias("images"),
        ctas.alias("ctas"),
        nodes.alias("ld_top"),
        T.trim_ws(M.text_of(F.regexp_extract(
            F.col("nc"), rf"(?is)<title(?=[\s/>]){M.ATTRS}>(.*?)(?:</title|$)", 1))).alias("title"),
        F.regexp_extract(skel, rf"(?is)<html(?=[\s/>]){M.ATTRS}>", 0).alias("html_tag"),
    )


TITLE = rf"(?is)<title(?=[\s/>]){M.ATTRS}>(.*?)(?:</title|$)"


def head_texts(pages: DataFrame) -> DataFrame:
    """page_id, title and meta_desc as :func:`page_features` has them, and nothing else of the page."""
    html = F.col("html")
    base = pages.select("page_id", M.drop_comments(html).alias("nc"), M.skeleton(html).alias("skel"))
    tag = F.get(F.filter(M.tags(F.col("skel"), "meta"), lambda t: M.attr(t, "name", False) == "description"), F.lit(0))
    return base.select("page_id", T.trim_ws(M.text_of(F.regexp_extract("nc", TITLE, 1))).alias("title"), F.coalesce(M.attr_or_null(tag, "content"), F.lit("")).alias("meta_desc"))


def page_features(pages: DataFrame) -> DataFrame:
    """One row per page with every field the page rules read.

    ``pages`` needs ``page_id, url, html``; ``site, headers, elapsed_ms, depth, parent_url, status,
    rendered_text`` are used when present.
    """
    p = _with_head(parsed_pages(pages))
    g1 = F.col("ld_top")
    levels = F.aggregate("ld_blocks", F.lit(0), lambda a, b: a + F.regexp_count(b, F.lit('"@graph"')))
    p = p.withColumn("ld_below", nested_nodes(g1, levels))
    all_nodes = F.concat(g1, F.col("ld_below"))

    skel, url, body_text = F.col("skel"), F.col("url"), F.col("body_text")
    low = F.col("low")
    zero, no, none = F.lit(0).cast("long"), F.lit(False), F.array().cast("array<string>")
    n_of = lambda names: M.guarded(low, "<" + names, M.count_tags(skel, names).cast("long"), zero)
    ld_raw = F.transform(F.col("ld_blocks"), lambda b: F.trim(b))
    p = p.select(
        *PASS_THROUGH,
        "title", "headings", "images", "ctas", "imgs", "tables", "html_tag", "itemscopes", "body_text",
        "inputs", "inputs_outside_label", "label_for", "links_head", "metas",
        F.octet_length("html").alias("html_bytes"),
        # JSON-LD
        F.size("ld_blocks").cast("long").alias("n_ld_blocks"),
        _count(ld_raw, lambda b: b == "").alias("n_ld_empty"),
        _count(ld_raw, lambda b: (b != "") & F.try_parse_json(b).isNull()).alias("n_ld_bad"),
        F.filter(all_nodes, lambda n: F.coalesce(node_prop(n, "@type"), node_prop(n, "@id"), F.lit("")) != "").alias("ld_nodes"),
        # head fields
        _meta("description").alias("meta_desc"),
        _meta("robots").alias("meta_robots"),
        _meta("viewport").alias("meta_viewport"),
        T.trim_ws(_meta("author")).alias("meta_author"),
        T.trim_ws(_meta("article:author", "property")).alias("article_author"),
        F.coalesce(
            F.nullif(T.trim_ws(_meta("article:modified_time", "property")), F.lit("")),
            T.trim_ws(_meta("last-modified")),
        ).alias("meta_modified"),
        (F.exists("metas", lambda m: m["charset"].isNotNull())
         | F.coalesce(_first(F.filter("metas", lambda m: m["http_equiv"] == "content-type"))["content"], F.lit(""))
         .rlike("(?i)charset=")).alias("has_charset"),
        *[T.trim_ws(_meta(f"og:{k}", "property")).alias("og_" + k) for k in
          ("title", "description", "image", "url", "type", "site_name")],
        *[T.trim_ws(_meta(f"twitter:{k}")).alias("tw_" + k) for k in ("card", "title", "description", "image")],
        F.coalesce(_first(F.filter("links_head", lambda k: _rel_has(k, "canonical")))["href"], F.lit("")).alias("canonical"),
        F.filter("links_head", lambda k: _rel_has(k, "alternate") & k["hreflang"].isNotNull()).alias("hreflangs"),
        F.exists("links_head", lambda k: _rel_has(k, "icon", "shortcut icon", "apple-touch-icon")).alias("has_favicon"),
        F.exists("links_head", lambda k: F.array_contains(F.split(F.lower(k["rel"]), r"\s+"), "icon")).alias("has_icon_link"),
        _first(F.filter("links_head", lambda k: _rel_has(k, "manifest")))["href"].alias("manifest_href"),
        _count(F.col("links_head"), lambda k: _rel_has(k, "stylesheet")).alias("n_stylesheets"),
        M.attr(F.col("html_tag"), "lang", False).alias("html_lang"),
        # structure
        T.word_count(body_text).cast("long").alias("n_words"),
        n_of("main").alias("n_main"),
        n_of("nav").alias("n_nav"),
        n_of("footer").alias("n_footer"),
        n_of("article").alias("n_article"),
        n_of("form").alias("n_forms"),
        *[M.guarded(low, role, low.contains("role") & skel.rlike(rf"""(?i)<[^>]*\srole\s*=\s*["']?{role}["'\s>]"""), no)
          .alias("role_" + role)
          for role in ("main", "navigation", "contentinfo")],
        (F.when((low.contains("<ul") | low.contains("<ol")) & skel.rlike(r"(?i)<[uo]l(?=[\s/>])"), M.count_tags(skel, "li")).otherwise(0)
         + F.size("tables")).cast("long").alias("n_lists"),
        M.guarded(low, "<script", F.regexp_count(skel, F.lit(r"(?is)<script(?=[\s/>])[^>]*\ssrc\s*=")).cast("long"), zero).alias("n_ext_scripts"),
        _count(
            M.tags(F.col("head"), "script"),
            lambda t: ~(M.has_attr(t, "async") | M.has_attr(t, "defer") | M.attr(t, "type", False).contains("module")),
        ).alias("n_blocking"),
        _count(
            M.guarded(low, "<form", M.tags(F.regexp_extract(skel, r"(?is)<form(?=[\s/>]).*?(?:</form\s*>|$)", 0), "input|select|textarea"), none),
            lambda t: ~F.lower(M.attr(t, "type", False)).isin("hidden", "submit", "button") | (M.tag_name(t) != "input"),
        ).alias("n_form_fields"),
        T.trim_ws(M.text_of(F.regexp_extract(
            F.col("body"),
            rf"(?is)<p(?=[\s/>]){M.ATTRS}>((?:(?!</?(?:p|div|article|section|main|ul|ol|table|form|pre|blockquote|h[1-6]|header|footer|nav|aside|hr)(?=[\s/>])).)*+)",
            1,
        ))).alias("intro"),
        F.exists(
            F.regexp_extract_all(
                F.lower(F.substring(M.body_of(F.col("html")), 1, 4000)), F.lit(r"(?i)<(a|button)[^>]*>(.*?)</\1>"), F.lit(2)),
            lambda t: F.length(T.trim_ws(F.regexp_replace(t, "<[^>]+>", ""))).between(2, 39),
        ).alias("cta_early"),
        _contains_any(F.col("low_html"), TRUST_WORDS).alias("has_trust"),
        _contains_any(F.col("low_html"), CONTACT_MARKS).alias("has_contact"),
        _contains_any(F.col("low_html"), APP_SHELL_MARKS).alias("app_shell"),
        M.guarded(low, "datetime", skel.rlike(r"(?i)<time(?=[\s/>])[^>]*\sdatetime\s*="), no).alias("has_time"),
        (M.guarded(low, "itemprop", skel.rlike(r"(?i)<[^>]*\sitemprop\s*=\s*[\"']?author[\"'\s>]"), no)
         | F.exists("anchors", lambda a: F.array_contains(F.split(M.attr(M.open_tag(a), "rel", False), r"\s+"), "author"))).alias("has_byline"),
        _count(F.col("anchors"), lambda a: M.attr(M.open_tag(a), "href").startswith("#")).alias("n_hash_links"),
        _count(
            F.transform("anchors", lambda a: M.attr(M.open_tag(a), "href")),
            lambda h: U.is_http(h) & (U.origin(h) != U.origin(url)),
        ).alias("n_outbound"),
        M.guarded(low, "typeof", skel.rlike(r"(?i)<[^>]*\stypeof\s*="), no).alias("has_typeof"),
        M.guarded(low, "typeof", F.regexp_count(skel, F.lit(r"(?i)<[a-z][^>]*\stypeof\s*=")).cast("long"), zero).alias("n_typeof"),
        M.guarded(low, "vocab", skel.rlike(r"(?i)<[^>]*\svocab\s*="), no).alias("has_vocab"),
        # prose
        F.when(body_text.rlike("[0-9]"), F.regexp_count(body_text, F.lit(STATISTIC)).cast("long")).otherwise(zero).alias("n_statistics"),
        F.when(T.word_count(body_text) >= 200, _count(
            F.regexp_extract_all(body_text, F.lit(QUOTE), F.lit(0)),
            lambda q: F.substring(
                body_text, F.greatest(F.instr(body_text, q) - 60, F.lit(1)),
                F.length(q) + 60 + F.least(F.instr(body_text, q) - 1, F.lit(60)),
            ).rlike(ATTRIBUTION),
        )).otherwise(F.lit(0).cast("long")).alias("n_attributed"),
        F.transform(
            F.regexp_extract_all(body_text, F.lit("[^.!?]+[.!?]+"), F.lit(0)), lambda s: T.word_count(F.trim(s))
        ).alias("sentence_words"),
        section_words(F.col("body")).alias("section_words"),
    )
    return _finish(p)


def section_words(body: Column) -> Column:
    """Words after each h2/h3 inside sibling elements, up to the next h2/h3 or the parent's end.

    The fold keeps four numbers per section (open elements, the open paragraph, words, ended), so it is linear. A
    paragraph without an end tag ends where a block opens or what holds it closes.
    """
    sections = F.slice(F.split(body, r"(?is)<h[23](?=[\s/>])[^>]*+>.*?</h[23]\s*+>", -1), F.lit(2), F.lit(1 << 30))

    def read(t: Column) -> Column:
        """What the fold asks of a token. One pattern takes the name of a tag; names are compared with fixed lists."""
        no = F.lit(False)

        def fact(opens=no, closes=no, block=no, end_block=no, opens_p=no, end_p=no, text=F.lit(None).cast("string")) -> Column:
            facts = {"opens": opens, "closes": closes, "block": block, "end_block": end_block, "opens_p": opens_p, "end_p": end_p, "text": text}
            return F.struct(*[x.alias(name) for name, x in facts.items()])

        def opening(name: Column) -> Column:
            alone = name.isin(*VOID_TAGS.split("|")) | t.endswith("/>") | t.rlike(r"(?i)^<(?:script|style)\b")
            return fact(opens=~alone, block=name.isin(*BLOCK_NAMES), opens_p=name == "p")

        def closing(name: Column) -> Column:
            return fact(closes=(name != "") | t.rlike("(?i)^</[a-z]"), end_block=name.isin(*BLOCK_NAMES), end_p=name == "p")

        return (
            F.when(~t.startswith("<"), fact(text=t)).when((t == "<") | t.startswith("<!"), fact())
            .when(t.startswith("</"), T.let(F.lower(F.regexp_extract(t, r"^</([a-zA-Z][a-zA-Z0-9]*+)\s*+>", 1)), closing))
            .otherwise(T.let(F.lower(F.regexp_extract(t, r"^<([a-zA-Z][a-zA-Z0-9]*+)(?=[\s/>])", 1)), opening))
        )

    def words_in(section: Column) -> Column:
        tokens = F.regexp_extract_all(section, F.lit(M.TOKEN), F.lit(0))
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("words"), F.lit(False).alias("done"))

        def step(acc: Column, token: Column) -> Column:
            return F.when(acc["done"], acc).otherwise(T.let(read(token), lambda t: after_token(acc, t)))

        def after_token(acc: Column, t: Column) -> Column:
            opens, closes, block, end_block, end_p = (t[name] for name in ("opens", "closes", "block", "end_block", "end_p"))
            depth, p = acc["depth"], acc["p"]
            ended = block & (p > 0)
            before = F.when(ended, p - 1).otherwise(depth)
            outer = closes & ~end_p & (p > 0) & ((depth == p) | end_block)
            after = (
                F.when(opens, before + 1).when(end_p, F.when(p > 0, p - 1).otherwise(depth)).when(outer, p - 2)
                .when(closes, depth - 1).otherwise(before))
            paragraph = F.when(opens & t["opens_p"], before + 1).when(ended | end_p | outer, 0).otherwise(p)
            return F.struct(
                after.alias("depth"), paragraph.alias("p"),
                (acc["words"] + F.when(t["text"].isNotNull() & (depth > 0), T.word_count(T.collapse_ws(t["text"]))).otherwise(0))
                .cast("long").alias("words"),
                (after < 0).alias("done"),
            )

        return F.aggregate(tokens, start, step)["words"]

    several = F.regexp_count(body, F.lit(r"(?i)<h[23](?=[\s/>])")) >= 2
    return F.when(several, F.transform(sections, words_in)).otherwise(F.array().cast("array<bigint>"))


def _finish(p: DataFrame) -> DataFrame:
    """Counts over the small arrays, and the arrays that later operators still need."""
    h = F.col("headings")
    h23 = F.filter(h, lambda x: x["level"].isin(2, 3))
    h23_text = F.filter(F.transform(h23, lambda x: x["text"]), lambda t: t != "")
    levels = F.transform(h, lambda x: x["level"])
    field = lambda t: ~F.lower(M.attr(t, "type", False)).isin("hidden", "submit", "button")
    labelled = F.col("label_for")
    imgs = F.col("images")
    sub = F.filter("sentence_words", lambda n: n >= 4)
    generic = ("submit", "click here", "here", "go", "learn more", "read more")
    return p.withColumns({
        "n_h1": _count(h, lambda x: x["level"] == 1),
        "n_headings": F.size(h).cast("long"),
        "heading_skip": F.exists(
            F.zip_with(F.slice(levels, 2, 1 << 30), levels, lambda cur, prev: cur - prev), lambda d: F.coalesce(d > 1, F.lit(False))),
        "n_h23": F.size(h23).cast("long"),
        "n_h23_text": F.size(h23_text).cast("long"),
        "n_h23_ids": _count(h23, lambda x: x["id"].isNotNull()),
        "n_questions": _count(h23_text, lambda t: t.endswith("?") | t.rlike(rf"(?i)^({QUESTION_WORDS})\b")),
        "n_imgs": F.size(imgs).cast("long"),
        "n_img_no_alt": _count(imgs, lambda i: F.coalesce(T.trim_ws(i["alt"]), F.lit("")) == ""),
        "n_img_no_size": _count(imgs, lambda i: (i["width"] == "") | (i["height"] == "")),
        "n_img_lazy": _count(imgs, lambda i: F.lower(i["loading"]) == "lazy"),
        "n_img_decorative_alt": _count(
            imgs, lambda i: i["src"].rlike("spacer|divider|decoration") & (F.coalesce(T.trim_ws(i["alt"]), F.lit("")) != "")),
        "n_inputs": _count(F.col("inputs"), field),
        "n_unlabelled": _count(
            F.col("inputs_outside_label"),
            lambda t: field(t) & (M.attr(t, "aria-label", False) == "") & (M.attr(t, "aria-labelledby", False) == "")
            & ~((M.attr(t, "id", False) != "") & F.array_contains(labelled, M.attr(t, "id", False)))),
        "n_unnamed_buttons": _count(
            F.col("ctas"),
            lambda c: (c["text"] == "") & ((c["tag"] == "button") | (M.attr(c["open"], "role", False) == "button"))
            & (M.attr(c["open"], "aria-label", False) == "") & (M.attr(c["open"], "aria-labelledby", False) == "")
            & (M.attr(c["open"], "title") == "")),
        "n_ctas": _count(F.col("ctas"), lambda c: c["text"] != ""),
        "n_generic_ctas": _count(F.col("ctas"), lambda c: c["text"].isin(*generic)),
        "n_tables": F.size("tables").cast("long"),
        "n_tables_unheaded": _count(
            F.col("tables"),
            lambda t: ~(F.regexp_extract(t, r"(?is)<thead(?=[\s/>]).*?</thead\s*>", 0).rlike(r"(?i)<th(?=[\s/>])")
                        | F.regexp_extract(t, r"(?is)<tr(?=[\s/>])[^>]*+>(?:(?!</?tr(?=[\s/>])).)*+", 0).rlike(r"(?i)<th(?=[\s/>])"))),
        "n_itemscope": F.size("itemscopes").cast("long"),
        "n_itemscope_untyped": _count(F.col("itemscopes"), lambda t: M.attr(t, "itemtype", False) == ""),
        "n_itemscope_foreign": _count(
            F.col("itemscopes"),
            lambda t: (M.attr(t, "itemtype", False) != "") & ~M.attr(t, "itemtype", False).rlike("(?i)^https?://schema\\.org/")),
        "n_sentences": F.size(sub).cast("long"),
        "sentence_mean": F.when(
            F.size(sub) > 0, F.aggregate(sub, F.lit(0), lambda a, x: a + x).cast("double") / F.size(sub)),
        "max_section_words": F.coalesce(F.array_max("section_words"), F.lit(0)).cast("long"),
    }).drop(
        "images", "imgs", "tables", "inputs", "inputs_outside_label", "label_for", "links_head", "itemscopes",
        "sentence_words", "section_words", "ctas", "html_tag",
    )


# --- row-level extractions -----------------------------------------------------------------------


def tokens(pages: DataFrame) -> DataFrame:
    """``ext_elements``: every token of every page with its position, kind and tag name."""
    t = F.col("token")
    return pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(M.TOKEN), F.lit(0))).alias("pos", "token")
    ).select(
        "page_id", "pos",
        F.when(t.startswith("<!--"), "comment")
        .when(t.rlike(r"(?i)^<script\b"), "script")
        .when(t.rlike(r"(?i)^<style\b"), "style")
        .when(t.rlike("^<[!]"), "doctype")
        .when(t.rlike("(?i)^</[a-z]"), "close")
        .when(t.rlike("(?i)^<[a-z]"), "open")
        .otherwise("text").alias("kind"),
        M.tag_name(t).alias("tag"), "token",
    )


def head_fields(pages: DataFrame) -> DataFrame:
    """``ext_head_fields``: the head of each page as one row."""
    cols = [
        "page_id", "url", "title", "meta_desc", "meta_robots", "meta_viewport", "meta_author", "canonical", "html_lang",
        "has_charset", "og_title", "og_description", "og_image", "og_url", "og_type", "og_site_name",
        "tw_card", "tw_title", "tw_description", "tw_image",
    ]
    return page_features(pages).select(*cols)


def main_text_column(html: Column) -> Column:
    """Text of the document without scripts, styles and site chrome, lower-cased, one blank between words."""
    skel = M.skeleton(html)
    for name in ("noscript", "svg", "nav", "header", "footer"):
        skel = M.without(skel, name)
    return F.lower(T.collapse_ws(M.text_of(skel)))


def main_text(pages: DataFrame) -> DataFrame:
    """``ext_main_text``"""
    return pages.select("page_id", "url", main_text_column(F.col("html")).alias("text"))


def content_text_column(html: Column) -> Column:
    """Body text without scripts, styles and noscript."""
    return T.collapse_ws(M.text_of(M.body_of(M.without(M.skeleton(html), "noscript"))))


def headings(pages: DataFrame) -> DataFrame:
    """``ext_headings``: h1 to h6 in document order."""
    els = M.elements(M.skeleton(F.col("html")), "h[1-6]")
    e = F.col("el")
    return pages.select("page_id", "url", F.posexplode(els).alias("pos", "el")).select(
        "page_id", "url", "pos", F.substring(M.tag_name(e), 2, 1).cast("int").alias("level"),
        M.element_text(e).alias("text"), M.attr_or_null(M.open_tag(e), "id", False).alias("id"),
    )


def page_snapshot(pages: DataFrame) -> DataFrame:
    """``agg_page_snapshot``: one compact row per page."""
    f = page_features(pages)
    text_of = lambda *levels: F.filter(F.transform(F.filter("headings", lambda h: h["level"].isin(*levels)), lambda h: h["text"]), lambda t: t != "")
    first = F.coalesce(F.get(F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]), F.lit(0)), F.lit(""))
    types = F.array_distinct(F.flatten(F.transform("ld_nodes", node_types)))
    return f.withColumn("types", types).select(
        "page_id", "title", "meta_desc", first.alias("h1"), F.array_join(F.slice(text_of(2, 3), 1, 12), " | ").alias("headings"), F.left("intro", F.lit(500)).alias("intro"),
        F.array_join("types", ",").alias("jsonld_types"), F.arrays_overlap("types", F.array(*map(F.lit, ("FAQPage", "QAPage", "HowTo")))).alias("has_faq"),
        (F.col("has_byline") | (F.col("meta_author") != "")).alias("has_author"), F.col("has_time").alias("has_date"), (F.col("n_statistics") > 0).alias("has_statistics"),
        "n_words", "n_outbound", F.left("body_text", F.lit(2500)).alias("excerpt"))


def skip_reason(status: Column, content_type: Column) -> Column:
    """``src_page_filter``: why a fetched page is not audited, NULL when it is."""
    return F.when(~status.between(200, 299), F.concat(F.lit("HTTP "), status.cast("string"))).when(
        (F.coalesce(content_type, F.lit("")) != "") & ~content_type.rlike("(?i)text/html"), "Not an HTML page")


def unlabelled_inputs(pages: DataFrame) -> DataFrame:
    """``join_label_inputs``: fields outside a label that no label of their page names, one row each."""
    p = parsed_pages(pages).select("page_id", "inputs_outside_label", "label_for")
    tag = F.col("tag")
    fields = p.select("page_id", F.posexplode("inputs_outside_label").alias("pos", "tag")).filter(
        ~F.lower(M.attr(tag, "type", False)).isin("hidden", "submit", "button") & (M.attr(tag, "aria-label", False) == "") & (M.attr(tag, "aria-labelledby", False) == ""))
    named = p.select("page_id", F.explode("label_for").alias("id")).filter("id <> ''").distinct()
    return fields.select("page_id", "pos", M.attr(tag, "id", False).alias("id"), M.attr(tag, "name", False).alias("name")).join(named, ["page_id", "id"], "left_anti")


def jsonld_nodes(pages: DataFrame) -> DataFrame:
    """``ext_jsonld``: typed JSON-LD nodes with @graph flattened, one row per node."""
    f = page_features(pages)
    return (
        f.select("page_id", "url", F.posexplode("ld_nodes").alias("node_no", "node"))
        .withColumn("types", node_types(F.col("node")))
        .withColumn("same_as", strings_of(node_prop(F.col("node"), "sameAs")))
    )
