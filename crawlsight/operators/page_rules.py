"""Page rules: each family is one array of findings over the features of a page (no shuffle)."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import urls as U
from crawlsight.functions.findings import FINDING, Checks, explode_findings
from crawlsight.functions.text import let, trim_ws
from crawlsight.operators.extract import HREFLANG, PASS_THROUGH, has_prop, node_prop, node_types, page_features, parse_nodes, strings_of, with_optional
from crawlsight.session import fence

c = F.col

# Schema.org types known to the checks.
KNOWN_TYPES = (
    "Thing Organization Corporation LocalBusiness WebSite WebPage WebApplication BreadcrumbList ListItem ItemList "
    "FAQPage Question Answer Article NewsArticle BlogPosting TechArticle Report Product Offer AggregateOffer "
    "AggregateRating Review Rating Person Event MusicEvent SportsEvent BusinessEvent Place PostalAddress "
    "GeoCoordinates ImageObject VideoObject SearchAction EntryPoint ContactPoint Brand Recipe HowTo HowToStep "
    "HowToSection JobPosting Course Book Movie MusicRecording SoftwareApplication Service Restaurant Store Hotel "
    "MedicalOrganization EducationalOrganization GovernmentOrganization SiteNavigationElement CollectionPage "
    "ProfilePage QAPage ItemPage AboutPage ContactPage VideoGame CreativeWork DataFeed Dataset Comment "
    "DiscussionForumPosting"
).split()

# Required properties by schema.org type.
REQUIRED = {
    "Article": ["headline", "author", "datePublished"],
    "Organization": ["name", "url"],
    "WebSite": ["name", "url"],
    "Product": ["name"],
    "LocalBusiness": ["name", "address"],
    "Person": ["name"],
    "Event": ["name", "startDate", "location"],
}

# Security header and the weight of its absence.
SECURITY_HEADERS = {
    "strict-transport-security": 15,
    "content-security-policy": 12,
    "x-frame-options": 10,
    "x-content-type-options": 8,
    "referrer-policy": 6,
    "permissions-policy": 5,
    "cross-origin-opener-policy": 7,
    "cross-origin-embedder-policy": 6,
}


def header(name: str) -> Column:
    return F.coalesce(F.try_element_at(c("headers"), F.lit(name)), F.lit(""))


def _blank(name: str) -> Column:
    return c(name) == ""


def seo() -> Column:
    k = Checks("seo")
    title_len, desc_len = F.length("title"), F.length("meta_desc")
    desc = trim_ws(c("meta_desc"))
    k.issue("title", 14, _blank("title"))
    k.issue("title-length", 6, ~_blank("title") & ~title_len.between(10, 65), n=title_len)
    k.ok("title", title_len.between(10, 65))
    k.issue("meta-desc", 9, desc == "")
    k.issue("meta-desc-length", 5, (desc != "") & ~desc_len.between(50, 165), n=desc_len)
    k.ok("meta-desc", (desc != "") & desc_len.between(50, 165))
    k.issue("meta-desc-duplicates-title", 3, (desc != "") & (F.lower(desc) == F.lower("title")))

    absolute = c("canonical").rlike("(?i)^https?://")
    same = U.origin(c("canonical")) == U.origin(c("url"))
    k.issue("canonical", 8, _blank("canonical"))
    k.issue("canonical-relative", 3, ~_blank("canonical") & ~absolute, info=c("canonical"))
    k.issue("canonical-cross-domain", 4, absolute & ~same & (U.origin(c("canonical")) != ""), info=c("canonical"))
    k.ok("canonical", absolute & (same | (U.origin(c("canonical")) == "")))

    k.issue("h1-missing", 10, c("n_h1") == 0)
    k.issue("h1-multiple", 6, c("n_h1") > 1, n=c("n_h1"))
    k.ok("h1", c("n_h1") == 1)
    k.issue("heading-order", 6, c("heading_skip"))
    k.ok("heading-order", ~c("heading_skip") & (c("n_headings") > 1))
    share = c("n_img_no_alt") / F.greatest("n_imgs", F.lit(1))
    k.issue("alt-text", F.when(share > 0.5, 10).otherwise(6), c("n_img_no_alt") > 0, n=c("n_img_no_alt"))
    k.ok("alt-text", (c("n_imgs") > 0) & (c("n_img_no_alt") == 0))
    k.issue("noindex", 15, c("meta_robots").rlike("(?i)noindex"))

    alts = c("hreflangs")
    code = lambda x: F.lower(trim_ws(x["hreflang"]))
    some = F.size(alts) > 0
    bad = F.exists(alts, lambda x: (code(x) != "x-default") & ~code(x).rlike(HREFLANG))
    self_ref = F.exists(alts, lambda x: U.resolve(x["href"], c("url")) == U.canonical_form(c("url")))
    k.issue("hreflang-invalid", 5, some & bad)
    k.ok("hreflang-valid", some & ~bad)
    k.issue("hreflang-no-x-default", 3, (F.size(alts) > 1) & ~F.exists(alts, lambda x: code(x) == "x-default"))
    k.issue("hreflang-no-self-reference", 4, some & ~F.coalesce(self_ref, F.lit(False)))

    k.either("meta-charset", 3, ~c("has_charset"))
    k.either("favicon", 3, ~c("has_favicon"))
    k.issue("thin-content", 6, c("n_words").between(1, 299), n=c("n_words"))
    k.ok("thin-content", c("n_words") >= 300, n=c("n_words"))
    untidy = U.path(c("url")).rlike("[A-Z_]") | (F.length(U.query(c("url"))) > 30)
    k.either("url-structure", 2, untidy)

    k.either("og-basic", 5, _blank("og_title") | _blank("og_description"))
    for tag, weight in (("image", 8), ("url", 3), ("type", 2), ("site_name", 2)):
        k.either("og-" + tag.replace("_", "-"), weight, _blank("og_" + tag))
    valid_card = c("tw_card").isin("summary", "summary_large_image", "app", "player")
    k.issue("twitter-card", 4, _blank("tw_card"))
    k.issue("twitter-card-invalid", 4, ~_blank("tw_card") & ~valid_card, info=c("tw_card"))
    k.ok("twitter-card", valid_card)
    gap = (
        (_blank("tw_title") & _blank("og_title")) | (_blank("tw_description") & _blank("og_description"))
        | (_blank("tw_image") & _blank("og_image"))
    )
    k.issue("twitter-content", 3, ~_blank("tw_card") & gap)
    k.ok("twitter-content", ~_blank("tw_card") & ~gap)
    return k.column()


# --- structured data -----------------------------------------------------------------------------


def missing_props(node: Column, props: list[str]) -> Column:
    """``set_missing_props``: required properties the node does not have."""
    present = F.filter(F.array(*[F.when(has_prop(node, p), F.lit(p)) for p in props]), lambda x: x.isNotNull())
    return F.array_except(F.array(*[F.lit(p) for p in props]), present)


def missing_by_type(nodes: DataFrame) -> DataFrame:
    """A row per node and type with required properties: those that the node lacks (none is an empty array)."""
    articles = {kind: REQUIRED["Article"] for kind in ("Article", "NewsArticle", "BlogPosting")}
    wanted = articles | {"Corporation": REQUIRED["Organization"]} | {kind: props for kind, props in REQUIRED.items() if kind != "Article"}
    node = F.col("node")
    per_type = [F.when(F.array_contains("types", kind), F.struct(F.lit(kind).alias("type"), missing_props(node, props).alias("missing"))) for kind, props in wanted.items()]
    return nodes.select("page_id", F.explode(F.filter(F.array(*per_type), lambda x: x.isNotNull())).alias("m")).select("page_id", "m.type", "m.missing")


def _search_action_state(node: Column) -> Column:
    action = F.get(
        F.filter(parse_nodes(F.coalesce(node_prop(node, "potentialAction"), F.lit(""))),
                 lambda a: F.array_contains(node_types(a), "SearchAction")), F.lit(0))

    def state(action: Column) -> Column:
        target = node_prop(action, "target")
        template = F.when(target.startswith("{"), F.get_json_object(target, "$.urlTemplate")).otherwise(target)
        good_target = F.coalesce(template.rlike(r"\{.*search_term_string.*\}"), F.lit(False))
        good_query = F.coalesce(node_prop(action, "query-input").rlike("search_term_string"), F.lit(False))
        return F.when(action.isNull(), "missing").when(~good_target, "target").when(~good_query, "query-input").otherwise("valid")

    return let(action, state)


def _breadcrumb_problems(node: Column) -> Column:
    items = parse_nodes(F.coalesce(node_prop(node, "itemListElement"), F.lit("")))

    def problems(item: Column) -> Column:
        inner = F.get(parse_nodes(F.coalesce(node_prop(item, "item"), F.lit(""))), F.lit(0))
        named = has_prop(item, "name") | has_prop(inner, "name")
        return (
            node_prop(item, "position").isNull().cast("int") + (~F.coalesce(named, F.lit(False))).cast("int")
            + (~has_prop(item, "item")).cast("int")
        )

    total = lambda found: F.aggregate(F.transform(found, problems), F.lit(0), lambda a, x: a + x)
    return let(items, lambda found: F.when(F.size(found) == 0, F.lit(1)).otherwise(total(found)))


def _faq_problems(node: Column) -> Column:
    qs = parse_nodes(F.coalesce(node_prop(node, "mainEntity"), F.lit("")))

    def problems(q: Column) -> Column:
        answer = F.get(parse_nodes(F.coalesce(node_prop(q, "acceptedAnswer"), F.lit(""))), F.lit(0))
        return (
            (~F.array_contains(node_types(q), "Question")).cast("int") + (~has_prop(q, "name")).cast("int")
            + (~F.coalesce(has_prop(answer, "text"), F.lit(False))).cast("int")
        )

    total = lambda found: F.aggregate(F.transform(found, problems), F.lit(0), lambda a, x: a + x)
    return let(qs, lambda found: F.when(F.size(found) == 0, F.lit(1)).otherwise(total(found)))


def _node_checks(node: Column, t: Column) -> Column:
    """Findings of one node for one of its types; several nodes give several findings.

    A type has checks of its own, so only those are tried. What they ask of the node (missing properties, problems of its
    items) is computed once: conditions, weights and severities all read it, and in here Spark shares nothing by itself.
    """

    def of(value: Column, fill) -> Column:
        def found(v: Column) -> Column:
            k = Checks("seo")
            fill(k, v)
            return k.column()

        return let(value, found)

    def required(kind: str, bad_id, good_id, one: int, many: int, more=lambda k, some: None) -> Column:
        def fill(k: Checks, missing: Column) -> None:
            some = F.size(missing) > 0
            k.issue(bad_id, F.when(F.size(missing) > 1, many).otherwise(one), some, n=F.size(missing), info=F.array_join(missing, ", "))
            k.ok(good_id, ~some)
            more(k, some)

        return of(missing_props(node, REQUIRED[kind]), fill)

    def items(bad_id: str, good_id: str, problems: Column) -> Column:
        return of(problems, lambda k, n: k.issue(bad_id, F.when(n > 1, 8).otherwise(5), n > 0, n=n).ok(good_id, n == 0))

    def action(k: Checks, state: Column) -> None:
        k.issue("schema-searchaction-missing", 4, state == "missing")
        k.issue("schema-searchaction-invalid", 5, state.isin("target", "query-input"), info=state)
        k.ok("schema-searchaction", state == "valid")

    def product(k: Checks, some: Column) -> None:
        offers = parse_nodes(F.coalesce(node_prop(node, "offers"), F.lit("")))
        priced = let(offers, lambda o: (F.size(o) > 0) & F.forall(o, lambda x: has_prop(x, "price") & has_prop(x, "priceCurrency")))
        k.issue("schema-product-offers", 6, ~(has_prop(node, "offers") & priced))
        k.issue("schema-product-image", 3, ~has_prop(node, "image"))

    article = required("Article", F.concat(F.lit("schema-article-required-"), t), F.concat(F.lit("schema-article-"), t), 6, 9)
    org = required("Organization", "schema-org-required", "schema-org", 5, 8,
                   lambda k, some: k.issue("schema-org-logo", 3, ~some & ~has_prop(node, "logo")))
    site = F.concat(required("WebSite", "schema-website-required", "schema-website", 6, 6), of(_search_action_state(node), action))
    local = required("LocalBusiness", "schema-localbusiness-required", "schema-localbusiness", 7, 7,
                     lambda k, some: k.issue("schema-localbusiness-phone", 3, ~has_prop(node, "telephone")))
    return (
        F.when(t.isin("Article", "NewsArticle", "BlogPosting"), article)
        .when(t.isin("Organization", "Corporation"), org)
        .when(t == "WebSite", site)
        .when(t == "BreadcrumbList", items("schema-breadcrumb-invalid", "schema-breadcrumb", _breadcrumb_problems(node)))
        .when(t == "FAQPage", items("schema-faq-invalid", "schema-faq", _faq_problems(node)))
        .when(t == "Product", required("Product", "schema-product-required", "schema-product", 6, 6, product))
        .when(t == "LocalBusiness", local)
        .when(t == "Person", required("Person", "schema-person-required", "schema-person", 5, 5))
        .when(t == "Event", required("Event", "schema-event-required", "schema-event", 5, 8))
        .otherwise(F.array().cast(f"array<{FINDING}>"))
    )


def structured() -> Column:
    nodes = c("ld_nodes")
    k = Checks("seo")
    k.issue("jsonld-missing", 8, c("n_ld_blocks") == 0)
    k.ok("jsonld-present", c("n_ld_blocks") > 0, n=c("n_ld_blocks"))
    k.issue("jsonld-parse-error", 10, c("n_ld_bad") > 0, n=c("n_ld_bad"))
    k.issue("jsonld-empty", 3, c("n_ld_empty") > 0, n=c("n_ld_empty"))
    untyped = F.size(F.filter(nodes, lambda n: F.size(node_types(n)) == 0))
    k.issue("schema-missing-type", 8, untyped > 0, n=untyped)
    no_context = F.size(F.filter(
        nodes,
        lambda n: ~F.coalesce(node_prop(n, "@context"), F.lit("")).rlike("(?i)schema\\.org")
        & node_prop(n, "@graph").isNull() & (F.coalesce(node_prop(n, "@type"), F.lit("")) != "")))
    k.issue("schema-missing-context", 6, no_context > 0, n=no_context)
    types = F.array_distinct(F.flatten(F.transform(nodes, node_types)))
    bare = lambda t: F.regexp_replace(t, "(?i)^https?://schema\\.org/", "")
    unknown = F.filter(types, lambda t: ~bare(t).rlike("^[A-Z][A-Za-z0-9]*$") | ~bare(t).isin(*KNOWN_TYPES))
    k.issue("schema-invalid-type", 7, F.size(unknown) > 0, n=F.size(unknown), info=F.array_join(unknown, ", "))

    m = Checks("seo")
    m.issue("microdata-missing-itemtype", 5, c("n_itemscope_untyped") > 0, n=c("n_itemscope_untyped"))
    m.issue("microdata-invalid-itemtype", 4, c("n_itemscope_foreign") > 0, n=c("n_itemscope_foreign"))
    m.ok("microdata", (c("n_itemscope") > 0) & (c("n_itemscope_untyped") == 0) & (c("n_itemscope_foreign") == 0), n=c("n_itemscope"))
    m.issue("rdfa-missing-vocab", 4, c("has_typeof") & ~c("has_vocab"))
    m.ok("rdfa", c("has_typeof") & c("has_vocab"), n=c("n_typeof"))
    m.issue("structured-data-none", 8, (F.size(nodes) == 0) & (c("n_itemscope") == 0) & ~c("has_typeof"))

    per_node = F.flatten(F.transform(nodes, lambda n: F.flatten(F.transform(node_types(n), lambda t: _node_checks(n, t)))))
    per_node = F.when(F.size(nodes) == 0, F.array().cast(f"array<{FINDING}>")).otherwise(per_node)
    return F.concat(k.column(), per_node, m.column())


# --- speed, accessibility, conversions --------------------------------------------------------------


def speed() -> Column:
    k = Checks("speed")
    kb = c("html_bytes") / 1024
    k.either("html-size", F.when(kb > 600, 12).otherwise(7), kb > 300, n=F.round(kb))
    slow = F.coalesce(c("elapsed_ms") > 800, F.lit(False))
    k.either("ttfb", F.when(c("elapsed_ms") > 1800, 15).otherwise(9), slow, n=c("elapsed_ms"))
    k.either("compression", 9, ~header("content-encoding").rlike("(?i)br|gzip|deflate"))
    k.either("cache", 6, header("cache-control") == "")
    k.either("render-blocking-js", F.when(c("n_blocking") > 2, 11).otherwise(7), c("n_blocking") > 0, n=c("n_blocking"))
    k.issue("css-count", 6, c("n_stylesheets") > 4, n=c("n_stylesheets"))
    share = c("n_img_no_size") / F.greatest("n_imgs", F.lit(1))
    k.issue("cls-images", F.when(share > 0.5, 10).otherwise(6), c("n_img_no_size") > 0, n=c("n_img_no_size"))
    k.ok("cls-images", (c("n_imgs") > 0) & (c("n_img_no_size") == 0))
    k.issue("lazy-loading", 5, (c("n_imgs") > 6) & (c("n_img_lazy") == 0), n=c("n_imgs"))
    return k.column()


def a11y() -> Column:
    k = Checks("a11y")
    k.either("lang", 8, _blank("html_lang"))
    k.issue("labels", F.when(c("n_unlabelled") > 2, 12).otherwise(8), c("n_unlabelled") > 0, n=c("n_unlabelled"))
    k.ok("labels", (c("n_inputs") > 0) & (c("n_unlabelled") == 0))
    k.issue("button-names", 9, c("n_unnamed_buttons") > 0, n=c("n_unnamed_buttons"))
    has = [
        (c("n_main") > 0) | c("role_main"), (c("n_nav") > 0) | c("role_navigation"), (c("n_footer") > 0) | c("role_contentinfo"),
    ]
    absent = F.lit(0)
    for h in has:
        absent = absent + (~h).cast("int")
    k.either("landmarks", 7, absent > 0, n=absent)
    k.issue("decorative-alt", 4, c("n_img_decorative_alt") > 0, n=c("n_img_decorative_alt"))
    k.issue("zoom-disabled", 8, c("meta_viewport").rlike(r"user-scalable=no|maximum-scale=1(\.0)?\b"))
    return k.column()


def conversions() -> Column:
    k = Checks("conversions")
    k.either("above-fold", 12, ~c("cta_early"))
    k.issue("cta-clarity", 8, c("n_generic_ctas") > 0, n=c("n_generic_ctas"))
    k.ok("cta-clarity", (c("n_generic_ctas") == 0) & (c("n_ctas") > 0))
    k.issue("form-length", 9, c("n_form_fields") > 6, n=c("n_form_fields"))
    k.ok("form-length", (c("n_forms") > 0) & (c("n_form_fields") <= 6))
    k.either("trust", 7, ~c("has_trust"))
    k.either("mobile-viewport", 11, _blank("meta_viewport"))
    k.issue("contact-path", 5, ~c("has_contact"))
    return k.column()


# --- answer engines, generative engines ---------------------------------------------------------------


def _typed(*names: str):
    return lambda n: F.arrays_overlap(node_types(n), F.array(*[F.lit(x) for x in names]))


def _typed_nodes() -> Column:
    return F.filter("ld_nodes", lambda n: F.coalesce(node_prop(n, "@type"), F.lit("")) != "")


def aeo() -> Column:
    k = Checks("aeo")
    nodes = _typed_nodes()
    answer = F.exists(nodes, _typed("FAQPage", "QAPage", "HowTo"))
    asks = c("n_questions") > 0
    k.ok("aeo-answer-schema", answer)
    k.issue("aeo-answer-schema-missing", 7, ~answer & asks, n=c("n_questions"))
    k.issue("aeo-no-qa-content", 4, ~answer & ~asks)
    k.issue("aeo-question-headings", 5, (c("n_h23_text") >= 3) & ~asks)
    k.ok("aeo-question-headings", (c("n_h23_text") >= 3) & asks, n=c("n_questions"))
    k.issue("aeo-intro-paragraph", 6, _blank("intro"))
    k.issue("aeo-intro-paragraph-thin", 4, F.length("intro").between(1, 19), n=F.length("intro"))
    k.ok("aeo-intro-paragraph", F.length("intro") >= 20)
    long = c("n_words") > 300
    k.issue("aeo-scannable-structure", 5, long & (c("n_lists") == 0), n=c("n_words"))
    k.ok("aeo-scannable-structure", c("n_lists") > 0)
    needs_toc = (c("n_words") > 1200) & (c("n_h23") >= 4)
    has_toc = (c("n_h23_ids") > 0) & (c("n_hash_links") > 0)
    k.issue("aeo-toc-missing", 3, needs_toc & ~has_toc, n=c("n_words"))
    k.ok("aeo-toc", needs_toc & has_toc)
    prop_set = lambda n, p: F.coalesce(node_prop(n, p), F.lit("")) != ""
    speakable = F.exists(nodes, lambda n: prop_set(n, "speakable"))
    k.issue("aeo-speakable-missing", 2, answer & ~speakable)
    k.ok("aeo-speakable", speakable)

    def names_author(n: Column) -> Column:
        a = F.coalesce(node_prop(n, "author"), F.lit(""))
        nested = F.exists(parse_nodes(a), lambda x: F.coalesce(node_prop(x, "name"), F.lit("")) != "")
        return F.when(a.rlike(r"^[\[{]"), nested).otherwise(trim_ws(a) != "")

    author = ~_blank("meta_author") | ~_blank("article_author") | F.exists(nodes, names_author) | c("has_byline")
    k.either("aeo-author-missing", 5, ~author, pass_id="aeo-author")
    dated = ~_blank("meta_modified") | c("has_time") | F.exists(nodes, lambda n: prop_set(n, "dateModified") | prop_set(n, "datePublished"))
    k.either("aeo-freshness-missing", 6, ~dated, pass_id="aeo-freshness")
    k.either("aeo-semantic-container", 6, ~((c("n_main") > 0) | (c("n_article") > 0) | c("role_main")))
    k.issue("aeo-citations", 3, long & (c("n_outbound") == 0))
    k.ok("aeo-citations", c("n_outbound") > 0, n=c("n_outbound"))
    return k.column()


def geo() -> Column:
    k = Checks("geo")
    words = c("n_words")
    # The rendered text is split on single blanks, as it is delivered.
    rendered = F.when(c("rendered_text") == "", F.lit(0)).otherwise(F.size(F.split("rendered_text", " ")))
    measured = c("rendered_text").isNotNull()
    gained = (rendered >= 40) & (rendered > words * 2) & (rendered - words >= 30)
    guessed = (words < 40) & ((c("n_ext_scripts") >= 3) | c("app_shell"))
    hidden = F.when(measured, gained).otherwise(guessed)
    k.either("geo-js-rendered-content", 10, hidden, n=words)
    k.issue("geo-statistics-density", 5, (words >= 150) & (c("n_statistics") == 0), n=words)
    k.ok("geo-statistics-density", (words >= 150) & (c("n_statistics") > 0), n=c("n_statistics"))
    k.issue("geo-attributed-quotes-missing", 3, (words >= 200) & (c("n_attributed") == 0))
    k.ok("geo-attributed-quotes", (words >= 200) & (c("n_attributed") > 0), n=c("n_attributed"))
    entity = F.get(F.filter(_typed_nodes(), _typed("Organization", "Person", "LocalBusiness", "Corporation")), F.lit(0))
    profiles = strings_of(node_prop(entity, "sameAs"))
    grounded = F.exists(
        profiles, lambda u: F.lower(u).rlike(r"wikipedia\.org|wikidata\.org|crunchbase\.com|linkedin\.com|github\.com"))
    k.issue("geo-entity-grounding-missing", 6, entity.isNotNull() & ~grounded)
    k.ok("geo-entity-grounding", entity.isNotNull() & grounded)
    k.issue("geo-table-headers", 4, c("n_tables_unheaded") > 0, n=c("n_tables_unheaded"))
    k.ok("geo-table-headers", (c("n_tables") > 0) & (c("n_tables_unheaded") == 0))
    k.either("geo-noai-directive", 6, c("meta_robots").rlike("(?i)noai|noimageai"))
    enough = (words >= 150) & (c("n_sentences") >= 5)
    k.issue("geo-sentence-length", 3, enough & (c("sentence_mean") > 32), n=F.round("sentence_mean"))
    k.ok("geo-sentence-length", enough & (c("sentence_mean") <= 32), n=F.round("sentence_mean"))
    k.issue("geo-content-chunking", 3, (c("n_h23") >= 2) & (c("max_section_words") > 600), n=c("max_section_words"))
    k.ok("geo-content-chunking", (c("n_h23") >= 2) & (c("max_section_words") <= 600))
    return k.column()


# --- security headers ------------------------------------------------------------------------------------


def security_all() -> Column:
    """Every security finding of a page in rule order, before the twelve worst are kept."""
    k = Checks("security")
    for name, weight in SECURITY_HEADERS.items():
        value = header(name)
        k.issue("missing-" + name, weight, value == "")
        k.ok("present-" + name, value != "", info=value)
        if name == "strict-transport-security":
            k.issue("hsts-no-max-age", 5, (value != "") & ~value.contains("max-age"))
        if name == "content-security-policy":
            k.issue("csp-unsafe-inline", 8, value.contains("'unsafe-inline'"))
            k.issue("csp-wildcard", 6, value.contains("*"))
    k.issue("no-https", 15, ~c("url").startswith("https://"))
    k.issue("x-powered-by-exposed", 3, header("x-powered-by") != "", info=header("x-powered-by"))
    k.issue("server-header-exposed", 3, F.length(header("server")) > 20, info=header("server"))
    return k.column()


def top_findings(findings: Column, n_issues: int = 12, n_passed: int = 8) -> Column:
    """``topk_security``: the heaviest issues (ties keep rule order) and the first passes.

    A page has at most 21 of these, so the ranking stays inside its row.
    """
    issues = F.filter(findings, lambda f: ~f["passed"])
    ranked = F.array_sort(F.transform(issues, lambda f, i: F.struct((-f["weight"]).alias("w"), i.alias("i"), f.alias("f"))))
    passed = F.filter(findings, lambda f: f["passed"])
    return F.concat(
        F.transform(F.slice(ranked, 1, n_issues), lambda x: x["f"]), F.slice(passed, 1, n_passed)
    )


def security() -> Column:
    return top_findings(security_all())


def web_protocol() -> Column:
    """The extra transport check of the stand-alone security tool."""
    k = Checks("security")
    secure = c("url").startswith("https://")
    return k.issue("not-https", 12, ~secure).ok("is-https", secure).column()


FAMILIES = {
    "seo": seo, "structured_data": structured, "speed": speed, "a11y": a11y, "conversions": conversions,
    "aeo": aeo, "geo": geo, "security_headers": security,
}
PAGE_CATEGORIES = ("seo", "aeo", "geo", "speed", "a11y", "conversions")


def _one_input(pages: DataFrame) -> DataFrame:
    """What the rules read of ``pages``, fenced: a projection on a union is planned, compiled and warmed up once a branch, and this is a long one."""
    return fence(with_optional(pages).select(*PASS_THROUGH, "html"))


def audit(pages: DataFrame, family: str) -> DataFrame:
    """Findings of one family, one row each."""
    f = page_features(_one_input(pages))
    return explode_findings(f, ["page_id", "url"], FAMILIES[family]())


def page_audit(pages: DataFrame) -> DataFrame:
    """One row per page with every page-level finding of the six report categories."""
    f = page_features(_one_input(pages))
    found = F.concat(seo(), structured(), speed(), a11y(), conversions(), aeo(), geo())
    return f.select("page_id", "url", "site", F.coalesce("depth", F.lit(0)).alias("depth"), "parent_url", found.alias("findings"))


def findings_of(audited: DataFrame) -> DataFrame:
    """The findings of :func:`page_audit`, one row each."""
    return explode_findings(audited, ["page_id", "url", "site", "depth"], c("findings"))


def all_findings(pages: DataFrame) -> DataFrame:
    return findings_of(page_audit(pages))
