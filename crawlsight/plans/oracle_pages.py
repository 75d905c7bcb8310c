"""DuckDB twins of the page operators.

They share nothing with the Spark side but the given tables: features come from plain regular
expressions over the HTML, structured data from the columns the catalogue pages were made of.
"""

from __future__ import annotations

from crawlsight.operators.page_rules import SECURITY_HEADERS
from crawlsight.sources.given import CATALOG_HEADERS, CATALOG_PAGES

HEADER_COLUMNS = ", ".join(f"{sql} AS h_{k.lower().replace('-', '_')}" for k, sql in CATALOG_HEADERS.items())
NULL_HEADERS = ", ".join(f"NULL AS h_{k.lower().replace('-', '_')}" for k in CATALOG_HEADERS)

SITE = r"lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"

# Every audited page: the given ones and the catalogue.
AUDIT_PAGES = f"""
cat AS ({CATALOG_PAGES}),
ap AS (
  SELECT page_id, {SITE} AS site, url, html, NULL::BIGINT AS elapsed_ms, 0 AS depth, NULL AS parent_url,
         NULL AS p_type, NULL AS p_size, {NULL_HEADERS} FROM pages
  UNION ALL
  SELECT page_id, site, url, html, elapsed_ms, depth, parent_url, p_type, p_size, {HEADER_COLUMNS} FROM cat
)"""

SKEL = r"regexp_replace(html, '(?is)<!--.*?-->|(<script[^>]*>).*?</script>|(<style[^>]*>).*?</style>', '\1\2', 'g')"
NC = r"regexp_replace(html, '(?is)(<script[^>]*>.*?</script>)|<!--.*?-->', '\1', 'g')"


def decode(x: str) -> str:
    for name, ch in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{ch}')"
    return x


def strip(x: str) -> str:
    return decode(rf"regexp_replace({x}, '(?i)<[a-z/!][^>]*>', '', 'g')")


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words(x: str) -> str:
    """Words of collapsed text."""
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


def attr(tag: str, name: str) -> str:
    return decode(rf"""regexp_extract({tag}, '(?i)\s{name}="([^"]*)"', 1)""")


def tags(names: str, html: str = "skel") -> str:
    return rf"regexp_extract_all({html}, '(?i)<(?:{names})(?:\s[^>]*)?>')"


def n_tags(names: str, html: str = "skel") -> str:
    return f"len({tags(names, html)})"


def meta(name: str, key: str = "name") -> str:
    return decode(rf"""regexp_extract(skel, '(?i)<meta {key}="{name}" content="([^"]*)"', 1)""")


ANCHORS = r"regexp_extract_all(skel, '(?is)<a(?:\s[^>]*)?>.*?</a>')"
BUTTONS = r"regexp_extract_all(skel, '(?is)<button(?:\s[^>]*)?>.*?</button>')"
HEADS = r"regexp_extract_all(skel, '(?is)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>')"
H23 = r"regexp_extract_all(skel, '(?is)<h[23](?:\s[^>]*)?>.*?</h[23]>')"


def text_list(lst: str) -> str:
    return f"list_transform({lst}, lambda e: trim({strip('e')}))"


FEATURES = rf"""
WITH {AUDIT_PAGES},
s0 AS (SELECT *, {SKEL} AS skel, {NC} AS nc FROM ap),
s1 AS (SELECT *, regexp_replace(skel, '(?is)^.*?<body[^>]*>', '') AS body,
  {collapse(strip("regexp_replace(nc, '(?is)^.*?<body[^>]*>', '')"))} AS body_text,
  {tags('img')} AS imgs, {tags('input')} AS inputs, {H23} AS h23, {tags('link')} AS links,
  list_concat({ANCHORS}, {BUTTONS}) AS ctas FROM s0),
f AS (SELECT *,
  trim({decode("regexp_extract(nc, '(?is)<title>(.*?)</title>', 1)")}) AS title,
  {meta('description')} AS meta_desc, {meta('robots')} AS meta_robots, {meta('viewport')} AS meta_viewport,
  {', '.join(f"{meta('og:' + k, 'property')} AS og_{k}" for k in ('title', 'description', 'image', 'url', 'type', 'site_name'))},
  {', '.join(f"{meta('twitter:' + k)} AS tw_{k}" for k in ('card', 'title', 'description', 'image'))},
  regexp_matches(skel, '<meta charset=') AS has_charset,
  {decode('''regexp_extract(skel, '<link rel="canonical" href="([^"]*)"', 1)''')} AS canonical,
  regexp_extract(url, '^(https?://[^/?#]+)', 1) AS page_origin,
  list_filter(links, lambda k: k LIKE '%hreflang=%') AS alts,
  regexp_matches(skel, '<link rel="icon"') AS has_favicon,
  regexp_matches(skel, '<link rel="manifest"') AS has_manifest,
  len(list_filter(links, lambda k: k LIKE '%rel="stylesheet"%')) AS n_css,
  {attr("regexp_extract(skel, '(?i)<html[^>]*>')", 'lang')} AS html_lang,
  {n_tags('h1')} AS n_h1,
  list_transform({HEADS}, lambda e: CAST(substr(e, 3, 1) AS INT)) AS levels,
  {words('body_text')} AS n_words,
  octet_length(encode(html)) AS html_bytes,
  len(imgs) AS n_imgs,
  len(list_filter(imgs, lambda t: trim({attr('t', 'alt')}) = '')) AS n_no_alt,
  len(list_filter(imgs, lambda t: {attr('t', 'width')} = '' OR {attr('t', 'height')} = '')) AS n_no_size,
  len(list_filter(imgs, lambda t: {attr('t', 'loading')} = 'lazy')) AS n_lazy,
  len(list_filter(imgs, lambda t: regexp_matches({attr('t', 'src')}, 'spacer|divider|decoration') AND trim({attr('t', 'alt')}) <> '')) AS n_deco,
  {n_tags('main')} AS n_main, {n_tags('nav')} AS n_nav, {n_tags('footer')} AS n_footer, {n_tags('article')} AS n_article,
  len(list_filter({tags('script', "regexp_extract(skel, '(?is)^(.*?)<body', 1)")},
      lambda t: NOT regexp_matches(t, '(?i)\s(async|defer)') AND NOT regexp_matches(t, 'type="module"'))) AS n_blocking,
  len(list_filter(inputs, lambda t: NOT regexp_matches(t, 'type="(hidden|submit|button)"'))) AS n_inputs,
  len(list_filter({tags('input', "regexp_replace(skel, '(?is)<label[^>]*>.*?</label>', '', 'g')")},
      lambda t: NOT regexp_matches(t, 'type="(hidden|submit|button)"') AND {attr('t', 'aria-label')} = ''
        AND NOT ({attr('t', 'id')} <> '' AND contains(skel, '<label for="' || {attr('t', 'id')} || '"')))) AS n_unlabelled,
  len(list_filter(ctas, lambda e: trim({strip('e')}) = '' AND NOT regexp_matches(e, '^<[^>]*\s(aria-label|title)="[^"]')
      AND (e LIKE '<button%' OR regexp_matches(e, '^<a[^>]*role="button"')))) AS n_unnamed,
  list_filter(list_transform(ctas, lambda e: lower(trim({strip('e')}))), lambda t: t <> '') AS cta_texts,
  len(regexp_extract_all(regexp_extract(skel, '(?is)<form.*?</form>'), '(?i)<(?:input|select|textarea)(?:\s[^>]*)?>'))
    - len(regexp_extract_all(regexp_extract(skel, '(?is)<form.*?</form>'), 'type="(?:hidden|submit|button)"')) AS n_fields,
  {n_tags('form')} AS n_forms,
  len(list_filter(regexp_extract_all(lower(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''))[1:4000],
      '<(?:a[^>]*>.*?</a|button[^>]*>.*?</button)>'),
      lambda e: length(trim(regexp_replace(regexp_replace(e, '^<[^>]*>', ''), '<[^>]+>', '', 'g'))) BETWEEN 2 AND 39)) > 0 AS cta_early,
  regexp_matches(lower(html), 'testimonial|review|trusted by|as seen in|guarantee|rated|customers|star') AS has_trust,
  regexp_matches(lower(html), 'tel:|mailto:|contact') AS has_contact,
  list_filter(list_transform(h23, lambda e: trim({strip('e')})), lambda t: t <> '') AS h23_texts,
  trim({strip('''regexp_extract(body, '(?is)<p(?: [^>]*)?>(.*?)(?:</?p>|</article>|</main>|</div>|<ul|<h[1-6])', 1)''')}) AS intro,
  {n_tags('li')} + {n_tags('table')} AS n_lists,
  len(list_filter({ANCHORS}, lambda e: regexp_matches(e, '^<a[^>]*href="https?://')
      AND regexp_extract(e, 'href="(https?://[^/?#"]+)', 1) <> regexp_extract(url, '^(https?://[^/?#]+)', 1))) AS n_outbound,
  regexp_matches(skel, 'rel="author"') AS has_byline, regexp_matches(skel, '<time datetime=') AS has_time,
  len(list_filter(h23, lambda e: regexp_matches(e, '^<h[23] [^>]*id="'))) AS n_ids,
  len(list_filter({ANCHORS}, lambda e: regexp_matches(e, '^<a[^>]*href="#'))) AS n_hash,
  len(regexp_extract_all(body_text, '(?i)\b\d+(?:\.\d+)?\s?%|\$\s?\d[\d,.]*|\b\d+(?:\.\d+)?\s?(?:percent|million|billion|thousand|times)\b')) AS n_stats,
  len(list_filter(regexp_extract_all(body_text, '["“][^"”]{{15,200}}["”]'), lambda q: regexp_matches(
     substr(body_text, greatest(instr(body_text, q) - 60, 1), length(q) + 60 + least(instr(body_text, q) - 1, 60)),
     '(?i)\b(said|says|according to|explains?|explained|noted|notes|argues?|argued|writes|wrote|states?|stated|told)\b'))) AS n_quotes,
  list_filter(list_transform(regexp_extract_all(body_text, '[^.!?]+[.!?]+'), lambda x: {words('trim(x)')}), lambda n: n >= 4) AS sentences,
  len(regexp_extract_all(skel, '(?is)<table.*?</table>')) AS n_tables,
  len(list_filter(regexp_extract_all(skel, '(?is)<table.*?</table>'), lambda t: NOT contains(t, '<th>'))) AS n_unheaded,
  len(regexp_extract_all(skel, '<[a-z]+ [^>]*itemscope')) AS n_scope,
  len(list_filter(regexp_extract_all(skel, '<[a-z]+ [^>]*itemscope[^>]*>'), lambda t: NOT contains(t, 'itemtype='))) AS n_scope_untyped,
  len(list_filter(regexp_extract_all(skel, '<[a-z]+ [^>]*itemscope[^>]*>'), lambda t: contains(t, 'itemtype=') AND NOT contains(t, 'schema.org'))) AS n_scope_foreign,
  contains(skel, ' typeof=') AS has_typeof, contains(skel, ' vocab=') AS has_vocab,
  coalesce(p_type, '') AS ty, coalesce(p_size, 0) AS sz
  FROM s1)
"""

SEVERITY = (
    "CASE WHEN passed THEN 'good' WHEN weight >= 14 THEN 'critical' WHEN weight >= 9 THEN 'high' "
    "WHEN weight >= 5 THEN 'medium' WHEN weight >= 2 THEN 'low' ELSE 'informational' END"
)

ALT_CODE = r"""lower(trim(regexp_extract(k, 'hreflang="([^"]*)"', 1)))"""
ALT_BAD = rf"len(list_filter(alts, lambda k: {ALT_CODE} <> 'x-default' AND NOT regexp_matches({ALT_CODE}, '^[a-z]{{2,3}}(-[a-z]{{2}}|-\d{{3}})?$'))) > 0"
ALT_SELF = """len(list_filter(alts, lambda k: regexp_extract(k, 'href="([^"]*)"', 1) = url)) > 0"""
SAME_ORIGIN = "regexp_extract(canonical, '^(https?://[^/?#]+)', 1) = page_origin"
ABS = "regexp_matches(canonical, '^https?://')"
GAP = (
    "((tw_title = '' AND og_title = '') OR (tw_description = '' AND og_description = '') OR (tw_image = '' AND og_image = ''))"
)
PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '(\?[^#]*)', 1)"
SKIP = "len(list_filter(range(2, len(levels) + 1), lambda i: levels[i] - levels[i - 1] > 1)) > 0"
GENERIC = "len(list_filter(cta_texts, lambda t: t IN ('submit', 'click here', 'here', 'go', 'learn more', 'read more')))"
ASKS = (
    "len(list_filter(h23_texts, lambda t: suffix(t, '?') OR regexp_matches(t, "
    "'(?i)^(what|why|how|when|where|who|which|can|does|do|is|are|will|should)\\b'))) > 0"
)
DESC = "trim(meta_desc)"


def _pair(rule: str, weight, bad: str, good: str | None = None) -> list[tuple]:
    return [(rule, False, weight, bad), (good or rule, True, 0, f"NOT ({bad})")]


RULES: dict[str, list[tuple]] = {
    "seo": [
        ("title", False, 14, "title = ''"),
        ("title-length", False, 6, "title <> '' AND length(title) NOT BETWEEN 10 AND 65"),
        ("title", True, 0, "length(title) BETWEEN 10 AND 65"),
        ("meta-desc", False, 9, f"{DESC} = ''"),
        ("meta-desc-length", False, 5, f"{DESC} <> '' AND length(meta_desc) NOT BETWEEN 50 AND 165"),
        ("meta-desc", True, 0, f"{DESC} <> '' AND length(meta_desc) BETWEEN 50 AND 165"),
        ("meta-desc-duplicates-title", False, 3, f"{DESC} <> '' AND lower({DESC}) = lower(title)"),
        ("canonical", False, 8, "canonical = ''"),
        ("canonical-relative", False, 3, f"canonical <> '' AND NOT {ABS}"),
        ("canonical-cross-domain", False, 4, f"{ABS} AND NOT {SAME_ORIGIN}"),
        ("canonical", True, 0, f"{ABS} AND {SAME_ORIGIN}"),
        ("h1-missing", False, 10, "n_h1 = 0"), ("h1-multiple", False, 6, "n_h1 > 1"), ("h1", True, 0, "n_h1 = 1"),
        ("heading-order", False, 6, SKIP), ("heading-order", True, 0, f"NOT ({SKIP}) AND len(levels) > 1"),
        ("alt-text", False, "CASE WHEN n_no_alt / n_imgs > 0.5 THEN 10 ELSE 6 END", "n_no_alt > 0"),
        ("alt-text", True, 0, "n_imgs > 0 AND n_no_alt = 0"),
        ("noindex", False, 15, "lower(meta_robots) LIKE '%noindex%'"),
        ("hreflang-invalid", False, 5, f"len(alts) > 0 AND {ALT_BAD}"),
        ("hreflang-valid", True, 0, f"len(alts) > 0 AND NOT ({ALT_BAD})"),
        ("hreflang-no-x-default", False, 3, "len(alts) > 1 AND NOT contains(skel, 'hreflang=\"x-default\"')"),
        ("hreflang-no-self-reference", False, 4, f"len(alts) > 0 AND NOT ({ALT_SELF})"),
        *_pair("meta-charset", 3, "NOT has_charset"), *_pair("favicon", 3, "NOT has_favicon"),
        ("thin-content", False, 6, "n_words BETWEEN 1 AND 299"), ("thin-content", True, 0, "n_words >= 300"),
        *_pair("url-structure", 2, f"regexp_matches({PATH}, '[A-Z_]') OR length({QUERY}) > 30"),
        *_pair("og-basic", 5, "og_title = '' OR og_description = ''"),
        *_pair("og-image", 8, "og_image = ''"), *_pair("og-url", 3, "og_url = ''"),
        *_pair("og-type", 2, "og_type = ''"), *_pair("og-site-name", 2, "og_site_name = ''"),
        ("twitter-card", False, 4, "tw_card = ''"),
        ("twitter-card-invalid", False, 4, "tw_card <> '' AND tw_card NOT IN ('summary', 'summary_large_image', 'app', 'player')"),
        ("twitter-card", True, 0, "tw_card IN ('summary', 'summary_large_image', 'app', 'player')"),
        ("twitter-content", False, 3, f"tw_card <> '' AND {GAP}"), ("twitter-content", True, 0, f"tw_card <> '' AND NOT {GAP}"),
    ],
    "structured_data": [
        ("jsonld-missing", False, 8, "ty IN ('', 'ECONOMY')"), ("jsonld-present", True, 0, "ty NOT IN ('', 'ECONOMY')"),
        ("jsonld-empty", False, 3, "ty = 'LARGE' AND sz % 5 = 0"), ("jsonld-parse-error", False, 10, "ty = 'LARGE' AND sz % 5 = 1"),
        ("schema-missing-context", False, 6, "ty IN ('LARGE', 'PROMO')"), ("schema-invalid-type", False, 7, "ty = 'MEDIUM'"),
        ("schema-product", True, 0, "ty = 'STANDARD'"),
        ("schema-product-offers", False, 6, "ty = 'STANDARD' AND sz % 3 <> 0"),
        ("schema-product-image", False, 3, "ty = 'STANDARD' AND sz % 2 <> 0"),
        ("schema-org-required", False, 5, "ty = 'PROMO' AND sz % 2 <> 0"), ("schema-org", True, 0, "ty = 'PROMO' AND sz % 2 = 0"),
        ("schema-org-logo", False, 3, "ty = 'PROMO' AND sz % 4 = 2"), ("schema-website", True, 0, "ty = 'PROMO'"),
        ("schema-searchaction", True, 0, "ty = 'PROMO' AND sz % 3 = 0"),
        ("schema-searchaction-invalid", False, 5, "ty = 'PROMO' AND sz % 3 = 1"),
        ("schema-searchaction-missing", False, 4, "ty = 'PROMO' AND sz % 3 = 2"),
        ("schema-faq-invalid", False, 5, "ty = 'SMALL' AND sz % 3 = 0"), ("schema-faq", True, 0, "ty = 'SMALL' AND sz % 3 <> 0"),
        ("schema-breadcrumb", True, 0, "ty = 'SMALL' AND sz % 2 = 0"), ("schema-breadcrumb-invalid", False, 8, "ty = 'SMALL' AND sz % 2 <> 0"),
        ("schema-article-required-NewsArticle", False, "CASE WHEN sz % 2 <> 0 AND sz % 3 <> 0 THEN 9 ELSE 6 END", "ty = 'LARGE' AND (sz % 2 <> 0 OR sz % 3 <> 0)"),
        ("schema-article-NewsArticle", True, 0, "ty = 'LARGE' AND sz % 6 = 0"),
        ("schema-localbusiness", True, 0, "ty = 'MEDIUM' AND sz % 2 = 0"), ("schema-localbusiness-required", False, 7, "ty = 'MEDIUM' AND sz % 2 <> 0"),
        ("schema-localbusiness-phone", False, 3, "ty = 'MEDIUM' AND sz % 3 <> 0"),
        ("microdata-missing-itemtype", False, 5, "n_scope_untyped > 0"), ("microdata-invalid-itemtype", False, 4, "n_scope_foreign > 0"),
        ("microdata", True, 0, "n_scope > 0 AND n_scope_untyped = 0 AND n_scope_foreign = 0"),
        ("rdfa-missing-vocab", False, 4, "has_typeof AND NOT has_vocab"), ("rdfa", True, 0, "has_typeof AND has_vocab"),
        ("structured-data-none", False, 8, "ty IN ('', 'ECONOMY') AND n_scope = 0 AND NOT has_typeof"),
    ],
    "speed": [
        *_pair("html-size", "CASE WHEN html_bytes > 614400 THEN 12 ELSE 7 END", "html_bytes > 307200"),
        *_pair("ttfb", "CASE WHEN elapsed_ms > 1800 THEN 15 ELSE 9 END", "coalesce(elapsed_ms, 0) > 800"),
        *_pair("compression", 9, "h_content_encoding IS NULL"), *_pair("cache", 6, "h_cache_control IS NULL"),
        *_pair("render-blocking-js", "CASE WHEN n_blocking > 2 THEN 11 ELSE 7 END", "n_blocking > 0"),
        ("css-count", False, 6, "n_css > 4"),
        ("cls-images", False, "CASE WHEN n_no_size / n_imgs > 0.5 THEN 10 ELSE 6 END", "n_no_size > 0"),
        ("cls-images", True, 0, "n_imgs > 0 AND n_no_size = 0"), ("lazy-loading", False, 5, "n_imgs > 6 AND n_lazy = 0"),
    ],
    "a11y": [
        *_pair("lang", 8, "html_lang = ''"),
        ("labels", False, "CASE WHEN n_unlabelled > 2 THEN 12 ELSE 8 END", "n_unlabelled > 0"),
        ("labels", True, 0, "n_inputs > 0 AND n_unlabelled = 0"), ("button-names", False, 9, "n_unnamed > 0"),
        *_pair("landmarks", 7, "n_main = 0 OR n_nav = 0 OR n_footer = 0"), ("decorative-alt", False, 4, "n_deco > 0"),
        ("zoom-disabled", False, 8, r"regexp_matches(meta_viewport, 'user-scalable=no|maximum-scale=1(\.0)?\b')"),
    ],
    "conversions": [
        *_pair("above-fold", 12, "NOT cta_early"), ("cta-clarity", False, 8, f"{GENERIC} > 0"),
        ("cta-clarity", True, 0, f"{GENERIC} = 0 AND len(cta_texts) > 0"),
        ("form-length", False, 9, "n_fields > 6"), ("form-length", True, 0, "n_forms > 0 AND n_fields <= 6"),
        *_pair("trust", 7, "NOT has_trust"), *_pair("mobile-viewport", 11, "meta_viewport = ''"), ("contact-path", False, 5, "NOT has_contact"),
    ],
    "aeo": [
        ("aeo-answer-schema", True, 0, "ty = 'SMALL'"), ("aeo-answer-schema-missing", False, 7, f"ty <> 'SMALL' AND {ASKS}"),
        ("aeo-no-qa-content", False, 4, f"ty <> 'SMALL' AND NOT ({ASKS})"),
        ("aeo-question-headings", False, 5, f"len(h23_texts) >= 3 AND NOT ({ASKS})"), ("aeo-question-headings", True, 0, f"len(h23_texts) >= 3 AND {ASKS}"),
        ("aeo-intro-paragraph", False, 6, "intro = ''"), ("aeo-intro-paragraph-thin", False, 4, "length(intro) BETWEEN 1 AND 19"),
        ("aeo-intro-paragraph", True, 0, "length(intro) >= 20"),
        ("aeo-scannable-structure", False, 5, "n_words > 300 AND n_lists = 0"), ("aeo-scannable-structure", True, 0, "n_lists > 0"),
        ("aeo-toc-missing", False, 3, "n_words > 1200 AND len(h23) >= 4 AND (n_ids = 0 OR n_hash = 0)"),
        ("aeo-toc", True, 0, "n_words > 1200 AND len(h23) >= 4 AND n_ids > 0 AND n_hash > 0"),
        ("aeo-speakable", True, 0, "ty = 'SMALL' AND sz % 4 = 0"), ("aeo-speakable-missing", False, 2, "ty = 'SMALL' AND sz % 4 <> 0"),
        *_pair("aeo-author-missing", 5, "NOT has_byline AND NOT (ty = 'LARGE' AND sz % 2 = 0)", "aeo-author"),
        *_pair("aeo-freshness-missing", 6, "NOT has_time AND NOT (ty = 'LARGE' AND sz % 3 = 0)", "aeo-freshness"),
        *_pair("aeo-semantic-container", 6, "n_main = 0 AND n_article = 0"),
        ("aeo-citations", False, 3, "n_words > 300 AND n_outbound = 0"), ("aeo-citations", True, 0, "n_outbound > 0"),
    ],
    "geo": [
        ("geo-js-rendered-content", False, 10, "n_words < 40 AND regexp_matches(lower(html), '__next_data__|__nuxt|id=\"root\"|id=\"app\"|ng-version|data-reactroot')"),
        ("geo-js-rendered-content", True, 0, "NOT (n_words < 40 AND regexp_matches(lower(html), '__next_data__|__nuxt|id=\"root\"|id=\"app\"|ng-version|data-reactroot'))"),
        ("geo-statistics-density", False, 5, "n_words >= 150 AND n_stats = 0"), ("geo-statistics-density", True, 0, "n_words >= 150 AND n_stats > 0"),
        ("geo-attributed-quotes-missing", False, 3, "n_words >= 200 AND n_quotes = 0"), ("geo-attributed-quotes", True, 0, "n_words >= 200 AND n_quotes > 0"),
        ("geo-entity-grounding-missing", False, 6, "ty = 'MEDIUM' OR (ty = 'PROMO' AND sz % 5 <> 0)"), ("geo-entity-grounding", True, 0, "ty = 'PROMO' AND sz % 5 = 0"),
        ("geo-table-headers", False, 4, "n_unheaded > 0"), ("geo-table-headers", True, 0, "n_tables > 0 AND n_unheaded = 0"),
        *_pair("geo-noai-directive", 6, "lower(meta_robots) LIKE '%noai%'"),
        ("geo-sentence-length", False, 3, "n_words >= 150 AND len(sentences) >= 5 AND list_avg(sentences) > 32"),
        ("geo-sentence-length", True, 0, "n_words >= 150 AND len(sentences) >= 5 AND list_avg(sentences) <= 32"),
        ("geo-content-chunking", True, 0, "len(h23) >= 2"),
    ],
}


def _branch(rule: str, passed: bool, weight, cond: str) -> str:
    return f"SELECT page_id, url, '{rule}' AS rule_id, {str(passed).lower()} AS passed, CAST({weight} AS INT) AS weight FROM f WHERE {cond}"


def findings_cte(families: dict[str, list[tuple]], name: str = "fx") -> str:
    """Branches over one materialised feature table."""
    parts = []
    for category, rules in families.items():
        for r in rules:
            parts.append(f"SELECT '{category}' AS category, * FROM ({_branch(*r)})")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def family(name: str) -> str:
    return (
        FEATURES.replace("f AS (SELECT", "f AS MATERIALIZED (SELECT", 1) + ", " + findings_cte({name: RULES[name]})
        + f" SELECT page_id, rule_id, passed, weight, {SEVERITY} AS severity FROM fx"
    )


CATEGORY_OF = {"seo": "seo", "structured_data": "seo", "speed": "speed", "a11y": "a11y", "conversions": "conversions", "aeo": "aeo", "geo": "geo"}


def all_findings(select: str) -> str:
    """A query over ``fx(category, page_id, url, rule_id, passed, weight)`` and the feature table ``f``."""
    merged: dict[str, list[tuple]] = {}
    for fam, cat in CATEGORY_OF.items():
        merged.setdefault(cat, []).extend(RULES[fam])
    return FEATURES.replace("f AS (SELECT", "f AS MATERIALIZED (SELECT", 1) + ", " + findings_cte(merged) + " " + select


def security(select_top: bool = True) -> str:
    rows = []
    for i, (h, w) in enumerate(SECURITY_HEADERS.items()):
        col = "h_" + h.replace("-", "_")
        rows.append((10 * i, f"missing-{h}", False, w, f"{col} IS NULL"))
        rows.append((10 * i, f"present-{h}", True, 0, f"{col} IS NOT NULL"))
        if h == "strict-transport-security":
            rows.append((10 * i + 1, "hsts-no-max-age", False, 5, f"{col} NOT LIKE '%max-age%'"))
        if h == "content-security-policy":
            rows.append((10 * i + 1, "csp-unsafe-inline", False, 8, f"contains({col}, '''unsafe-inline''')"))
            rows.append((10 * i + 2, "csp-wildcard", False, 6, f"contains({col}, '*')"))
    rows += [
        (100, "no-https", False, 15, "NOT url LIKE 'https://%'"), (101, "x-powered-by-exposed", False, 3, "h_x_powered_by IS NOT NULL"),
        (102, "server-header-exposed", False, 3, "length(h_server) > 20"),
    ]
    parts = " UNION ALL ".join(
        f"SELECT page_id, {no} AS rule_no, '{rule}' AS rule_id, {str(p).lower()} AS passed, CAST({w} AS INT) AS weight FROM ap WHERE {cond}"
        for no, rule, p, w, cond in rows)
    return (
        f"WITH {AUDIT_PAGES}, fx AS ({parts}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id, passed ORDER BY weight DESC, rule_no) AS rn FROM fx) "
        f"SELECT page_id, rule_id, passed, weight, {SEVERITY} AS severity FROM r WHERE rn <= CASE WHEN passed THEN 8 ELSE 12 END"
    )
