"""Extraction rows, stack, generators, source files, repairs, streams, custom rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsight.functions import markup as M
from crawlsight.functions import text as T
from crawlsight.functions import urls as U
from crawlsight.operators import custom as CU
from crawlsight.operators import dom as DOM
from crawlsight.operators import extract as X
from crawlsight.operators import fix as FX
from crawlsight.operators import generate as GE
from crawlsight.operators import page_rules as R
from crawlsight.operators import report as RP
from crawlsight.operators import score as S
from crawlsight.operators import site_files as SI
from crawlsight.operators import source_code as SC
from crawlsight.operators import stack as ST
from crawlsight.plans import oracle_dom as OD
from crawlsight.plans import oracle_pages as OP
from crawlsight.plans import oracle_report as ORP
from crawlsight.plans.catalog import register
from crawlsight.plans.oracle_links import normalize
from crawlsight.plans.registry_scores import CARD, CAT, CHANGES, PCS, SC as SCAN_CTES, _all, _audited, _findings
from crawlsight.sources import given as G
from crawlsight.sources import projects as PJ
from crawlsight.streaming import jobs as J

c = F.col
AP = f"WITH {OP.AUDIT_PAGES}"


def _pages(spark, sf):
    return G.audit_pages(spark, sf)


def _feat(spark, sf):
    return X.page_features(_pages(spark, sf))


# --- sources and extraction

register("src_pages", "SELECT page_id, url, length(html) AS n FROM pages")(lambda s, sf: G.given_pages(s, sf).select("page_id", "url", F.length("html").cast("long").alias("n")))
register("src_fetch_log", AP + " SELECT page_id, coalesce(h_server, '') AS server, coalesce(h_cache_control, '') AS cache_control, elapsed_ms FROM ap")(
    lambda s, sf: _pages(s, sf).select("page_id", R.header("server").alias("server"), R.header("cache-control").alias("cache_control"), "elapsed_ms"))
_TYPE = "CASE WHEN p_size % 14 = 9 THEN 'application/pdf' WHEN p_size % 14 = 3 THEN '' ELSE 'Text/HTML; charset=utf-8' END"
register("src_page_filter", f"WITH cat AS ({G.CATALOG_PAGES}) SELECT url, status, CASE WHEN status <> 200 THEN 'HTTP ' || status WHEN p_size % 14 = 9 THEN 'Not an HTML page' END AS reason FROM cat")(
    lambda s, sf: G.catalog_pages(s, sf).select("url", "status", X.skip_reason(c("status"), F.expr(_TYPE)).alias("reason")))
BODY_CAP = 6 << 20  # bytes of a page body that are kept
register("src_body_cap", f"SELECT page_id, strlen(html) > {BODY_CAP} AS truncated, least(strlen(html), {BODY_CAP}) AS kept FROM pages")(
    lambda s, sf: G.given_pages(s, sf).select("page_id", (F.octet_length("html") > BODY_CAP).alias("truncated"), F.octet_length(F.substring(F.encode("html", "UTF-8"), 1, BODY_CAP)).cast("long").alias("kept")))
register("ext_elements", AP + r""", t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[a-z/!](?:[^''">]|"[^"]*"|''[^'']*'')*>|[^<]+|<')) AS token FROM ap)
SELECT page_id, lower(regexp_extract(token, '(?i)^</?([a-z][a-z0-9:-]*)', 1)) AS tag, count(*) AS n, sum(length(token))::BIGINT AS n_chars FROM t GROUP BY ALL""")(
    lambda s, sf: X.tokens(_pages(s, sf)).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("n_chars")))
register("ext_head_fields", OP.FEATURES + " SELECT page_id, title, meta_desc, meta_robots, canonical, html_lang, has_charset, og_title, tw_card FROM f")(
    lambda s, sf: _feat(s, sf).select("page_id", "title", "meta_desc", "meta_robots", "canonical", "html_lang", "has_charset", "og_title", "tw_card"))
HEADINGS = AP + f""", h AS (SELECT page_id, unnest(hs) AS e, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT page_id, {OP.HEADS.replace('skel', 's')} AS hs FROM (SELECT page_id, {OP.SKEL} AS s FROM ap))),
hd AS (SELECT page_id, pos::INT AS pos, CAST(substr(e, 3, 1) AS INT) AS level, trim({OP.strip('e')}) AS text FROM h)"""
register("ext_headings", HEADINGS + " SELECT * FROM hd")(lambda s, sf: X.headings(_pages(s, sf)).select("page_id", "pos", "level", "text"))


@register("win_heading_skip", HEADINGS + " SELECT * FROM (SELECT page_id, pos, level, level - lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS jump FROM hd) WHERE jump > 1")
def win_heading_skip(spark, sf):
    h = _feat(spark, sf).select("page_id", "headings")
    jumps = F.transform("headings", lambda x, i: F.struct(i.alias("pos"), x["level"].alias("level"), (x["level"] - F.get("headings", i - 1)["level"]).alias("jump")))
    return h.select("page_id", F.inline_outer(F.filter(jumps, lambda j: j["jump"] > 1))).filter(c("pos").isNotNull())


register("win_heading_clamp", HEADINGS.replace("WITH ", "WITH RECURSIVE ", 1) + """, w(page_id, pos, cur, seq) AS (SELECT page_id, 0, level, level::VARCHAR FROM hd WHERE pos = 0
 UNION ALL SELECT hd.page_id, hd.pos, least(hd.level, w.cur + 1), w.seq || least(hd.level, w.cur + 1) FROM w JOIN hd ON hd.page_id = w.page_id AND hd.pos = w.pos + 1)
SELECT ap.page_id, coalesce(m.seq, '') AS levels FROM ap LEFT JOIN (SELECT page_id, arg_max(seq, pos) AS seq FROM w GROUP BY 1) m USING (page_id)""")(lambda s, sf: FX.clamp_levels(_pages(s, sf)))
register("ext_sections", OD.SECTIONS)(lambda s, sf: DOM.sections(_pages(s, sf)))
register("ext_jsonld", f"""WITH cat AS ({G.CATALOG_PAGES}), t AS (SELECT page_id, unnest(CASE p_type WHEN 'STANDARD' THEN ['Product'] WHEN 'PROMO' THEN ['Organization', 'WebSite'] WHEN 'SMALL' THEN ['FAQPage', 'BreadcrumbList']
 WHEN 'LARGE' THEN ['NewsArticle'] WHEN 'MEDIUM' THEN ['LocalBusiness,Shop_Front'] ELSE []::VARCHAR[] END) AS types FROM cat) SELECT * FROM t""")(
    lambda s, sf: X.jsonld_nodes(_pages(s, sf)).filter(F.size("types") > 0).select("page_id", F.array_join("types", ",").alias("types")))
register("ext_jsonld_strict", f"SELECT page_id, CASE WHEN p_type = 'ECONOMY' THEN 0 WHEN p_type = 'LARGE' AND p_size % 5 < 2 THEN 2 ELSE 1 END::BIGINT AS n_ld_blocks, (p_type = 'LARGE' AND p_size % 5 = 0)::BIGINT AS n_ld_empty, (p_type = 'LARGE' AND p_size % 5 = 1)::BIGINT AS n_ld_bad FROM ({G.CATALOG_PAGES}) UNION ALL SELECT page_id, 0, 0, 0 FROM pages")(
    lambda s, sf: _feat(s, sf).select("page_id", "n_ld_blocks", "n_ld_empty", "n_ld_bad"))
register("ext_microdata_rdfa", OP.FEATURES + " SELECT page_id, n_scope::BIGINT AS n_itemscope, n_scope_untyped::BIGINT AS n_untyped, has_typeof, has_vocab FROM f")(
    lambda s, sf: _feat(s, sf).select("page_id", "n_itemscope", c("n_itemscope_untyped").alias("n_untyped"), "has_typeof", "has_vocab"))
register("ext_form_fields", OD.FIELDS)(lambda s, sf: DOM.form_fields(_pages(s, sf)))
register("join_label_inputs", OP.FEATURES + " SELECT page_id, n_unlabelled::BIGINT AS n FROM f WHERE n_unlabelled > 0")(
    lambda s, sf: X.unlabelled_inputs(_pages(s, sf)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")))
_lacks = [("Product", "STANDARD", "''"), ("Organization", "PROMO", "CASE WHEN p_size % 2 <> 0 THEN 'url' ELSE '' END"), ("WebSite", "PROMO", "''"),
          ("NewsArticle", "LARGE", "concat_ws(',', CASE WHEN p_size % 2 <> 0 THEN 'author' END, CASE WHEN p_size % 3 <> 0 THEN 'datePublished' END)"), ("LocalBusiness", "MEDIUM", "CASE WHEN p_size % 2 <> 0 THEN 'address' ELSE '' END")]
register("set_missing_props", " UNION ALL ".join(f"SELECT page_id, '{t}' AS type, {x} AS missing FROM ({G.CATALOG_PAGES}) WHERE p_type = '{k}'" for t, k, x in _lacks))(
    lambda s, sf: R.missing_by_type(X.jsonld_nodes(_pages(s, sf))).select("page_id", "type", F.array_join("missing", ",").alias("missing")))
register("agg_sentence_stats", f"""WITH t AS (SELECT doc_id, {OP.collapse('text')} AS x FROM documents), q AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(x, '[^.!?]+[.!?]+'), lambda z: {OP.words('trim(z)')}), lambda n: n >= 4) AS ns FROM t)
SELECT doc_id, len(ns)::BIGINT AS n_sentences, round(list_avg(ns), 4) AS mean_words FROM q WHERE len(ns) > 0""")(
    lambda s, sf: G.table(s, sf, "documents").select("doc_id", F.filter(F.transform(F.regexp_extract_all(T.collapse_ws(c("text")), F.lit("[^.!?]+[.!?]+"), F.lit(0)), lambda z: T.word_count(F.trim(z))), lambda n: n >= 4).alias("ns"))
    .filter(F.size("ns") > 0).select("doc_id", F.size("ns").cast("long").alias("n_sentences"), F.round(F.aggregate("ns", F.lit(0), lambda a, x: a + x) / F.size("ns"), 4).alias("mean_words")))
_LD = "CASE p_type WHEN 'STANDARD' THEN 'Product' WHEN 'PROMO' THEN 'Organization,WebSite' WHEN 'SMALL' THEN 'FAQPage,BreadcrumbList' WHEN 'LARGE' THEN 'NewsArticle' WHEN 'MEDIUM' THEN 'LocalBusiness,Shop_Front' ELSE '' END"
register("agg_page_snapshot", OP.FEATURES + f" SELECT page_id, title, meta_desc, coalesce(list_transform(regexp_extract_all(skel, '(?is)<h1(?:\\s[^>]*)?>.*?</h1>'), lambda e: trim({OP.strip('e')}))[1], '') AS h1, array_to_string(h23_texts[1:12], ' | ') AS headings, substr(intro, 1, 500) AS intro, coalesce({_LD}, '') AS jsonld_types, coalesce(p_type = 'SMALL', false) AS has_faq, has_byline AS has_author, has_time AS has_date, n_stats > 0 AS has_statistics, n_words::BIGINT AS n_words, n_outbound::BIGINT AS n_outbound, substr(body_text, 1, 2500) AS excerpt FROM f")(
    lambda s, sf: X.page_snapshot(_pages(s, sf)))
# --- stack

PRIMARY = "CASE WHEN p_size % 6 = 4 THEN 'WordPress' WHEN p_size % 6 = 0 THEN 'PHP' WHEN p_size % 5 = 3 THEN 'Cloudflare Pages' ELSE 'Static HTML / unknown' END"
STACK = AP + f", st AS (SELECT page_id, site, depth, {PRIMARY} AS \"primary\", ((p_size % 6 = 4)::INT + (p_size % 6 = 0)::INT + (p_size % 5 = 3)::INT)::BIGINT AS n_signals FROM ap)"
register("audit_stack", STACK + " SELECT page_id, \"primary\", coalesce(n_signals, 0) AS n_signals FROM st")(lambda s, sf: ST.detect(_pages(s, sf)).select("page_id", "primary", "n_signals"))
register("agg_site_stack", STACK + " SELECT site, arg_min(\"primary\", (depth <> 0, page_id)) AS \"primary\" FROM st WHERE n_signals > 0 GROUP BY site")(lambda s, sf: ST.site_stack(ST.detect(_pages(s, sf))))

# --- generators and sinks

ESC = "replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
register("gen_sitemap", AP + f" SELECT site, ((row_number() OVER (PARTITION BY site ORDER BY url) - 1) // 50000)::INT AS file_no, url, '  <url><loc>' || {ESC} || '</loc><lastmod>2024-01-31</lastmod></url>' AS line FROM ap")(lambda s, sf: GE.sitemap_lines(_pages(s, sf), "2024-01-31"))


@register("src_sitemap_files", AP + " SELECT site, ((row_number() OVER (PARTITION BY site ORDER BY url) - 1) // 50000)::INT AS file_no, url AS loc, '2024-01-31' AS lastmod FROM ap")
def src_sitemap_files(spark, sf):
    """The sitemaps that were written, read again entry by entry."""
    out = f"{J.work_folder(spark)}/sitemaps"
    GE.write_sitemaps(GE.sitemap_lines(_pages(spark, sf), "2024-01-31"), out)
    return SI.read_sitemap_files(spark, out).select("site", "file_no", "loc", "lastmod")


register("gen_sitemap_index", AP + " SELECT site, k::INT AS file_no, '  <sitemap><loc>https://' || site || '/sitemap-' || (k + 1) || '.xml</loc><lastmod>2024-01-31</lastmod></sitemap>' AS line FROM (SELECT site, unnest(range((count(*) + 49999) // 50000)) AS k FROM ap GROUP BY site)")(
    lambda s, sf: GE.sitemap_index(GE.sitemap_lines(_pages(s, sf), "2024-01-31"), "2024-01-31"))
register("gen_llms_txt", AP + """, r AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS rn, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS p FROM ap)
SELECT site, '# ' || regexp_replace(site, '^www\\.', '') || chr(10) || chr(10) || '## Pages' || chr(10) || chr(10) || array_to_string(list('- [' || CASE WHEN p = '' THEN 'Home' ELSE substr(p, 2) END || '](' || url || ')' ORDER BY rn), chr(10)) || chr(10) AS text FROM r WHERE rn <= 25 GROUP BY site""")(
    lambda s, sf: GE.llms_txt(_pages(s, sf)))
register("gen_robots", "SELECT s_name AS site, 'User-agent: *' || chr(10) || CASE WHEN s_acctbal > 5000 THEN 'Disallow: /private' ELSE 'Disallow:' END || chr(10) || chr(10) || 'User-agent: GPTBot' || chr(10) || 'Allow: /' || chr(10) || chr(10) || 'User-agent: CCBot' || chr(10) || 'Disallow: /' || chr(10) || chr(10) || 'Sitemap: https://' || s_name || '/sitemap.xml' || chr(10) AS text FROM supplier")(
    lambda s, sf: GE.robots_txt(G.table(s, sf, "supplier").withColumn("site", c("s_name")), ["GPTBot", "CCBot"], F.array(F.lit("GPTBot")), F.when(c("s_acctbal") > 5000, F.array(F.lit("/private"))).otherwise(F.array().cast("array<string>"))))
register("gen_meta_tags", """SELECT p_partkey, length('<title>' || p_name || '</title>') AS n_title, concat_ws(';', CASE WHEN length(p_name) NOT BETWEEN 10 AND 60 THEN 'title' END, CASE WHEN length(p_type) NOT BETWEEN 50 AND 160 THEN 'description' END, CASE WHEN p_size % 2 = 0 THEN 'image' END) AS warnings FROM part""")(
    lambda s, sf: GE.meta_tags(G.table(s, sf, "part"), c("p_name"), c("p_type"), F.lit("https://x.example.com/"), F.when(c("p_size") % 2 == 0, "").otherwise("https://x.example.com/i.png"))
    .select("p_partkey", F.length(F.substring_index("head", "\n", 1)).cast("long").alias("n_title"), "warnings"))


_ctx = lambda kind, *parts: "'{\"@context\":\"https://schema.org\",\"@type\":\"" + kind + "\"' || " + " || ".join(parts) + " || '}'"
_kv = lambda key, sql: f"',\"{key}\":\"' || {sql} || '\"'"
_opt = lambda key, sql: f"CASE WHEN p_size % 2 = 0 THEN {_kv(key, sql)} ELSE '' END"
_obj = lambda key, kind, inner, sql: f"',\"{key}\":{{\"@type\":\"{kind}\",\"{inner}\":\"' || {sql} || '\"}}'"
_U = "'https://x.example.com/' || p_partkey"
_LD_KINDS = [
    ("Organization", dict(name="p_name", url=_U, logo="even"), [_kv("name", "p_name"), _kv("url", _U), _opt("logo", "p_type")]),
    ("Person", dict(name="p_name", url=_U, jobTitle="even"), [_kv("name", "p_name"), _kv("url", _U), _opt("jobTitle", "p_type")]),
    ("Article", dict(headline="p_name", author="p_brand", datePublished="even"), [_kv("headline", "p_name"), _obj("author", "Person", "name", "p_brand"), _opt("datePublished", "p_type")]),
    ("Product", dict(name="p_name", brand="p_brand", price="even"), [_kv("name", "p_name"), _obj("brand", "Brand", "name", "p_brand"), "CASE WHEN p_size % 2 = 0 THEN ',\"offers\":{\"@type\":\"Offer\",\"price\":\"' || p_type || '\",\"priceCurrency\":\"USD\"}' ELSE '' END"]),
    ("WebSite", dict(name="p_name", url=_U), [_kv("name", "p_name"), _kv("url", _U)]),
    ("WebPage", dict(name="p_name", description="even", url=_U), [_kv("name", "p_name"), _opt("description", "p_type"), _kv("url", _U)]),
    ("SoftwareApplication", dict(name="p_name", applicationCategory="p_type", operatingSystem="even"), [_kv("name", "p_name"), _kv("applicationCategory", "p_type"), _opt("operatingSystem", "p_type")]),
    ("LocalBusiness", dict(name="p_name", telephone="even", streetAddress="p_brand"), [_kv("name", "p_name"), _opt("telephone", "p_type"), _obj("address", "PostalAddress", "streetAddress", "p_brand")]),
    ("Event", dict(name="p_name", startDate="p_type", endDate="even", locationName="p_brand"), [_kv("name", "p_name"), _kv("startDate", "p_type"), _opt("endDate", "p_type"), _obj("location", "Place", "name", "p_brand")]),
    ("BreadcrumbList", dict(items="'Home|/' || chr(10) || p_name"), ["',\"itemListElement\":[{\"@type\":\"ListItem\",\"position\":1,\"name\":\"Home\",\"item\":\"/\"},{\"@type\":\"ListItem\",\"position\":2,\"name\":\"' || p_name || '\"}]'"]),
    ("FAQPage", dict(items="p_name || '?|' || p_type"), ["',\"mainEntity\":[{\"@type\":\"Question\",\"name\":\"' || p_name || '?\",\"acceptedAnswer\":{\"@type\":\"Answer\",\"text\":\"' || p_type || '\"}}]'"]),
]


@register("gen_jsonld", "SELECT p_partkey, CASE p_partkey % 11 " + " ".join(f"WHEN {i} THEN {_ctx(kind, *parts)}" for i, (kind, _, parts) in enumerate(_LD_KINDS)) + " END AS jsonld FROM part")
def gen_jsonld(spark, sf):
    """Every one of the eleven types, one after the other; a field is empty where the size is odd."""
    value = lambda x: F.when(c("p_size") % 2 == 0, c("p_type")).otherwise("") if x == "even" else F.expr(x)
    out = F.lit(None).cast("string")
    for i, (kind, fields, _) in enumerate(_LD_KINDS):
        out = F.when(c("p_partkey") % 11 == i, GE.jsonld(kind, **{k: value(v) for k, v in fields.items()})).otherwise(out)
    return G.table(spark, sf, "part").select("p_partkey", out.alias("jsonld"))


register("gen_hreflang", """SELECT p_partkey, '<link rel="alternate" hreflang="en" href="/en/' || p_partkey || '" />' || chr(10) || '<link rel="alternate" hreflang="x-default" href="/en/' || p_partkey || '" />' AS tags FROM part""")(
    lambda s, sf: G.table(s, sf, "part").select("p_partkey", GE.hreflang(F.array(F.struct(F.lit("en").alias("lang"), F.concat(F.lit("/en/"), c("p_partkey").cast("string")).alias("url")))).alias("tags")))
register("gen_slug", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\s-]', '', 'g')), '\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")(
    lambda s, sf: G.table(s, sf, "documents").select("doc_id", T.slugify(c("text")).alias("slug")))
register("gen_slug_warnings", "SELECT p_partkey, slug, concat_ws(';', CASE WHEN length(slug) > 75 THEN 'length' END, CASE WHEN len(string_split(slug, '-')) > 8 THEN 'words' END) AS warnings FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(repeat(p_name || ' ', 1 + p_size % 9))), '[^a-z0-9 -]', '', 'g'), ' +', '-', 'g') AS slug FROM part)")(
    lambda s, sf: G.table(s, sf, "part").select("p_partkey", T.slugify(F.expr("repeat(p_name || ' ', 1 + p_size % 9)")).alias("slug")).withColumn("warnings", T.slug_warnings(c("slug"))))
register("topk_keyword_search", "SELECT doc_id, score FROM (SELECT doc_id, ((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4 + (length(lower(text)) - length(replace(lower(text), 'heed', ''))) / 4)::BIGINT AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 3")(
    lambda s, sf: GE.keyword_search(G.table(s, sf, "documents"), "doc_id", "text", "tion heed of").select("doc_id", "score"))


SITE, DAY = "https://brand1.example.com/", "2024-01-31"


def _report(s, sf, kind):
    """The document as it was written."""
    audited = _audited(s, sf)
    findings = R.findings_of(audited)
    settled = findings.filter(~c("passed") & c("rule_id").contains("alt")).select("category", "rule_id").distinct()
    out = f"{J.work_folder(s)}/report"
    RP.write(RP.Report(audited, findings, settled, SITE, DAY), kind, out)
    return s.read.text(out).withColumnRenamed("value", "line")


for _kind in RP.FORMATS:
    register(f"sink_{_kind}", _all(CAT + CARD, ORP.document(_kind, SITE, DAY)))(lambda s, sf, kind=_kind: _report(s, sf, kind))

# --- source files

PF = f"WITH pf AS (SELECT *, replace(regexp_replace(path, '^\\./', ''), chr(92), '/') AS p FROM ({G.PROJECT_FILES}) WHERE p_type <> 'ECONOMY')"


def _files(s, sf):
    return SC.kept_files(G.run(s, sf, G.PROJECT_FILES))




@register("src_project_files", PF + " SELECT project, regexp_replace(p, '(^|/)(\\.\\.?(/|$))+', '\\1', 'g') AS path, strlen(content) AS n FROM pf")
def src_project_files(spark, sf):
    """The projects as archives of up to a thousand files, read by way of their directories."""
    files = G.run(spark, sf, G.PROJECT_FILES).withColumn("part", F.floor(c("p_partkey") / 1000))
    read = PJ.archived_files(PJ.zipped(files, ["project", "part"])).filter("problem is null")
    return SC.kept_files(read.withColumn("project", F.substring_index("archive", "/", 1))).select("project", "path", c("size").alias("n"))


register("flt_page_level_file", PF + " SELECT p_partkey, p_type IN ('MEDIUM', 'LARGE', 'PROMO', 'STANDARD') AS page_level FROM pf")(lambda s, sf: _files(s, sf).select("p_partkey", SC.page_level(c("path")).alias("page_level")))
register("ext_next_routes", PF + " SELECT p_partkey, '/p' || p_partkey AS route FROM pf WHERE p_type = 'MEDIUM'")(lambda s, sf: _files(s, sf).select("p_partkey", SC.next_route(c("path")).alias("route")).filter(c("route").isNotNull()))
_img = "p_size % 11 <> 0"
_src = [("missing-alt", f"p_size % 3 = 0 AND {_img}"), ("image-dimensions", f"p_size % 3 = 0 AND {_img}"), ("console", "p_size % 4 = 0"), ("debugger", "p_size % 4 = 0"), ("generic-cta", "p_size % 5 = 0"), ("hash-link", "p_size % 5 = 0"), ("noopener", "p_size % 5 = 1"),
        ("mixed-content", "(p_size % 5 = 1 OR p_size % 9 = 0)"), ("secret-generic-secret", "(p_size % 6 = 0 OR p_size % 16 = 9)"), ("secret-aws-access-key", "p_size % 6 = 1"), ("clickable-role", "p_size % 7 = 0"), ("xss-inner-html", "p_size % 7 = 0"), ("landmarks", "p_size % 8 <> 0 AND p_type <> 'SMALL'"),
        ("table-headers", "p_size % 9 = 0"), ("field-label", "p_size % 9 = 0"), ("autoplay-muted", "p_size % 9 = 0"), ("autoplay-controls", "p_size % 9 = 0"), ("list-key", "p_size % 10 = 7"), ("v-for-key", "p_size % 12 = 5"), ("ng-for-track-by", "p_size % 12 = 5"),
        ("xss-bound-inner-html", "p_size % 15 = 2"), ("xss-at-html", "p_size % 15 = 2"), ("xss-set-html", "p_size % 15 = 2"), ("icon-only", "p_size % 15 = 4"), ("lazy-images", "p_size % 15 = 7")]
register("audit_source_files", PF + " " + " UNION ALL ".join(f"SELECT project, p AS path, '{r}' AS rule_id FROM pf WHERE {cond}" for r, cond in _src))(lambda s, sf: SC.audit_files(_files(s, sf)).select("project", "path", "rule_id"))
_html, _jsx = "p_type = 'STANDARD'", "p_type IN ('SMALL', 'MEDIUM', 'LARGE')"
_plain, _whole = '<img src="/a.png">', '<img src="/a.png" alt="a" width="1" height="2">'
_three = [f'<img src="/{i}.png" alt="{i}" width="1" height="2">' for i in (1, 2, 3)]
_live = [("img-missing-alt", _plain, f"p_size % 3 = 0 AND {_img}"), ("img-no-lazy-loading", _plain, f"p_size % 3 = 0 AND {_img}"), ("img-no-lazy-loading", _whole, f"p_size % 3 <> 0 AND {_img}"), *[("img-no-lazy-loading", x, "p_size % 15 = 7") for x in _three],
         ("console-debugger-statement", "console.log(", "p_size % 4 = 0"), ("console-debugger-statement", "debugger;", "p_size % 4 = 0"), ("hash-only-link", '<a href="#" onClick={go}>', "p_size % 5 = 0"), ("generic-cta-text", '<a href="#" onClick={go}>Here</a>', "p_size % 5 = 0"),
         ("a-target-blank-noopener", '<a target="_blank" href="http://plain.example.com/x">', "p_size % 5 = 1"), ("hardcoded-secret", 'password = "abcdefghij1234567890"', "p_size % 6 = 0"), ("clickable-div-no-role", "<div onClick={f}>", "p_size % 7 = 0"), ("xss-risky-binding", "dangerouslySetInnerHTML", "p_size % 7 = 0"),
         ("form-field-missing-label", '<input name="q">', "p_size % 9 = 0"), ("form-field-missing-label", '<input name="n">', "p_size % 9 = 0"), ("autoplay-video-not-muted", '<video autoplay src="http://v.example.com/v.mp4">', "p_size % 9 = 0"), ("mixed-content-http", 'src="http://v.example.com/v.mp4"', "p_size % 9 = 0"),
         ("title-empty", "<title></title>", f"p_size % 10 = 3 AND {_html}"), ("meta-description-empty", '<meta name="description" content=""', f"p_size % 10 = 3 AND {_html}"), ("missing-list-key", ".map((x) => <li", f"p_size % 10 = 7 AND {_jsx}"),
         ("hardcoded-secret", 'token = "aaaaaaaaaaaaaaaaaaaa"', "p_size % 16 = 9"), ("hardcoded-secret", 'secret = "bbbbbbbbbbbbbbbbbbbb"', "p_size % 16 = 9")]
_lm = PF + ", m AS (" + " UNION ALL ".join(f"SELECT project, p, p_partkey, content, '{r}' AS rule_id, '{x}' AS t FROM pf WHERE {cond}" for r, x, cond in _live) + ")"
register("ext_findings_pos", _lm + ' SELECT project, p AS path, rule_id, (instr(content, t) - 1)::INT AS start, (instr(content, t) - 1 + length(t))::INT AS "end" FROM m')(lambda s, sf: SC.positions(_files(s, sf)))
register("audit_source_live", _lm + " SELECT project, p AS path, rule_id, count(*) AS n FROM m GROUP BY project, p, rule_id, p_partkey")(lambda s, sf: SC.live_counts(_files(s, sf)))
_found = " UNION ALL ".join(f"SELECT project, p, '{r}' AS rule_id FROM pf WHERE {cond}" for r, cond in _src)
register("agg_file_issue_counts", PF + f", x AS ({_found}) SELECT project, p AS name, 'file' AS kind, count(*) AS n FROM x GROUP BY ALL UNION ALL SELECT project, split_part(p, '/', 1), 'folder', count(*) FROM x GROUP BY ALL")(
    lambda s, sf: SC.issue_counts(SC.audit_files(_files(s, sf))))
_size = "SELECT project, count(DISTINCT p) AS n_nodes, 0::BIGINT AS n_edges FROM pf GROUP BY 1"
register("topk_worst_files", PF + f" SELECT project, path, n, n_nodes, n_edges FROM (SELECT project, p AS path, count(*) AS n FROM ({_found}) GROUP BY ALL ORDER BY n DESC, project, path LIMIT 8) JOIN ({_size}) USING (project)")(
    lambda s, sf: SC.worst_files(_files(s, sf), 8))
register("audit_project_stack", PF + " SELECT project, CASE WHEN bool_or(p_type = 'PROMO') THEN 'vue' WHEN bool_or(p_type IN ('SMALL', 'MEDIUM', 'LARGE')) THEN 'react' ELSE 'static' END AS stack FROM pf GROUP BY 1")(lambda s, sf: SC.project_stack(_files(s, sf)))
register("audit_fix_integrity", """SELECT p_partkey, CASE p_size % 5 WHEN 1 THEN 'shrunk' WHEN 2 THEN 'angle-brackets' WHEN 3 THEN 'quotes' WHEN 4 THEN 'closing-tag' END AS reason FROM part""")(
    lambda s, sf: SC.integrity(G.table(s, sf, "part").select(
        F.lit("p").alias("project"), c("p_partkey").cast("string").alias("path"), F.concat(F.lit('<p class="a">'), c("p_name"), F.lit("</p>")).alias("original"), (c("p_size") % 5).alias("m"), "p_name")
        .withColumn("modified", F.when(c("m") == 1, "x").when(c("m") == 2, F.concat(c("original"), F.lit("<br"))).when(c("m") == 3, F.concat(c("original"), F.lit('"')))
                    .when(c("m") == 4, F.concat(F.lit('<p class="a">'), c("p_name"), F.lit("<p/><hr/>"))).otherwise(F.concat(c("original"), F.lit("<hr>"))))).select(c("path").cast("long").alias("p_partkey"), "reason"))

# --- repairs

_st = "CASE WHEN rule_id IN (" + ", ".join(f"'{x}'" for x in FX.FIXED) + ") THEN 'fixed' WHEN rule_id IN (" + ", ".join(f"'{x}'" for x in FX.NEEDS_VALUE) + ") THEN 'ai-needed' WHEN rule_id IN (" + ", ".join(f"'{x}'" for x in FX.REPORTED) + ") THEN 'skipped' END"
PLAN = f", pl AS (SELECT page_id, rule_id, {_st} AS status FROM fx WHERE NOT passed)"


def _plan(s, sf):
    return FX.plan(_findings(s, sf))


register("audit_fix_plan", _all(PLAN, "SELECT * FROM pl WHERE status IS NOT NULL"))(lambda s, sf: _plan(s, sf).select("page_id", "rule_id", "status"))
register("agg_fix_summary", _all(PLAN, "SELECT page_id, count_if(status = 'fixed')::BIGINT AS fixed, count_if(status = 'ai-needed')::BIGINT AS ai_needed, count_if(status = 'skipped')::BIGINT AS skipped FROM pl WHERE status IS NOT NULL GROUP BY 1"))(lambda s, sf: FX.summary(_plan(s, sf)))
register("set_open_fix_items", _all(PLAN, "SELECT page_id, rule_id, 'target' AS item FROM pl WHERE status = 'ai-needed' AND rule_id <> 'title' UNION ALL SELECT page_id, rule_id, 'result' FROM pl WHERE status = 'skipped'"))(
    lambda s, sf: (lambda p: FX.open_items(p, p.filter(c("rule_id") == "title").select("page_id", "rule_id")))(_plan(s, sf)))
register("fix_repaired_pages", OD.REPAIRED)(lambda s, sf: DOM.repaired(_pages(s, sf)).select("page_id", "html"))
BANK = "SELECT p_type AS kind, p_brand AS category, arg_max(p_name, p_partkey) AS value FROM part GROUP BY 1, 2"
_parts = lambda s, sf: G.table(s, sf, "part").select(c("p_partkey").alias("target_id"), c("p_type").alias("kind"), c("p_brand").alias("category"), c("p_name").alias("value"), c("p_partkey").alias("seq"), F.when(c("p_size") % 2 == 0, "low").otherwise("high").alias("confidence"), "p_size")
ANSWER = """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'no json' WHEN p_size % 2 = 0 THEN '```json' || CHR(10) ELSE '' END || CASE WHEN p_size % 7 = 0 THEN '' ELSE
 '{"fixes":[{"id":"t' || CAST(p_partkey AS STRING) || '","value":" ' || p_name || ' ","confidence":"' || CASE WHEN p_size % 3 = 0 THEN 'LOW' ELSE 'high' END || '"},{"id":' || CAST(p_size AS STRING) || ',"value":"number"},{"id":"e","value":"  "}]}' END
 || CASE WHEN p_size % 2 = 0 THEN CHR(10) || '```' ELSE '' END AS raw FROM part"""
register("parse_fix_response", "SELECT p_partkey, 't' || p_partkey AS id, p_name AS value, p_size % 3 = 0 AS low FROM part WHERE p_size % 7 <> 0")(
    lambda s, sf: G.run(s, sf, ANSWER).select("p_partkey", F.inline(FX.response_values(c("raw")))))
_long = "REPEAT(p_name || ' ', 40)"
REWRITES = f"""SELECT p_partkey, CASE WHEN p_size % 9 = 8 THEN 'a.html' ELSE 'a.tsx' END AS path, '<html>export default ' || {_long} AS original,
 CASE p_size % 9 WHEN 0 THEN '  ' WHEN 1 THEN 'export default x' WHEN 2 THEN '<html>export default ' || REPEAT({_long}, 4) WHEN 3 THEN '<html>export default ' || {_long} || '(' WHEN 4 THEN '<html>export default ' || {_long} || '{{}}}}'
  WHEN 5 THEN '<html>export default ' || {_long} || '[' WHEN 6 THEN '<html>' || {_long} WHEN 8 THEN {_long} ELSE '<HTML>export  default ' || {_long} || '(a[0]){{}}' END AS modified FROM part"""
register("audit_fix_rewrite", "SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'empty' WHEN 1 THEN 'truncated' WHEN 2 THEN 'padded' WHEN 3 THEN 'parentheses' WHEN 4 THEN 'curly-braces' WHEN 5 THEN 'square-brackets' WHEN 6 THEN 'export-lost' WHEN 8 THEN 'html-lost' END AS reason FROM part")(
    lambda s, sf: G.run(s, sf, REWRITES).select("p_partkey", FX.rewrite_problem(c("original"), c("modified"), c("path")).alias("reason")))
register("agg_fix_bank_update", BANK)(lambda s, sf: FX.bank(_parts(s, sf)))
register("join_fix_bank", f"WITH b AS ({BANK}) SELECT p_partkey AS target_id, kind, category, value FROM part JOIN b ON kind = p_type AND category = p_brand")(
    lambda s, sf: (lambda p: FX.banked_values(p.select("target_id", "kind", "category"), FX.bank(p)))(_parts(s, sf)))
register("audit_fix_apply", f"WITH b AS ({BANK}) SELECT p_partkey AS target_id, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN 'needs-review' WHEN p_size % 3 = 0 THEN 'fixed' WHEN b.value IS NOT NULL THEN 'duplicated' ELSE 'skipped' END AS status, CASE WHEN p_size % 3 = 0 THEN p_name ELSE b.value END AS value FROM part LEFT JOIN b ON kind = p_type AND category = p_brand")(
    lambda s, sf: (lambda p: FX.apply_values(p.select("target_id", "kind", "category"), p.filter(c("p_size") % 3 == 0), FX.bank(p)))(_parts(s, sf)))

# --- custom rules

register("udf_custom_rules", _all("", "SELECT 'heavy' AS custom_rule, page_id, rule_id FROM fx WHERE weight >= 14 UNION ALL SELECT 'images', page_id, rule_id FROM fx WHERE NOT passed AND rule_id LIKE '%alt%'"))(
    lambda s, sf: CU.run_rules(_findings(s, sf).select("page_id", "rule_id", "passed", "weight"), [
        ("heavy", "weight >= 14"), ("broken", "no_such_column > 1"), ("images", lambda d: d.filter(~c("passed") & c("rule_id").contains("alt")))])[0].select("custom_rule", "page_id", "rule_id"))


def _whole(row):
    return f"{row['rule_id']} costs {row['weight']}" if row["weight"] >= 14 else None


def _share(row):
    if row["weight"] == 0:
        raise ValueError("nothing to share")
    return 100 // row["weight"] if row["weight"] < 2 else None


register("udf_row_rules", _all("", "SELECT 'whole' AS custom_rule, page_id, rule_id, rule_id || ' costs ' || weight AS found, NULL::VARCHAR AS error FROM fx WHERE weight >= 14 UNION ALL SELECT 'share', page_id, rule_id, CASE WHEN weight = 1 THEN '100' END, CASE WHEN weight = 0 THEN 'ValueError: nothing to share' END FROM fx WHERE weight < 2"))(
    lambda s, sf: CU.row_rules(_findings(s, sf).select("page_id", "rule_id", "weight"), {"whole": _whole, "share": _share}, ["page_id", "rule_id"]).select("custom_rule", "page_id", "rule_id", "found", "error"))
register("udf_rule_registry", "SELECT user_id AS rule_id, t AS updated_at FROM (SELECT user_id, arg_max(event_type <> 'error', ts) AS e, max(ts) AS t FROM events GROUP BY 1) WHERE e")(
    lambda s, sf: CU.registry(G.table(s, sf, "events").select(c("user_id").alias("rule_id"), (c("event_type") != "error").alias("enabled"), c("ts").alias("updated_at"))).select("rule_id", "updated_at"))

# --- streams


def _stream(s, sf, name, files=3):
    """The table in several files, one for each micro-batch."""
    return J.read_files(s, J.landed(G.table(s, sf, name), J.work_folder(s), files), "*.parquet", 1)


def _site(df):
    return df.withColumn("site", U.hostname(c("url")))


def _page_stream(s, sf):
    """The given pages as a stream; a batch is dealt over the cores, as one landed file may be a single split."""
    return _site(_stream(s, sf, "pages").repartition(s.sparkContext.defaultParallelism))


GIVEN = _all("", "SELECT page_id, category, rule_id, passed, weight FROM fx WHERE page_id < 1000000000")
register("str_page_audit", GIVEN)(lambda s, sf: J.append_to_table(J.page_audit(_page_stream(s, sf)), J.work_folder(s)).select("page_id", "category", "rule_id", "passed", "weight"))
register("str_progress", "SELECT user_id, count(*) AS count FROM events GROUP BY 1")(lambda s, sf: J.replace_table(J.progress(_stream(s, sf, "events"), "user_id"), J.work_folder(s)))
register("str_partial_report", _all(PCS.replace("{top}", "100"), "SELECT category, sum(score)::BIGINT AS score_sum, count(*) AS pages FROM pcs WHERE page_id < 1000000000 GROUP BY 1"))(
    lambda s, sf: J.replace_table(J.partial_report(_page_stream(s, sf)), J.work_folder(s)))


def _crawled_twice(s, sf, files=3):
    """Every page address of a crawl, once as given and once with a fragment, in several files."""
    pages = _site(G.given_pages(s, sf)).select("site", "url")
    found = pages.unionByName(pages.withColumn("url", F.concat("url", F.lit("#again"))))
    landed = J.landed(found, J.work_folder(s), files)
    return J.read_files(s, landed, "*.parquet", 1).withColumn("norm_url", U.normalize(c("url")))


register("str_seen_dedup", f"SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS site, {normalize('url')} AS norm_url FROM pages")(
    lambda s, sf: J.append_to_table(J.seen_dedup(_crawled_twice(s, sf), ["site", "norm_url"]), J.work_folder(s)).select("site", "norm_url"))
SEEN = f"SELECT page_id, {normalize('url')} AS norm_url FROM pages WHERE {normalize('url')} NOT IN (SELECT {normalize('url')} FROM pages WHERE url LIKE 'https:%')"
register("anti_seen_urls", SEEN)(lambda s, sf: (lambda p: J.unseen(p, p.filter(c("url").startswith("https:"))).select("page_id", "norm_url"))(G.given_pages(s, sf)))
register("str_resume", SEEN)(lambda s, sf: J.resume(s, _stream(s, sf, "pages"), G.given_pages(s, sf).filter(c("url").startswith("https:")), J.work_folder(s)).select("page_id", "norm_url"))
# NDJSON lines of the events; every seventeenth is cut short, as lines are that a crash leaves behind.
NDJSON = """SELECT CASE WHEN event_id % 17 = 3 THEN SUBSTRING(line, 1, LENGTH(line) - 5) ELSE line END AS value FROM
 (SELECT event_id, '{"event_id":' || CAST(event_id AS STRING) || ',"event_type":"' || event_type || '","props":' || props || '}' AS line FROM events) x"""
# The whole line of every event, and for every seventeenth a line that is cut short as well.
WHOLE_LINES = """SELECT EXPLODE(CASE WHEN event_id % 17 = 3 THEN ARRAY(SUBSTRING(line, 1, LENGTH(line) - 5), line) ELSE ARRAY(line) END) AS value FROM
 (SELECT event_id, '{"event_id":' || COALESCE(CAST(event_id AS STRING), 'null') || ',"event_type":' || COALESCE('"' || event_type || '"', 'null') || ',"props":' || COALESCE(props, 'null') || '}' AS line FROM events) x"""
EVENT = "event_id long, event_type string, props struct<k: long>"


def _routed(s, sf):
    folder = J.work_folder(s)
    G.run(s, sf, NDJSON).repartition(3).write.text(f"{folder}/landed")
    return J.route(s, J.read_lines(s, f"{folder}/landed", 1), EVENT, "event_type", folder)


register("str_event_router", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE event_id % 17 <> 3")(
    lambda s, sf: _routed(s, sf)[0].select("event_id", c("props.k").alias("k"), "event_type"))
register("str_rejected_events", f"SELECT value AS bad FROM ({NDJSON}) WHERE NOT json_valid(value)")(lambda s, sf: _routed(s, sf)[1])


@register("src_events_ndjson", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src_events_ndjson(spark, sf):
    """Lines as a batch, files read by Spark's text source; lines that are cut short are left out."""
    folder = J.work_folder(spark)
    G.run(spark, sf, WHOLE_LINES).write.text(f"{folder}/landed")
    return J.parsed_lines(spark.read.text(f"{folder}/landed"), EVENT).filter("bad is null").select("event_id", c("props.k").alias("k"))


def _scan_events(stream):
    """A site per user, a scan per site and day, as in the batch queries."""
    sql = G.SCAN_EVENTS.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}")
    return stream.sparkSession.sql(sql, events=stream)


register("str_scan_compare", SCAN_CTES + CHANGES + " SELECT * FROM ch")(lambda s, sf: J.scan_compare(s, _scan_events(_stream(s, sf, "events")), J.work_folder(s)))
