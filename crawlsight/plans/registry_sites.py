"""Crawl files, page speed, rendering, icons."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsight.operators import extract as X
from crawlsight.operators import site_files as SF
from crawlsight.plans import oracle_pages as OP
from crawlsight.plans.catalog import register
from crawlsight.sources import given as G

c = F.col


def _files(spark, sf):
    return G.run(spark, sf, G.SITE_FILES)


FILES = f"WITH s AS ({G.SITE_FILES})"
NL = "chr(10)"


def _rules(rows, key="site", src="s"):
    sev = OP.SEVERITY
    parts = " UNION ALL ".join(f"SELECT {key}, '{r}' AS rule_id, {str(p).lower()} AS passed, {w} AS weight FROM {src} WHERE {cond}" for r, p, w, cond in rows)
    return f"SELECT {key}, rule_id, passed, weight FROM ({parts})"


register("src_site_files", f"{FILES} SELECT site, origin, robots_status, robots, sitemap_status, llms FROM s")(
    lambda s, sf: _files(s, sf).select("site", "origin", "robots_status", "robots", "sitemap_status", "llms"))
LINES = rf"""{FILES}, l AS (SELECT site, origin, unnest(string_split(robots, chr(10))) AS x, generate_subscripts(string_split(robots, chr(10)), 1) AS i FROM s),
d AS (SELECT site, origin, i, lower(trim(split_part(x, ':', 1))) AS directive, trim(regexp_replace(regexp_replace(x, '^[^:]*:', ''), '#.*$', '')) AS value FROM l WHERE contains(x, ':') AND NOT x LIKE '#%'),
o AS (SELECT *, CASE WHEN directive = 'user-agent' AND coalesce(lag(directive) OVER w, '') <> 'user-agent' THEN 1 ELSE 0 END AS opens FROM d WINDOW w AS (PARTITION BY site ORDER BY i)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY site ORDER BY i) AS group_no FROM o)"""
ROBOTS = LINES + " SELECT site, group_no::BIGINT AS group_no, directive, CASE WHEN directive = 'user-agent' THEN lower(value) ELSE value END AS value FROM g WHERE group_no > 0"
register("ext_robots", ROBOTS)(lambda s, sf: SF.robots_rows(_files(s, sf)))
register("win_robots_group", ROBOTS)(lambda s, sf: SF.robots_groups(_files(s, sf)))
register("ext_robots_sitemaps", LINES + " SELECT site, value AS sitemap_url FROM d WHERE directive = 'sitemap'")(lambda s, sf: SF.robots_sitemaps(_files(s, sf)))
register("ext_robots_malformed", LINES + " SELECT site, directive || ': ' || value AS line FROM d WHERE directive NOT IN ('user-agent', 'disallow', 'allow', 'sitemap', 'crawl-delay', 'host', 'clean-param')")(
    lambda s, sf: SF.robots_malformed(_files(s, sf)).withColumn("line", F.concat(F.lower(F.substring_index("line", ":", 1)), F.lit(":"), F.substring_index("line", ":", -1))))
register("ext_sitemap", FILES + r""", e AS (SELECT site, unnest(regexp_extract_all(sitemap, '<url>.*?</url>')) AS u, generate_subscripts(regexp_extract_all(sitemap, '<url>.*?</url>'), 1) - 1 AS pos FROM s)
SELECT site, pos::INT AS pos, regexp_extract(u, '<loc>(.*?)</loc>', 1) AS loc, regexp_extract(u, '<lastmod>(.*?)</lastmod>', 1) AS lastmod FROM e""")(
    lambda s, sf: SF.sitemap_rows(_files(s, sf)))
_ok = "k NOT IN (1, 2, 3, 20)"
_set = "k NOT IN (10, 11, 12, 13, 14, 21)"
register("audit_crawl_files", FILES + " " + _rules([
    ("robots-missing", False, 6, "k = 1"), ("robots-error", False, 8, "k = 2"), ("robots-empty", False, 5, "k = 3"), ("robots-no-groups", False, 7, "k = 4"),
    ("robots-present", True, 0, f"{_ok} AND k <> 4"), ("robots-disallow-all", False, 15, "k IN (5, 6)"), ("robots-no-sitemap", False, 6, f"{_ok} AND k < 8"),
    ("robots-sitemap-declared", True, 0, "k >= 8 AND k <> 20"), ("robots-fetch", False, 7, "k = 20"), ("sitemap-fetch", False, 10, "k = 21"), ("robots-malformed", False, 4, "k IN (7, 15)"), ("robots-content-type", False, 3, "k = 9"),
    ("sitemap-http", False, 10, "k = 10"), ("sitemap-not-xml", False, 10, "k = 11"), ("sitemap-root", False, 10, "k = 12"), ("sitemap-empty", False, 10, "k = 13"),
    ("sitemap-missing-loc", False, 9, "k = 17"), ("sitemap-invalid-loc", False, 8, "k = 17"), ("sitemap-duplicates", False, 5, "k = 18"), ("sitemap-off-domain", False, 7, "k = 16"),
    ("sitemap-mixed-domain", False, 4, "k = 19"), ("sitemap-lastmod", False, 4, "k = 19"), ("sitemap-valid", True, 0, f"{_set} AND k NOT IN (16, 17, 18, 19)"),
    ("sitemap-index-missing-loc", False, 8, "k = 14"), ("sitemap-index-invalid-loc", False, 7, "k = 14"),
    ("sitemap-index-unreachable", False, 7, "k = 14 AND coalesce(llms, '') <> '# Site'")]))(
    lambda s, sf: SF.audit_crawl_files(_files(s, sf), G.run(s, sf, G.CHILD_SITEMAPS)).select("site", "rule_id", "passed", "weight"))
register("audit_aeo_site", FILES + " " + _rules([
    ("aeo-ai-crawlers-blocked", False, 12, "k >= 18 AND k <> 20"), ("aeo-ai-crawlers", True, 0, "k NOT IN (1, 2) AND k < 18"),
    ("aeo-llms-txt", True, 0, "trim(llms) <> ''"), ("aeo-llms-txt-missing", False, 3, "coalesce(trim(llms), '') = ''"),
    ("aeo-ai-crawler-network-block", False, 10, "bot_status IS NULL"), ("aeo-ai-crawler-firewall-block", False, 10, "bot_status = 403"), ("aeo-ai-crawler-firewall", True, 0, "bot_status = 200")]))(
    lambda s, sf: SF.audit_aeo_site(_files(s, sf)).select("site", "rule_id", "passed", "weight"))
_bots = []
for _b in SF.TOOL_BOTS:
    _bad = "k = 5 OR k >= 18" if _b == "ccbot" else "k = 5"
    _bots += [(f"ai-bot-blocked-{_b}", False, 4, f"k NOT IN (1, 20) AND ({_bad})"), (f"ai-bot-allowed-{_b}", True, 0, f"k NOT IN (1, 20) AND NOT ({_bad})")]
register("audit_robots_tool", FILES + " " + _rules([
    ("robots-missing", False, 3, "k = 1"), ("robots-error-status", False, 6, "k = 2"), ("robots-reachable", True, 0, "k NOT IN (1, 2, 20)"), ("robots-fetch-error", False, 10, "k = 20"),
    ("robots-no-sitemap", False, 2, "k <> 1 AND k < 8"), ("robots-sitemap-ref", True, 0, "k >= 8 AND k <> 20"), *_bots]))(
    lambda s, sf: SF.audit_robots_tool(_files(s, sf)).select("site", "rule_id", "passed", "weight"))
register("audit_sitemap_tool", FILES + " " + _rules([
    ("sitemap-error-status", False, 12, "k = 10"), ("sitemap-fetch-error", False, 12, "k = 21"), ("sitemap-not-xml", False, 12, "k IN (11, 12)"), ("sitemap-valid-xml", True, 0, "k NOT IN (10, 11, 12, 21)"),
    ("sitemap-empty", False, 8, "k IN (11, 12, 13)"), ("sitemap-url-count", True, 0, "k NOT IN (10, 11, 12, 13, 21)"), ("sitemap-no-lastmod", False, 2, "k = 16"),
    ("sitemap-has-lastmod", True, 0, "k NOT IN (10, 11, 12, 13, 14, 16, 21)")]))(
    lambda s, sf: SF.audit_sitemap_tool(_files(s, sf)).select("site", "rule_id", "passed", "weight"))
register("join_ua_status", FILES + " SELECT origin AS url, browser_status, bot_status, CASE WHEN bot_status IS NULL THEN 'unreachable' WHEN bot_status >= 400 THEN 'blocked' ELSE 'open' END AS access FROM s")(
    lambda s, sf: SF.ua_status(_files(s, sf)))

V = f"WITH v AS (SELECT *, CASE cat WHEN 'FAST' THEN 'good' WHEN 'SLOW' THEN 'poor' ELSE 'needs-improvement' END AS r FROM ({G.VITALS}))"


def _rate(x, good, poor):
    return f"CASE WHEN {x} <= {good} THEN 'good' WHEN {x} <= {poor} THEN 'needs-improvement' ELSE 'poor' END"


register("src_web_vitals", V + """ SELECT id, st = 'O' AS is_page_level, CASE WHEN st <> 'F' THEN ms::DOUBLE END AS lcp, CASE WHEN st <> 'F' THEN r END AS lcp_rating, CASE WHEN st = 'O' THEN 150.0::DOUBLE END AS inp, CASE WHEN st = 'O' THEN 0.12::DOUBLE END AS cls,
 CASE st WHEN 'O' THEN 87 WHEN 'P' THEN 0 ELSE 50 END AS performance, CASE WHEN st = 'F' THEN ms::DOUBLE END AS lab_lcp FROM v""")(
    lambda s, sf: SF.web_vitals(G.run(s, sf, G.VITALS)).select("id", "is_page_level", "lcp", "lcp_rating", "inp", "cls", "performance", "lab_lcp"))
register("audit_web_vitals", V + f""", x AS (SELECT id, 'cwv-lcp' AS rule_id, CASE WHEN st = 'F' THEN {_rate('ms', 2500, 4000)} ELSE r END AS g, 14 AS b, 8 AS m FROM v
 UNION ALL SELECT id, 'cwv-inp', r, 14, 8 FROM v WHERE st = 'O' UNION ALL SELECT id, 'cwv-tbt', {_rate('ms', 200, 600)}, 10, 6 FROM v WHERE st = 'P'
 UNION ALL SELECT id, 'cwv-cls', CASE st WHEN 'O' THEN r WHEN 'P' THEN 'needs-improvement' ELSE 'good' END, 12, 7 FROM v)
SELECT id, rule_id, g = 'good' AS passed, CASE g WHEN 'good' THEN 0 WHEN 'poor' THEN b ELSE m END AS weight FROM x""")(
    lambda s, sf: SF.audit_web_vitals(SF.web_vitals(G.run(s, sf, G.VITALS))).select("id", "rule_id", "passed", "weight"))
register("prj_cwv_rating", V + f" SELECT id, {_rate('ms', 2500, 4000)} AS rating FROM v")(
    lambda s, sf: G.run(s, sf, G.VITALS).select("id", SF.rate(c("ms"), 2500, 4000).alias("rating")))
register("audit_js_rendering", f"WITH r AS ({G.RENDERS}) " + _rules([
    ("js-render-timeout", False, 4, "timed_out"), ("js-render-timeout", True, 0, "NOT timed_out"), ("js-render-errors", False, 3, "n_errors > 0"), ("js-render-errors", True, 0, "n_errors = 0")], "page_id", "r"))(
    lambda s, sf: SF.audit_js_rendering(G.run(s, sf, G.RENDERS)).select("page_id", "rule_id", "passed", "weight"))


@register("audit_favicon", f"WITH {OP.AUDIT_PAGES}, a AS (SELECT page_id, contains(html, 'rel=\"icon\"') AS icon, contains(html, 'rel=\"manifest\"') AS man, p_size % 8 AS m FROM ap) " + _rules([
    ("favicon-missing-link", False, 3, "NOT icon"), ("favicon-link-present", True, 0, "icon"), ("manifest-missing", False, 2, "NOT man"), ("manifest-linked", True, 0, "man"),
    ("manifest-fetch-error", False, 3, "man AND m = 3 AND page_id % 2 = 0"), ("manifest-valid", True, 0, "man AND m = 3 AND page_id % 2 = 1"), ("manifest-missing-fields", False, 3, "man AND m = 7")], "page_id", "a"))
def audit_favicon(spark, sf):
    """Manifest bodies made of the part's size: whole, partial, or not there."""
    shop = G.catalog_pages(spark, sf)
    bodies = shop.select("page_id", F.when(c("p_size") % 8 == 3, F.when(c("page_id") % 2 == 1, F.lit('{"name":"n","icons":[{}],"start_url":"/","display":"standalone"}')))
                         .otherwise(F.lit('{"name":"n","icons":[]}')).alias("body")).filter(c("body").isNotNull())
    return SF.audit_favicon(X.page_features(G.audit_pages(spark, sf)), bodies).select("page_id", "rule_id", "passed", "weight")
