"""Project-level source operators and element annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsight.operators import dom as DOM
from crawlsight.operators import source_code as SC
from crawlsight.plans import oracle_dom as OD
from crawlsight.plans import oracle_pages as OP
from crawlsight.plans.catalog import register
from crawlsight.plans.registry_rest import PF, _files, _src
from crawlsight.sources import given as G

c = F.col
LF = f"WITH lf AS ({G.LINKED_FILES})"


def _linked(s, sf):
    return G.run(s, sf, G.LINKED_FILES)


register("src_project_meta", LF + " SELECT project, path, strlen(content) AS n FROM lf WHERE path IN ('package.json', 'robots.txt', 'sitemap.xml', 'vercel.json')")(
    lambda s, sf: SC.meta_files(_linked(s, sf)).select("project", "path", F.octet_length("content").cast("long").alias("n")))
register("flt_source_fixable", PF + " SELECT p_partkey, p_type <> 'STANDARD' AS fixable FROM pf")(
    lambda s, sf: _files(s, sf).select("p_partkey", SC.fixable(c("path"), c("content")).alias("fixable")))
register("flt_full_document", LF + " SELECT project, path, path = 'about.html' AS full_document FROM lf")(
    lambda s, sf: _linked(s, sf).select("project", "path", SC.full_document(c("content")).alias("full_document")))
register("join_ancestor_metadata", LF + " SELECT project, path FROM lf WHERE s_acctbal > 5000 AND path LIKE 'app/%'")(lambda s, sf: SC.has_metadata_above(_linked(s, sf)))
register("join_resolve_internal_links", LF + " SELECT project, 'app/shop/page.tsx' AS source, 'about.html' AS target FROM lf WHERE path = 'about.html' UNION ALL SELECT project, 'about.html', 'app/shop/page.tsx' FROM lf WHERE path = 'about.html'")(
    lambda s, sf: SC.internal_links(_linked(s, sf)))
register("audit_project_wide", LF + " SELECT project, bool_or(path = 'robots.txt') AS has_robots, bool_or(path = 'sitemap.xml') AS has_sitemap, bool_or(path = 'vercel.json') AS has_headers_config FROM lf GROUP BY 1")(lambda s, sf: SC.project_wide(_linked(s, sf)))
register("audit_native_components", LF + " SELECT project, 'app/shop/page.tsx' AS path, 'framework-link' AS rule_id, 2::BIGINT AS n FROM lf WHERE path = 'app/shop/page.tsx' AND s_acctbal > 5000")(
    lambda s, sf: SC.native_components(_linked(s, sf), SC.project_stack(_linked(s, sf))))
register("agg_affected_files", PF + f" SELECT project, rule_id, count(DISTINCT p) AS n_files, min(p) AS first_path FROM ({' UNION ALL '.join(f'''SELECT project, p, '{r}' AS rule_id FROM pf WHERE {cond}''' for r, cond in _src)}) GROUP BY ALL")(
    lambda s, sf: SC.affected_files(SC.audit_files(_files(s, sf))).select("project", "rule_id", "n_files", "first_path"))
register("ext_source_tags", PF + """ SELECT p_partkey, ((p_size % 3 = 0 AND p_size % 11 <> 0)::INT)::BIGINT AS n_img_without_alt, ((p_size % 11 <> 0)::INT + 3 * (p_size % 15 = 7)::INT)::BIGINT AS n_img FROM pf""")(
    lambda s, sf: _files(s, sf).select("p_partkey", F.regexp_extract_all("content", F.lit(r"<(?:img|Image)\b[^>]*>"), F.lit(0)).alias("tags")).select(
        "p_partkey", F.size(F.filter("tags", lambda t: ~t.rlike(r"=>\s*$") & ~t.rlike(r"(?i)(?:^|\s)(?:alt|:alt|v-bind:alt|\[alt\])\s*="))).cast("long").alias("n_img_without_alt"),
        F.size("tags").cast("long").alias("n_img")))


register("audit_element_annotations", OD.ANNOTATIONS)(lambda s, sf: DOM.annotations(G.audit_pages(s, sf)).select("page_id", "rule_id", "start"))


@register("join_site_signals", OP.AUDIT_PAGES.join(["WITH ", " "]) + "SELECT page_id, site, rule_id FROM ap, (SELECT unnest(['robots-missing', 'sitemap-missing']) AS rule_id) WHERE depth = 0")
def join_site_signals(spark, sf):
    """Site findings attach to the home page only. One row of findings per site; the site list is
    joined by key, and Spark broadcasts it only below its own size threshold."""
    pages = G.audit_pages(spark, sf).select("page_id", "site", F.coalesce("depth", F.lit(0)).alias("depth"))
    sites = pages.select("site").distinct().select("site", F.explode(F.array(F.lit("robots-missing"), F.lit("sitemap-missing"))).alias("rule_id"))
    return pages.filter(c("depth") == 0).join(sites, "site").select("page_id", "site", "rule_id")
