"""Scores, cards, report rows, scan history, crawl graph."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.functions.findings import SEVERITIES, severity_of, severity_rank
from crawlsight.operators import graph as GR
from crawlsight.operators import history as H
from crawlsight.operators import page_rules as R
from crawlsight.operators import score as S
from crawlsight.plans import oracle_pages as OP
from crawlsight.plans.catalog import register
from crawlsight.session import shared_folder, stored
from crawlsight.sources import given as G
from crawlsight.sources import scan_store as STORE

c = F.col
ALL = OP.all_findings
ROUND = "CAST(round(avg({x})) AS INT)"


_tables: dict[tuple[str, str], tuple[tuple, DataFrame]] = {}


def _audited(spark, sf):
    """Pages with their findings, written once to the shared folder and read by every query over them.

    A table for each folder holds as long as the files of its inputs are the same and the session lives.
    """
    app = spark.sparkContext.applicationId
    for old in [k for k in _tables if k[0] != app]:
        del _tables[old]  # of sessions that have ended
    files = G.state(spark, sf, "pages", "part")
    if (app, sf) not in _tables or _tables[app, sf][0] != files:
        _tables[app, sf] = files, stored(R.page_audit(G.audit_pages(spark, sf)), "page-audit")
    return _tables[app, sf][1]


def _findings(spark, sf):
    return R.findings_of(_audited(spark, sf))


# --- oracle fragments over fx(category, page_id, url, rule_id, passed, weight) and f

PCS = ", pcs AS (SELECT f.page_id, f.url, f.depth, k.category, greatest(20, least({top}, 100 - coalesce(sum(fx.weight), 0)))::INT AS score FROM f CROSS JOIN (SELECT unnest(['seo','aeo','geo','speed','a11y','conversions']) AS category) k LEFT JOIN fx ON fx.page_id = f.page_id AND fx.category = k.category GROUP BY ALL)"
CAT = PCS.replace("{top}", "100") + ", cs AS (SELECT category, greatest(20, least(100, CAST(round(avg(score)) AS INT))) AS score, count(*) AS pages_analyzed FROM pcs GROUP BY category)"
FX = f", fd AS (SELECT fx.*, f.depth, {OP.SEVERITY} AS severity FROM fx JOIN f USING (page_id))"
CARD = FX + ", ci AS (SELECT category, rule_id, count(*) AS n_affected, count(DISTINCT page_id) AS n_pages, arg_min(weight, (depth, url, weight)) AS weight, arg_min(severity, (depth, url, weight)) AS severity, arg_min(url, (depth, url, weight)) AS first_url FROM fd WHERE NOT passed GROUP BY ALL)"
LBL = "CASE category WHEN 'seo' THEN 'SEO' WHEN 'aeo' THEN 'AEO' WHEN 'geo' THEN 'GEO' WHEN 'speed' THEN 'Performance' WHEN 'a11y' THEN 'Accessibility' ELSE 'Conversions' END"


def _all(ctes: str, select: str) -> str:
    return ALL(ctes + " " + select)


register("agg_page_category_score", _all(PCS.replace("{top}", "100"), "SELECT page_id, category, score FROM pcs"))(
    lambda s, sf: S.page_category_scores(_audited(s, sf)).select("page_id", "category", "score"))
register("agg_tool_score", _all(PCS.replace("{top}", "99"), "SELECT page_id, category, score FROM pcs"))(
    lambda s, sf: S.page_category_scores(_audited(s, sf), 99).select("page_id", "category", "score"))
register("agg_page_score", _all(PCS.replace("{top}", "100"), "SELECT page_id, CAST(round(avg(score)) AS INT) AS score FROM pcs GROUP BY page_id"))(
    lambda s, sf: S.page_scores(S.page_category_scores(_audited(s, sf))).select("page_id", "score"))

CARD_SELECT = f"""SELECT category, {LBL} AS label, score, pages_analyzed, rule_id, n_affected, n_pages, weight, severity, first_url,
 CASE WHEN n_affected > 1 THEN '(found on ' || n_affected || ' of ' || pages_analyzed || ' pages scanned)' ELSE '' END AS detail_suffix FROM cs JOIN ci USING (category)"""


@register("agg_category_card", _all(CAT + CARD, CARD_SELECT))
def agg_category_card(spark, sf):
    audited = _audited(spark, sf)
    return S.category_cards(audited, R.findings_of(audited))


register("srt_issues_weight", _all(CARD, "SELECT category, rule_id, weight FROM ci ORDER BY category, weight DESC, rule_id"))(
    lambda s, sf: S.card_issues(_findings(s, sf)).select("category", "rule_id", "weight").orderBy("category", F.desc("weight"), "rule_id"))
register("win_first_seen", _all(CARD, "SELECT category, rule_id, first_url, weight, severity FROM ci"))(
    lambda s, sf: S.card_issues(_findings(s, sf)).select("category", "rule_id", "first_url", "weight", "severity"))
register("anti_passed", _all("", "SELECT DISTINCT category, rule_id FROM fx a WHERE passed AND NOT EXISTS (SELECT 1 FROM fx b WHERE NOT b.passed AND b.category = a.category AND b.rule_id = a.rule_id)"))(
    lambda s, sf: S.card_passed(_findings(s, sf)))
register("agg_all_categories", _all(CAT.replace("FROM pcs GROUP BY category", "FROM pcs WHERE depth <= 1 GROUP BY category"), "SELECT * FROM cs"))(
    lambda s, sf: S.category_scores(S.page_category_scores(_audited(s, sf).filter(c("depth") <= 1))))
register("agg_report_summary", _all(CARD, "SELECT category, o AS open_issues, n AS total_issues, coalesce(p, 0) AS passed_count FROM (SELECT category, count(*) n, count_if(NOT contains(rule_id, 'alt'))::BIGINT o FROM ci GROUP BY 1) LEFT JOIN (SELECT category, count(DISTINCT rule_id) p FROM fx a WHERE passed AND NOT EXISTS (SELECT 1 FROM fx b WHERE NOT b.passed AND b.category = a.category AND b.rule_id = a.rule_id) GROUP BY 1) USING (category)"))(
    lambda s, sf: S.report_summary(_findings(s, sf), _findings(s, sf).filter(~c("passed") & c("rule_id").contains("alt")).select("category", "rule_id").distinct()))
register("srt_report_issues", _all(CARD, f"SELECT {LBL} AS category, rule_id, severity, 'Open' AS status, weight FROM ci ORDER BY weight DESC, rule_id"))(
    lambda s, sf: S.card_issues(_findings(s, sf)).select(S.label(c("category")).alias("category"), "rule_id", "severity", F.lit("Open").alias("status"), "weight")
    .orderBy(F.desc("weight"), "rule_id"))
TOPN = "SELECT category, rule_id, weight, rank, remaining FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, rule_id)::INT AS rank, greatest(count(*) OVER (PARTITION BY category) - {n}, 0)::BIGINT AS remaining FROM ci) WHERE rank <= {n}"
for _name, _n in (("topk_insights", 6), ("lim_dashboard", 50)):
    register(_name, _all(CARD, TOPN.replace("{n}", str(_n))))(
        lambda s, sf, n=_n: S.top_per_category(S.card_issues(_findings(s, sf)), n).select("category", "rule_id", "weight", "rank", "remaining"))
register("agg_high_severity", _all(FX, "SELECT count_if(NOT passed AND severity IN ('critical', 'high'))::BIGINT AS n_high, count(*) AS n_all FROM fd"))(
    lambda s, sf: _findings(s, sf).agg(F.count_if(~c("passed") & c("severity").isin("critical", "high")).alias("n_high"), F.count(F.lit(1)).alias("n_all")))
register("flt_open_issues", _all("", "SELECT page_id, category, rule_id FROM fx WHERE NOT passed"))(
    lambda s, sf: _findings(s, sf).filter(~c("passed")).select("page_id", "category", "rule_id"))
register("flt_min_severity", _all(FX, "SELECT page_id, category, rule_id, severity FROM fd WHERE severity IN ('critical', 'high')"))(
    lambda s, sf: S.min_severity(_findings(s, sf), "high").select("page_id", "category", "rule_id", "severity"))
register("flt_visible_category", _all(CAT, "SELECT category, score, (SELECT CAST(round(avg(score)) AS INT) FROM cs) AS overall FROM cs WHERE category NOT IN ('geo', 'aeo')"))(
    lambda s, sf: (lambda cs: cs.join(F.broadcast(cs.agg(F.round(F.avg("score")).cast("int").alias("overall")))).filter(~c("category").isin("geo", "aeo"))
                   .select("category", "score", "overall"))(S.category_scores(S.page_category_scores(_audited(s, sf)))))


@register("flt_rule_prefix", _all("", "SELECT page_id, category, rule_id FROM fx WHERE rule_id LIKE 'og-%' OR rule_id LIKE 'title%' OR rule_id LIKE 'aeo-a%'"))
def flt_rule_prefix(spark, sf):
    prefixes = spark.createDataFrame([("og-",), ("title",), ("aeo-a",)], "prefix string")
    return S.by_prefix(_findings(spark, sf), prefixes).select("page_id", "category", "rule_id")


register("prj_severity", "SELECT l_orderkey, l_linenumber, CASE WHEN w >= 14 THEN 'critical' WHEN w >= 9 THEN 'high' WHEN w >= 5 THEN 'medium' WHEN w >= 2 THEN 'low' ELSE 'informational' END AS severity FROM (SELECT *, CAST(l_quantity / 3 AS INT) w FROM (SELECT l_orderkey, l_linenumber, floor(l_quantity / 3) * 3 AS l_quantity FROM lineitem))")(
    lambda s, sf: G.table(s, sf, "lineitem").select("l_orderkey", "l_linenumber", severity_of(F.floor(c("l_quantity") / 3)).alias("severity")))
register("prj_score_band", _all(PCS.replace("{top}", "100"), "SELECT page_id, category, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'warn' ELSE 'critical' END AS band FROM pcs"))(
    lambda s, sf: S.page_category_scores(_audited(s, sf)).select("page_id", "category", S.score_band(c("score")).alias("band")))
register("prj_mark_resolved", _all(CAT + CARD, "SELECT category, score, CASE WHEN g IS NULL THEN score ELSE least(97, score + g) END::INT AS new_score FROM cs LEFT JOIN (SELECT category, sum(weight)::INT g FROM ci WHERE rule_id LIKE '%e%' AND category <> 'geo' GROUP BY 1) USING (category)"))(
    lambda s, sf: S.mark_resolved(S.category_scores(S.page_category_scores(_audited(s, sf))),
                                  S.card_issues(_findings(s, sf)).filter(c("rule_id").contains("e") & (c("category") != "geo")).select("category", "weight")))
register("topk_security", f"SELECT * FROM (SELECT page_id, passed, rule_id, row_number() OVER (PARTITION BY page_id, passed ORDER BY weight DESC, rule_id)::INT AS rank FROM ({OP.security()})) WHERE rank <= CASE WHEN passed THEN 8 ELSE 12 END")(
    lambda s, sf: S.top_findings(R.audit(G.audit_pages(s, sf), "security_headers"), 12, 8).select("page_id", "passed", "rule_id", "rank"))
register("set_union_findings", _all(f", sec AS (SELECT * FROM ({OP.security()}))", "SELECT page_id, rule_id, passed, weight FROM fx UNION ALL SELECT page_id, rule_id, passed, weight FROM sec"))(
    lambda s, sf: _findings(s, sf).select("page_id", "rule_id", "passed", "weight").unionByName(
        R.audit(G.audit_pages(s, sf), "security_headers").select("page_id", "rule_id", "passed", "weight")))
_SITE = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
register("flt_issue_listing", _all(FX, f"SELECT * FROM (SELECT {_SITE} AS site, category, page_id, rule_id, severity, row_number() OVER (PARTITION BY {_SITE}, category ORDER BY page_id, rule_id, weight)::INT AS rank, count(*) OVER (PARTITION BY {_SITE}, category) AS total FROM fd WHERE NOT passed) WHERE rank <= 30"))(
    lambda s, sf: S.issue_listing(_findings(s, sf).withColumn("site", F.regexp_extract("url", "^https?://([^/?#]+)", 1)), ["site", "category"], 30).select("site", "category", "page_id", "rule_id", "severity", "rank", "total"))

# --- scan history

q = lambda name: (lambda spark, sf: G.run(spark, sf, name))
SC = f"WITH scans AS ({G.SCANS}), scores AS ({G.SCAN_SCORES}), fi AS ({G.SCAN_FINDINGS}), pv AS (SELECT *, lag(scan_id) OVER w AS prev_scan_id, lag(overall_score) OVER w AS prev_score FROM scans WINDOW w AS (PARTITION BY url, mode ORDER BY created_at, scan_id)), pr AS (SELECT scan_id, prev_scan_id FROM pv WHERE prev_scan_id IS NOT NULL)"
CHANGES = ", cu AS (SELECT pr.scan_id, category, rule_id FROM pr JOIN fi USING (scan_id)), pe AS (SELECT pr.scan_id, category, rule_id FROM pr JOIN fi ON fi.scan_id = prev_scan_id), ch AS (SELECT *, 'new' AS change FROM (FROM cu EXCEPT FROM pe) UNION ALL SELECT *, 'resolved' FROM (FROM pe EXCEPT FROM cu))"


def _pairs(spark, sf):
    return H.previous_scan(G.run(spark, sf, G.SCANS)).filter(c("prev_scan_id").isNotNull()).select("scan_id", "prev_scan_id")


register("src_scan_history", SC + " SELECT * FROM scans ORDER BY created_at DESC")(lambda s, sf: G.run(s, sf, G.SCANS).orderBy(F.desc("created_at")))
register("agg_overall_score", SC + " SELECT scan_id, CAST(round(avg(score)) AS INT) AS overall_score FROM scores GROUP BY 1")(lambda s, sf: H.overall(G.run(s, sf, G.SCAN_SCORES)))
register("win_prev_scan", SC + " SELECT scan_id, prev_score, overall_score - prev_score AS delta FROM pv")(
    lambda s, sf: H.previous_scan(G.run(s, sf, G.SCANS)).select("scan_id", "prev_score", "delta"))
register("join_prev_scan", SC + " SELECT * FROM pr")(_pairs)
DELTAS = ", dl AS (SELECT pr.scan_id, category, score AS cur, 0 AS prev FROM pr JOIN scores USING (scan_id) UNION ALL SELECT pr.scan_id, category, 0, score FROM pr JOIN scores ON scores.scan_id = prev_scan_id)"
DELTA_SELECT = " SELECT scan_id, category, sum(prev)::INT AS previous_score, sum(cur)::INT AS current_score, (sum(cur) - sum(prev))::INT AS delta FROM dl GROUP BY ALL"
register("join_scan_diff", SC + DELTAS + DELTA_SELECT)(lambda s, sf: H.category_deltas(G.run(s, sf, G.SCAN_SCORES), _pairs(s, sf)))
register("srt_categories_label", SC + DELTAS + DELTA_SELECT + " ORDER BY scan_id, category")(
    lambda s, sf: H.category_deltas(G.run(s, sf, G.SCAN_SCORES), _pairs(s, sf)).orderBy("scan_id", F.collate("category", "UNICODE_CI_AI"), "category"))
register("set_union_categories", SC + DELTAS + " SELECT DISTINCT scan_id, category FROM dl")(
    lambda s, sf: (lambda p, x: p.join(x, "scan_id").select("scan_id", "category").union(
        p.join(x.withColumnRenamed("scan_id", "prev_scan_id"), "prev_scan_id").select("scan_id", "category")).distinct())(_pairs(s, sf), G.run(s, sf, G.SCAN_SCORES)))
register("set_except_issues", SC + CHANGES + " SELECT * FROM ch")(lambda s, sf: H.issue_changes(G.run(s, sf, G.SCAN_FINDINGS), _pairs(s, sf)))
register("prj_summary_text", SC + CHANGES + """, n AS (SELECT scan_id, count_if(change = 'new')::BIGINT n_new, count_if(change = 'resolved')::BIGINT n_resolved FROM ch GROUP BY 1),
j AS (SELECT pv.scan_id, overall_score, overall_score - prev_score AS delta, coalesce(n_new, 0) AS n_new, coalesce(n_resolved, 0) AS n_resolved FROM pv LEFT JOIN n USING (scan_id) WHERE prev_scan_id IS NOT NULL)
SELECT scan_id, delta, n_new, n_resolved, coalesce(nullif(concat_ws(', ', CASE WHEN delta <> 0 THEN 'score ' || CASE WHEN delta > 0 THEN '+' ELSE '' END || delta || ' (now ' || overall_score || ')' END,
 CASE WHEN n_new > 0 THEN n_new || CASE WHEN n_new = 1 THEN ' new issue' ELSE ' new issues' END END, CASE WHEN n_resolved > 0 THEN n_resolved || ' resolved' END), ''), 'No change since the last scan.') AS summary FROM j""")(
    lambda s, sf: H.comparisons(G.run(s, sf, G.SCANS), G.run(s, sf, G.SCAN_FINDINGS)))
NOW = "TIMESTAMP '2024-02-10 00:00:00'"
now = lambda: F.lit("2024-02-10 00:00:00").cast("timestamp")
register("flt_due_schedules", f"SELECT id, url, frequency FROM ({G.SCHEDULES}) WHERE enabled AND next_run_at <= {NOW}")(
    lambda s, sf: H.due(G.run(s, sf, G.SCHEDULES), now()).select("id", "url", "frequency"))
register("str_due_schedules", f"SELECT id, CASE WHEN NOT (enabled AND next_run_at <= {NOW}) THEN next_run_at ELSE {NOW} + CASE frequency WHEN 'hourly' THEN INTERVAL 1 HOUR WHEN 'weekly' THEN INTERVAL 7 DAY WHEN 'monthly' THEN INTERVAL 1 MONTH WHEN 'yearly' THEN INTERVAL 1 YEAR ELSE INTERVAL 1 DAY END END AS next_run_at FROM ({G.SCHEDULES})")(
    lambda s, sf: H.run_due(G.run(s, sf, G.SCHEDULES), now()).select("id", "next_run_at"))
CUT = "TIMESTAMP '2024-01-26 00:00:00'"
register("flt_retention", SC + f" SELECT scan_id FROM scans WHERE created_at >= {NOW} - INTERVAL 15 DAY")(
    lambda s, sf: H.retained(G.run(s, sf, G.SCANS), now(), 15).select("scan_id"))


def _stored_scans(spark, scans):
    """All scans land, then those of single pages again with another score, twice."""
    path = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    STORE.create(scans, path)
    again = scans.filter(c("mode") == "single").withColumn("overall_score", F.lit(0))
    for _ in range(2):
        STORE.upsert(spark, path, again)
    return STORE.table(spark, path).select("scan_id", "overall_score")


def _merged_scans(spark, scans):
    """A store of the site scans takes over the others from a store of all."""
    path = f"{shared_folder(spark)}/scans-{uuid.uuid4().hex}"
    STORE.create(scans.filter(c("mode") == "site"), path)
    STORE.merge(spark, path, scans)
    return STORE.table(spark, path).select("scan_id", "overall_score")


register("sink_scan_upsert", SC + " SELECT scan_id, CASE WHEN mode = 'single' THEN 0 ELSE overall_score END AS overall_score FROM scans")(
    lambda s, sf: _stored_scans(s, G.run(s, sf, G.SCANS)))
register("merge_scan_stores", SC + " SELECT scan_id, overall_score FROM scans")(
    lambda s, sf: _merged_scans(s, G.run(s, sf, G.SCANS)))
register("topk_recent_scans", SC + " SELECT scan_id, created_at FROM scans ORDER BY created_at DESC, scan_id DESC LIMIT 10")(
    lambda s, sf: H.recent(G.run(s, sf, G.SCANS), 10).select("scan_id", "created_at"))
register("win_recent_history", f"SELECT scan_id FROM (SELECT scan_id, max(ts) t FROM ({G.SCAN_EVENTS}) GROUP BY 1) ORDER BY t DESC, scan_id DESC LIMIT 10")(
    lambda s, sf: H.recent(G.run(s, sf, G.SCAN_EVENTS).groupBy("scan_id").agg(F.max("ts").alias("created_at")), 10).select("scan_id"))

# --- crawl graph

BFS = f"""WITH RECURSIVE e AS ({G.EDGES}), b(node, depth) AS (SELECT 'p0', 0 UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 3),
m AS (SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1) SELECT m.node, m.depth, (SELECT min(e.src) FROM e JOIN m p ON p.node = e.src AND p.depth = m.depth - 1 WHERE e.dst = m.node) AS parent FROM m"""


@register("win_bfs_frontier", BFS)
def win_bfs_frontier(spark, sf):
    seed = G.table(spark, sf, "part").agg(F.min("p_partkey").alias("k")).select(F.concat(F.lit("p"), c("k").cast("string")).alias("node"))
    return GR.bfs(G.run(spark, sf, G.EDGES), seed, 3)


CHAINS = f"""r AS ({G.REDIRECTS}), w(url, cur, chain, outcome, st) AS (
 SELECT url, url, []::VARCHAR[], NULL::VARCHAR, NULL::INT FROM r
 UNION ALL SELECT w.url, CASE WHEN o IN ('ok', 'error', 'no-location', 'unknown') THEN w.cur ELSE loc END, CASE WHEN o IS NULL THEN list_append(chain, w.cur) ELSE chain END, o, s FROM (
   SELECT w.*, r.status AS s, r.location AS loc, CASE WHEN r.status IS NULL THEN 'unknown' WHEN r.status NOT BETWEEN 300 AND 399 THEN CASE WHEN r.status < 400 THEN 'ok' ELSE 'error' END
     WHEN r.location IS NULL THEN 'no-location' WHEN list_contains(list_append(chain, w.cur), r.location) THEN 'loop' END AS o
   FROM w LEFT JOIN r ON r.url = w.cur WHERE w.outcome IS NULL AND len(chain) < 8) w),
z AS (SELECT url, len(chain)::BIGINT AS hops, cur AS final_url, st::INT AS final_status, outcome FROM w WHERE outcome IS NOT NULL
 UNION ALL SELECT url, len(chain), cur, NULL, 'too-many' FROM w WHERE outcome IS NULL AND len(chain) = 8)"""
register("join_redirect_chain", f"WITH RECURSIVE {CHAINS} SELECT * FROM z")(lambda s, sf: GR.redirect_chains(G.run(s, sf, G.REDIRECTS)))


@register("audit_redirects", f"""WITH RECURSIVE {CHAINS}, v AS (SELECT *, CASE WHEN outcome = 'too-many' THEN 8 ELSE hops + 1 END AS entries FROM z)
SELECT url, 'redirect-loop' AS rule_id, 10 AS weight FROM v WHERE outcome = 'loop'
UNION ALL SELECT url, CASE WHEN outcome = 'unknown' THEN 'redirect-error' WHEN entries > 3 THEN 'redirect-chain-long' WHEN outcome = 'error' THEN 'redirect-status' ELSE 'redirect-ok' END,
 CASE WHEN outcome = 'unknown' THEN 4 WHEN entries > 3 THEN 6 WHEN outcome = 'error' THEN 10 ELSE 0 END FROM v""")
def audit_redirects(spark, sf):
    chains = GR.redirect_chains(G.run(spark, sf, G.REDIRECTS))
    entries = F.when(c("outcome") == "too-many", 8).otherwise(c("hops") + 1)
    row = lambda rule, weight: F.struct(F.lit(rule).alias("rule_id"), F.lit(weight).alias("weight"))
    main = (
        F.when(c("outcome") == "unknown", row("redirect-error", 4)).when(entries > 3, row("redirect-chain-long", 6))
        .when(c("outcome") == "error", row("redirect-status", 10)).otherwise(row("redirect-ok", 0)))
    loop = F.when(c("outcome") == "loop", row("redirect-loop", 10))
    rows = chains.select("url", F.explode(F.filter(F.array(loop, main), lambda x: x.isNotNull())).alias("x"))
    return rows.select("url", "x.rule_id", "x.weight")


TREE = "SELECT c_custkey AS node, CASE WHEN c_custkey > 0 THEN CAST(FLOOR((c_custkey - 1) / 5) AS BIGINT) END AS parent FROM customer"
register("agg_descendants", f"WITH RECURSIVE t AS ({TREE}), a(anc, node) AS (SELECT parent, node FROM t WHERE parent IS NOT NULL UNION ALL SELECT t.parent, a.node FROM a JOIN t ON t.node = a.anc WHERE t.parent IS NOT NULL) SELECT t.node, count(a.node) AS n_descendants FROM t LEFT JOIN a ON a.anc = t.node GROUP BY 1")(
    lambda s, sf: GR.descendants(G.run(s, sf, TREE)))
register("join_page_parent", f"WITH cat AS ({G.CATALOG_PAGES}) SELECT a.url, CASE WHEN a.depth = 0 THEN NULL WHEN b.url IS NOT NULL THEN a.parent_url ELSE '(root)' END AS parent FROM cat a LEFT JOIN (SELECT DISTINCT url FROM cat) b ON b.url = a.parent_url")(
    lambda s, sf: GR.page_tree(G.catalog_pages(s, sf)))
register("agg_crawl_source", "SELECT site, CASE WHEN bool_or(v) AND bool_or(NOT v) THEN 'mixed' WHEN bool_or(v) THEN 'sitemap' ELSE 'links' END AS source FROM (SELECT 'c' || o_custkey AS site, o_orderstatus = 'F' AS v FROM orders) GROUP BY 1")(
    lambda s, sf: GR.crawl_source(G.table(s, sf, "orders").select(F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("site"), F.when(c("o_orderstatus") == "F", "sitemap").otherwise("links").alias("via"))))
