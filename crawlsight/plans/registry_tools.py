"""The views of the single tools: findings of every audit, cut down to what a tool shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.operators import score as S
from crawlsight.plans.catalog import ORACLES, QUERIES, register
from crawlsight.plans.registry_scores import _all, _findings

c = F.col
PAGE_SOURCES = ("seo", "aeo", "geo", "speed", "a11y")
#: Audits beside the page categories: source, query, what a finding is about, when it passed.
AUDITS = [
    ("structured", "audit_structured_data", "page_id", "passed"),
    ("security", "audit_security_headers", "page_id", "passed"),
    ("links", "audit_links_page", "page_id", "passed"),
    ("images", "audit_images", "page_id", "passed"),
    ("favicon", "audit_favicon", "page_id", "passed"),
    ("robots", "audit_robots_tool", "site", "passed"),
    ("sitemap", "audit_sitemap_tool", "site", "passed"),
    ("redirect", "audit_redirects", "url", "weight = 0"),
    ("duplicate", "audit_duplicates", "''", "false"),
]
_PAGES = _all("", f"SELECT category AS source, page_id::VARCHAR AS subject, rule_id, passed, weight FROM fx WHERE category IN {PAGE_SOURCES}")
_UNION = " UNION ALL ".join([f"SELECT * FROM ({_PAGES})", *(f"SELECT '{source}', ({subject})::VARCHAR, rule_id, {passed}, weight FROM ({ORACLES[query]})" for source, query, subject, passed in AUDITS)])
_TOOLS = ", ".join(f"('{t.slug}', '{t.source}', '{p}')" for t in S.TOOLS if t.source for p in t.prefixes or ("",))


@register("flt_tool_view", f"SELECT tool, source, subject, rule_id, passed, weight FROM ({_UNION}) JOIN (VALUES {_TOOLS}) t(tool, k, prefix) ON source = k AND starts_with(rule_id, prefix)")
def flt_tool_view(spark, sf):
    """Findings of all audits by tool; tools that generate or ask a service show none."""
    columns = ["source", "subject", "rule_id", "passed", "weight"]
    parts = [_findings(spark, sf).filter(c("category").isin(*PAGE_SOURCES)).select(c("category").alias("source"), c("page_id").cast("string").alias("subject"), "rule_id", "passed", "weight")]
    for source, query, subject, passed in AUDITS:
        found = QUERIES[query](spark, sf).withColumns({"source": F.lit(source), "subject": F.expr(subject).cast("string"), "passed": F.expr(passed)})
        parts.append(found.select(columns))
    return S.tool_views(reduce(DataFrame.unionByName, parts))
