"""Queries against their DuckDB twins on the smallest tables. ALL_ORACLES=1 runs every pair."""

import collections
import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry
from crawlsight.sources.given import TABLES

SF = "/root/testdata/sf0.001"
QUICK = (
    "audit_seo audit_structured_data audit_geo ext_links ext_link_class audit_links_page ext_images audit_images url_normalize url_safe "
    "agg_category_card join_near_dup agg_keyword_density join_scan_diff prj_summary_text win_bfs_frontier join_redirect_chain agg_descendants "
    "audit_crawl_files audit_web_vitals audit_source_files audit_fix_integrity gen_jsonld str_event_router str_scan_compare "
    "ext_sections ext_form_fields audit_element_annotations fix_repaired_pages sink_json sink_markdown sink_scan_upsert merge_scan_stores src_project_files "
    "ext_findings_pos parse_fix_response audit_fix_rewrite set_missing_props agg_fix_bank_update src_events_ndjson str_rejected_events agg_page_snapshot "
    "gen_sitemap src_sitemap_files flt_issue_listing udf_row_rules agg_dup_groups topk_worst_files ext_robots"
).split()
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_ORACLES") else QUICK


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = collections.Counter(tuple(repr(norm(r[x])) for x in cols) for r in df.collect())
    res = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    theirs = collections.Counter(tuple(repr(norm(r[names.index(x)])) for x in cols) for r in res.fetchall())
    assert ours == theirs


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
