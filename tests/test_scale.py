"""Work is dealt over the tasks however the files hold their rows, is done once, and is done for every row."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from crawlsight.functions import text as T
from crawlsight.functions.findings import Checks
from crawlsight.operators import extract as X
from crawlsight.operators import page_rules as R
from crawlsight.operators import stack as ST
from crawlsight.plans import registry_rest as RR
from crawlsight.sources import given as G
from crawlsight.streaming import jobs as J


@pytest.fixture
def one_row_group(spark, tmp_path):
    """Pages and parts in a row group each, in files of more splits than there are cores."""
    part = spark.range(0, 4000, numPartitions=1).selectExpr(
        "id as p_partkey", "concat('part ', md5(cast(id as string))) as p_name", "concat('Brand#', id % 5) as p_brand",
        "element_at(array('STANDARD','PROMO','SMALL','LARGE','MEDIUM','ECONOMY'), cast(id % 6 as int) + 1) as p_type", "cast(id % 50 + 1 as int) as p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    pages = spark.range(0, 4000, numPartitions=1).selectExpr(
        "id as page_id", "concat('https://a.example/', id) as url", "concat('<html><head><title>', md5(cast(id as string)), '</title></head><body><h1>x</h1></body></html>') as html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    small = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "1024"}
    old = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield str(tmp_path)
    for k, v in old.items():
        spark.conf.set(k, v)


def test_no_task_gets_all_pages(spark, one_row_group):
    cores = spark.sparkContext.defaultParallelism
    scan = G.table(spark, one_row_group, "part")
    assert scan.rdd.getNumPartitions() > cores and scan.groupBy(F.spark_partition_id()).count().count() == 1
    shares = G.audit_pages(spark, one_row_group).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in shares) == 8000 and max(r["count"] for r in shares) <= 2 * 4000 / cores


def below_dealing(df):
    """The parts of an optimized plan that run before rows are dealt."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(re.match(r"[ :+-]*", line)[0]) for line in lines]
    dealings = [i for i, line in enumerate(lines) if "Repartition" in line]
    assert dealings
    return ["\n".join(itertools.takewhile(bool, (lines[k] if depth[k] > depth[i] else "" for k in range(i + 1, len(lines))))) for i in dealings]


def test_pages_are_not_made_or_searched_before_they_are_dealt(spark, one_row_group):
    """``ext_images``, and any filter on the pages: below the dealing one task would make every page to test it."""
    rows = entry.queries()["ext_images"](spark, one_row_group)
    for plan in below_dealing(rows) + below_dealing(G.audit_pages(spark, one_row_group).filter("html like '%<img%'").filter("page_id >= 1000000000")):
        assert "<main>" not in plan
    assert not [plan for plan in below_dealing(rows) if "<img" in plan]
    assert rows.count() > 4000


def test_batches_of_pages_are_dealt(spark, one_row_group):
    tasks = RR._page_stream(spark, one_row_group).select("page_id", F.spark_partition_id().alias("task"))
    rows = J.append_to_table(tasks, J.work_folder(spark))
    assert rows.count() == 4000 and rows.select("task").distinct().count() > 1


@pytest.mark.parametrize("name", ["audit_images", "join_image_status", "join_link_status", "audit_links_site", "audit_duplicates"])
def test_pages_are_read_for_links_images_and_heads_once(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"<img|<picture|<\(a\)|<title", plan)


def test_link_findings_read_the_links_of_a_page_once(spark):
    plan = entry.queries()["audit_links_page"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "<(a)" not in plan and "noopener" not in plan.replace("missing_noopener", "").replace("missing-rel-noopener", "").replace("n_noopener", "")


def test_every_event_is_read_from_the_lines(spark, tmp_path):
    rows = [(i, "click", json.dumps({"k": i * 2})) for i in range(40)] + [(100, None, None)]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r.event_id, r.k) for r in entry.queries()["src_events_ndjson"](spark, str(tmp_path)).collect())
    assert got == [(i, i * 2) for i in range(40)] + [(100, None)]


def test_page_rules_do_no_work_twice(spark):
    pages = spark.createDataFrame([(1, "https://a.example/", "<body><h2>a</h2><p>b c</p><h2>d</h2></body>")], "page_id long, url string, html string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    words = plan(pages.select(X.section_words(F.col("html")).alias("words")))
    assert words.count("figcaption") == 2  # a block's start and its end, each tried once a token
    marks = plan(X.page_features(pages).select("has_trust", "has_contact", "app_shell"))
    assert marks.count("lower(html") <= 2  # one for the marks, one for what is taken out of the page
    assert "filter(" not in plan(pages.select(Checks("seo").issue("a", 1, F.col("page_id") > 0).ok("b", F.col("page_id").isNull()).column()))
    got = pages.select(F.inline(Checks("seo").issue("a", 1, F.col("page_id") > 0).ok("b", F.lit(None).cast("boolean")).column())).collect()
    assert [(r.rule_id, r.passed) for r in got] == [("a", False)]


def test_signals_try_a_pattern_only_where_its_text_stands(spark):
    """``audit_stack``: every alternative of every pattern is still found in either case, and patterns stand behind plain searches."""
    texts = {
        "WordPress": "wp-content|wp-includes|wp-json", "Drupal": "Drupal.settings|drupal.js|/sites/default/files", "Joomla": "/media/jui/|Joomla!",
        "Wix": "static.wixstatic.com|wix-code|X-Wix-", "Squarespace": "static1.squarespace.com|squarespace-cdn.com|Squarespace.SQUARESPACE_ROLLUPS",
        "Webflow": "data-wf-site|data-wf-page|webflow.com", "Shopify": "cdn.shopify.com|Shopify.theme|/cdn/shop/",
        "BigCommerce": "cdn11.bigcommerce.com|bigcommerce.com/s-", "Magento": "Mage.Cookies|/skin/frontend/|Magento_", "WooCommerce": "woocommerce",
        "Next.js": "__NEXT_DATA__|/_next/static/", "Nuxt": "__NUXT__|/_nuxt/", "Gatsby": "___gatsby|/page-data/",
        "SvelteKit": "__sveltekit|/_app/immutable/", "Angular": '<b ng-version="1">', "Astro": "astro-island|data-astro-cid",
        "Remix": "__remixContext|/build/entry.client", "React": "data-reactroot|data-reactid|react-dom", "Vue": "data-v-0a1b2c|__VUE__|vue.global.js",
        "ASP.NET": "__VIEWSTATE", "jQuery": "jquery.js|jquery.min.js", "Bootstrap": "bootstrap.css|bootstrap.min.js",
        "Tailwind CSS": "tailwindcss|tailwind.min.css", "Elementor": "elementor",
    }
    assert set(texts) == {s[0] for s in ST.SIGNALS if s[3]}
    cases = [(name, case(text)) for name, row in texts.items() for text in row.split("|") for case in (str, str.upper, str.lower)]
    cases += [("WordPress", '<meta name="generator" content="WORDPRESS 6">'), (None, "wordpress react nuxt tailwind drupal"), (None, None)]
    pages = spark.createDataFrame(
        [(i, "s", 0, "https://s/", html and f"<p>{html}</p>", {}) for i, (_, html) in enumerate(cases)],
        "page_id long, site string, depth int, url string, html string, headers map<string,string>")
    found = pages.select("page_id", F.col("html").alias("h"), "headers", "html").withColumn("low", F.lower("html")).select("page_id", ST._signals()["name"].alias("names"))
    got = {r.page_id: r.names for r in found.collect()}
    for i, (name, html) in enumerate(cases):
        assert name in got[i] if name else not got[i], (name, html, got[i])
    assert ST.detect(pages).filter("n_signals = 0").count() == 2
    plan = ST.detect(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"lower\(html", plan)) == 1


def test_the_rules_of_a_union_of_pages_are_one_projection(spark):
    """A projection on a union would be planned, compiled and warmed up once a branch."""
    pages = spark.createDataFrame([(1, "https://a.example/", "<p>b</p>")], "page_id long, url string, html string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    speed = lambda df: plan(R.audit(df, "speed")).count("render-blocking-js")
    assert speed(pages.union(pages)) == speed(pages)


def test_a_json_ld_node_is_asked_once_for_each_thing(spark):
    """Conditions, weights and severities of a node's checks read one value."""
    plan = R._node_checks(F.col("node"), F.col("t"))._jc.toString()
    assert all(plan.count(name) == 4 for name in ("itemListElement", "mainEntity", "potentialAction"))  # parsed once; as_array names its text four times
    crumbs = '[{"@type":"ListItem"},{"@type":"ListItem","position":2,"name":"x","item":"https://a.example/"}]'
    nodes = [("BreadcrumbList", {"itemListElement": crumbs}), ("Person", {}), ("WebSite", {"name": "a", "url": "b"}), ("Offer", {}), ("Product", {"name": "p"})]
    df = spark.createDataFrame(nodes, "t string, node map<string,string>").select("t", F.explode_outer(R._node_checks(F.col("node"), F.col("t"))).alias("f"))
    got = {}
    for r in df.collect():
        got.setdefault(r.t, []).append(r.f and (r.f.rule_id, r.f.weight, r.f.severity, r.f.n, r.f.info))
    assert got == {
        "BreadcrumbList": [("schema-breadcrumb-invalid", 8, "medium", 3, None)], "Person": [("schema-person-required", 5, "medium", 1, "name")],
        "WebSite": [("schema-website", 0, "good", None, None), ("schema-searchaction-missing", 4, "low", None, None)], "Offer": [None],
        "Product": [("schema-product", 0, "good", None, None), ("schema-product-offers", 6, "medium", None, None), ("schema-product-image", 3, "low", None, None)],
    }


def test_fixed_findings_reach_the_plan_in_one_piece(spark):
    row = Checks("seo").issue("a'b\\", 9, F.lit(True), n=3, info="x").ok("c", F.lit(True)).issue("d", F.lit(2), F.lit(True), severity="high").column()
    assert [tuple(r) for r in spark.range(1).select(F.inline(row)).collect()] == [
        ("seo", "a'b\\", False, 9, "high", 3, "x"), ("seo", "c", True, 0, "good", None, None), ("seo", "d", False, 2, "high", None, None)]
    assert "cast(" not in str(Checks("seo")._struct("a", True, 0, "good", None, None)).lower().replace("named_struct(", "").split("category")[0]


def test_spaces_and_sections_read_as_before(spark):
    old = "[\\s\\u000b\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
    every = spark.range(1, 0xD800).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("ch"))
    assert every.filter(F.col("ch").rlike(f"^{old}$") != F.col("ch").rlike(f"^{T.WS_CLASS}$")).count() == 0
    texts = ["", " ", "  a", "a \t\n", "　a   b﻿ ", "a", "a\n", "  a  b  "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    was = F.regexp_replace("t", f"^{old}++|(?<!{old}){old}++$", "")
    assert df.filter(T.trim_ws(F.col("t")) != was).count() == 0
    body = "<main><H2>a</H2><P>one two<DIV >three</DIV><br><p-x>four</p-x><hr/><scripty>five</scripty></ p>six<!-- no --></main>seven<h3>b</h3><p>x</p></p >y"
    got = spark.createDataFrame([(body,)], "b string").select(X.section_words(F.col("b")).alias("w")).first().w
    assert got == [5, 1]
