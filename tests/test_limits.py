"""Inputs beyond former limits, and rows that broke a query."""

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import markup as M
from crawlsight.functions import text as T
from crawlsight.functions import urls as U
from crawlsight.operators import extract as X
from crawlsight.operators import graph as GR
from crawlsight.operators import links as L
from crawlsight.operators import site_files as SF
from crawlsight.operators import source_code as SC


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_five_levels_of_graph(spark):
    inner = '{"@type": "Thing"}'
    for _ in range(5):
        inner = '{"@graph": [' + inner + "]}"
    page = f'<html><head><script type="application/ld+json">{inner}</script></head><body></body></html>'
    pages = spark.createDataFrame([(1, "https://a.example/", page)], "page_id long, url string, html string")
    assert [r["types"] for r in X.jsonld_nodes(pages).filter(F.size("types") > 0).collect()] == [["Thing"]]


def test_nested_navigation_goes(spark):
    html = "a" + "<nav>x" * 7 + "</nav>" * 7 + "b<nav>y</nav>c"
    assert one(spark, M.without(F.lit(html), "nav")) == "abc"


def test_a_deep_tree_and_a_cycle(spark):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "node long, parent long")
    assert {r["node"]: r["n_descendants"] for r in GR.descendants(tree).collect()} == {i: 69 - i for i in range(70)}
    with pytest.raises(ValueError):
        GR.descendants(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_all_children_of_a_sitemap_index(spark):
    locs = "".join(f"<sitemap><loc>https://a.example/{i}.xml</loc></sitemap>" for i in range(6)) + "<sitemap></sitemap>"
    row = ("a", "https://a.example", 200, "User-agent: *\nDisallow:", "text/plain", 200, f"<sitemapindex>{locs}</sitemapindex>")
    files = spark.createDataFrame([row], "site string, origin string, robots_status int, robots string, robots_type string, sitemap_status int, sitemap string")
    assert "sitemap-index-missing-loc" in {r["rule_id"] for r in SF.audit_crawl_files(files.withColumns({"llms": F.lit(None).cast("string"), "browser_status": F.lit(200), "bot_status": F.lit(200)}), spark.createDataFrame([], "url string, status int")).collect()}


def test_more_than_500_broken_links(spark):
    links = spark.range(600).select(
        F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/"), "id").alias("url"), F.lit(0).alias("pos"), F.lit("link").alias("kind"),
        F.concat(F.lit("https://a.example/x"), "id").alias("resolved_url"), F.lit(False).alias("is_external"), F.lit("t").alias("text"))
    status = links.select("resolved_url", F.lit(False).alias("ok"), F.lit(404).alias("status_code"), F.lit(None).cast("string").alias("error"))
    found = {r["rule_id"]: r["n"] for r in L.audit_links_site(links, status).collect()}
    assert found["broken-internal-links"] == 600


def files(spark, *contents, path="src/a.tsx"):
    return spark.createDataFrame([("p", path, x) for x in contents], "project string, path string, content string")


def test_every_match_has_a_place(spark):
    rows = SC.positions(files(spark, "console.log(" * 4100)).collect()
    assert [r["start"] for r in rows] == [12 * i for i in range(4100)]


def test_files_without_images_and_safe_secrets(spark):
    safe = 'const a = process.env.A, token = "aaaaaaaaaaaaaaaaaaaa";'
    rules = lambda *x: {r["rule_id"] for r in SC.audit_files(files(spark, *x)).collect()}
    assert rules("", "plain", safe) == set()
    assert rules(safe + " " * 50 + 'secret = "bbbbbbbbbbbbbbbbbbbb"') == {"secret-generic-secret"}
    assert rules('x = __MY_PLACEHOLDER__ token = "aaaaaaaaaaaaaaaaaaaa"') == set()


def test_folders_of_generated_files(spark):
    paths = ["vendor/a.js", "out/a.js", "x/.nuxt/a.js", ".svelte-kit/a.js", ".angular/a.js", "src/a.js"]
    df = spark.createDataFrame([("p", x, "") for x in paths], "project string, path string, content string")
    assert sorted(r["path"] for r in SC.kept_files(df).collect()) == ["src/a.js", "vendor/a.js"]


def test_fields_tables_and_icons(spark):
    rules = lambda x: {r["rule_id"] for r in SC.audit_files(files(spark, x)).collect()}
    assert rules('<label>n <input name="n"></label><input type="hidden"><input aria-label="a">') == set()
    assert rules('<input name="n">') == {"field-label"}
    assert rules("<table><tr><th>a</th></tr></table>") == set() and rules("<table><tr><td>a</td></tr></table><table><th></th></table>") == {"table-headers"}
    assert rules("<button><svg/></button>") == {"icon-only"} and rules('<button title="t"><svg/></button><button>x</button>') == set()


def test_native_components(spark):
    df = files(spark, '<img src="a"><a href="/x">x</a>', 'import I from "next/image"; <img src="a">')
    stacks = spark.createDataFrame([("p", "next")], "project string, stack string")
    assert sorted((r["rule_id"], r["n"]) for r in SC.native_components(df, stacks).collect()) == [("framework-image", 1), ("framework-link", 1)]


def test_hosts_that_are_numbers_in_brackets(spark):
    assert one(spark, U.resolve(F.lit("http://[::1]:8080/x"), F.lit("https://a.example/"))) == "http://[::1]:8080/x"
    assert one(spark, U.hostname(F.lit("http://[::1]/x"))) == "[::1]"
    assert one(spark, U.is_safe(F.lit("http://[::1]/x"))) is False and one(spark, U.is_safe(F.lit("http://[2001:db8::1]/x"))) is True


def test_numbers_of_any_length_in_references(spark):
    cases = {"&#65;&#x42;": "AB", "&#0000000000066;": "B", "&#128512;": "\U0001f600", "&#1114112;": "\ufffd", "&#55357;": "\ufffd", "&#99999999999999999999;": "\ufffd", "&#xFFFFFFFFFFFF;": "\ufffd", "&amp;&nosuchname;&": "&&nosuchname;&"}
    got = spark.createDataFrame(list(cases.items()), "a string, b string").select("b", T.decode_entities(F.col("a")).alias("x")).collect()
    assert [r["x"] for r in got] == [r["b"] for r in got]


def test_many_robots_groups_take_linear_time(spark):
    import time

    from crawlsight.operators import site_files as SI

    def run(n):
        text = "\n".join(f"User-agent: bot{i}\nDisallow: /{i}" for i in range(n))
        df = spark.createDataFrame([("s", "Allow: /early\n" + text)], "site string, robots string")
        began = time.time()
        rows = SI.robots_rows(df).collect()
        assert len(rows) == 2 * n and (rows[-1]["group_no"], rows[-1]["directive"], rows[-1]["value"]) == (n, "disallow", f"/{n - 1}")
        return time.time() - began

    run(10)
    assert run(20_000) < 15
