"""Crawl files of a site: robots.txt, sitemaps, llms.txt, crawler access, and other one-row-per-site inputs.

A file is parsed inside its row (its lines are one array), so a site never needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlsight.functions import urls as U
from crawlsight.functions.findings import Checks, explode_findings
from crawlsight.functions.text import let, trim_ws

c = F.col

# Crawlers of answer engines, robots directives, the tool's bots.
AI_AGENTS = (
    "gptbot chatgpt-user oai-searchbot google-extended perplexitybot perplexity-user claudebot claude-web anthropic-ai ccbot "
    "bytespider amazonbot applebot-extended meta-externalagent"
).split()
TOOL_BOTS = ("gptbot", "claudebot", "perplexitybot", "google-extended", "ccbot", "anthropic-ai", "oai-searchbot")
DIRECTIVES = ("user-agent", "disallow", "allow", "sitemap", "crawl-delay", "host", "clean-param")
LASTMOD = r"^\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?$"


def robots_lines(text: Column) -> Column:
    """Directive lines as (directive, value); comments are cut."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: trim_ws(F.substring_index(x, "#", 1)))
    return F.transform(
        F.filter(lines, lambda x: F.instr(x, ":") > 1),
        lambda x: F.struct(
            F.lower(F.trim(F.substring_index(x, ":", 1))).alias("directive"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"), x.alias("line")))


def _with_groups(lines: Column, shared: bool = True) -> Column:
    """Each line with its group number: a user-agent line opens a group unless it follows another one.

    The lines are strung together with a mark in front of each group and cut at the marks: a line's group is the number
    of its piece, and the work is linear in the lines.
    """
    group, row, cell = "\x1d", "\x1e", "\x1f"
    clean = lambda x: F.translate(x, group + row + cell, "")

    def numbered(ls: Column) -> Column:
        known = F.filter(ls, lambda x: x["directive"] != "sitemap") if not shared else ls
        opens = lambda a, i: (a["directive"] == "user-agent") & (
            F.lit(not shared) | (i == 0) | (F.get(known, i - 1)["directive"] != "user-agent"))
        marked = F.transform(known, lambda a, i: F.concat(F.when(opens(a, i), group).otherwise(""), clean(a["directive"]), F.lit(cell), clean(a["value"])))
        rows = lambda g, k: F.transform(
            F.filter(F.split(g, row), lambda x: x != ""),
            lambda x: F.struct(F.substring_index(x, cell, 1).alias("directive"), F.substring_index(x, cell, -1).alias("value"), k.alias("group_no")))
        return F.flatten(F.transform(F.split(F.array_join(marked, row), group), rows))

    return let(lines, numbered)


def robots_rows(files: DataFrame) -> DataFrame:
    """``ext_robots``: one row per rule line of a group and per agent line."""
    return files.select("site", F.inline_outer(_with_groups(robots_lines(c("robots"))))).filter(c("group_no") > 0).select(
        "site", c("group_no").cast("long").alias("group_no"), "directive",
        F.when(c("directive") == "user-agent", F.lower("value")).otherwise(c("value")).alias("value"))


def robots_groups(files: DataFrame) -> DataFrame:
    """``win_robots_group``: the same rows by a running count over a site's lines."""
    lines = files.select("site", F.posexplode(robots_lines(c("robots"))).alias("pos", "x")).select("site", "pos", "x.directive", "x.value")
    w = Window.partitionBy("site").orderBy("pos")  # the lines of one file
    opens = (c("directive") == "user-agent") & (F.coalesce(F.lag("directive").over(w), F.lit("")) != "user-agent")
    numbered = lines.withColumn("opens", opens.cast("long")).withColumn("group_no", F.sum("opens").over(w)).filter(c("group_no") > 0)
    return numbered.select("site", "group_no", "directive", F.when(c("directive") == "user-agent", F.lower("value")).otherwise(c("value")).alias("value"))


def robots_sitemaps(files: DataFrame) -> DataFrame:
    """``ext_robots_sitemaps``"""
    found = F.filter(robots_lines(c("robots")), lambda x: (x["directive"] == "sitemap") & (x["value"] != ""))
    return files.select("site", "origin", F.explode(found).alias("s")).select("site", U.resolve(c("s.value"), c("origin")).alias("sitemap_url"))


def robots_malformed(files: DataFrame) -> DataFrame:
    """``ext_robots_malformed``"""
    bad = F.filter(robots_lines(c("robots")), lambda x: ~x["directive"].isin(*DIRECTIVES))
    return files.select("site", F.explode(bad).alias("s")).select("site", c("s.line").alias("line"))


def _blocked(lines: Column, agent: str) -> Column:
    """The first group naming the agent disallows everything."""
    mine = F.get(F.filter(lines, lambda x: (x["directive"] == "user-agent") & (F.lower(x["value"]) == agent)), F.lit(0))["group_no"]
    return F.coalesce(
        F.exists(lines, lambda x: (x["group_no"] == mine) & (x["directive"] == "disallow") & x["value"].isin("/", "/*")), F.lit(False))


def sitemap_entries(xml: Column) -> Column:
    """Entries of a urlset as (loc, lastmod), '' when missing."""
    part = lambda e, name: F.trim(F.regexp_extract(e, rf"(?is)<{name}>(.*?)</{name}>", 1))
    return F.transform(
        F.regexp_extract_all(xml, F.lit(r"(?is)<url>.*?</url>"), F.lit(0)),
        lambda e: F.struct(part(e, "loc").alias("loc"), part(e, "lastmod").alias("lastmod")))


def sitemap_rows(files: DataFrame) -> DataFrame:
    """``ext_sitemap``"""
    return files.select("site", F.posexplode(sitemap_entries(c("sitemap"))).alias("pos", "e")).select("site", "pos", "e.loc", "e.lastmod")


def with_features(files: DataFrame) -> DataFrame:
    f = files.select(
        "*", _with_groups(robots_lines(c("robots"))).alias("lines"), robots_lines(c("robots")).alias("raw"),
        sitemap_entries(c("sitemap")).alias("entries"),
        F.lower(F.regexp_extract(c("sitemap"), r"(?is)^\s*(?:<\?.*?\?>\s*)*<([a-z]+)", 1)).alias("root"),
        F.transform(F.regexp_extract_all(c("sitemap"), F.lit(r"(?is)<sitemap>.*?</sitemap>"), F.lit(0)),
                    lambda e: F.trim(F.regexp_extract(e, "(?is)<loc>(.*?)</loc>", 1))).alias("children"))
    good = F.filter(F.transform("entries", lambda e: e["loc"]), U.is_http)
    return f.withColumns({
        "ok_robots": c("robots_status").between(200, 299) & (trim_ws(c("robots")) != ""),
        "n_groups": F.coalesce(F.array_max(F.transform("lines", lambda x: x["group_no"])), F.lit(0)),
        "n_sitemaps": F.size(F.filter("raw", lambda x: x["directive"] == "sitemap")),
        "n_malformed": F.size(F.filter("raw", lambda x: ~x["directive"].isin(*DIRECTIVES))),
        "locs": F.array_distinct(good), "n_good": F.size(good),
        "n_off": F.size(F.filter(good, lambda u: U.hostname(u) != U.hostname(c("origin")))),
        "n_no_loc": F.size(F.filter("entries", lambda e: e["loc"] == "")),
        "n_bad_loc": F.size(F.filter("entries", lambda e: (e["loc"] != "") & ~U.is_http(e["loc"]))),
        "n_bad_lastmod": F.size(F.filter("entries", lambda e: U.is_http(e["loc"]) & (e["lastmod"] != "") & ~e["lastmod"].rlike(LASTMOD))),
        "n_blocked": sum((_blocked(c("lines"), a).cast("int") for a in AI_AGENTS), F.lit(0)),
    })


def with_reach(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """``files`` with n_unreachable: the sitemaps that a site's index lists and that ``fetched`` (url, status) has no good
    answer for."""
    children = F.transform(F.regexp_extract_all(c("sitemap"), F.lit(r"(?is)<sitemap>.*?</sitemap>"), F.lit(0)), lambda e: F.trim(F.regexp_extract(e, "(?is)<loc>(.*?)</loc>", 1)))
    asked = files.select("site", F.explode(F.filter(children, U.is_http)).alias("url"))
    lost = asked.join(fetched.groupBy("url").agg(F.max("status").alias("status")), "url", "left").filter(~F.coalesce(c("status").between(200, 299), F.lit(False)))
    return files.join(lost.groupBy("site").agg(F.count(F.lit(1)).alias("n_unreachable")), "site", "left")


def audit_crawl_files(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """``audit_crawl_files``: robots.txt and sitemap findings per site. A null status is a fetch that failed.

    ``fetched`` (url, status) are the answers for the sitemaps that indexes list.
    """
    k = Checks("crawl")
    files = with_reach(files, fetched)
    st, ok = c("robots_status"), c("ok_robots")
    k.issue("robots-fetch", 7, st.isNull()).issue("sitemap-fetch", 10, c("sitemap_status").isNull())
    k.issue("robots-missing", 6, st == 404)
    k.issue("robots-error", 8, (st != 404) & ~st.between(200, 299))
    k.issue("robots-empty", 5, st.between(200, 299) & (trim_ws(c("robots")) == ""))
    k.issue("robots-no-groups", 7, ok & (c("n_groups") == 0)).ok("robots-present", ok & (c("n_groups") > 0))
    k.issue("robots-disallow-all", 15, ok & _blocked(c("lines"), "*"))
    k.issue("robots-no-sitemap", 6, ok & (c("n_sitemaps") == 0)).ok("robots-sitemap-declared", ok & (c("n_sitemaps") > 0))
    k.issue("robots-malformed", 4, ok & (c("n_malformed") > 0))
    k.issue("robots-content-type", 3, ok & (c("robots_type") != "") & ~c("robots_type").rlike("(?i)text/plain|text/html|application/octet-stream"))
    up = c("sitemap_status").between(200, 299)
    k.issue("sitemap-missing", 8, (c("n_sitemaps") == 0) & ~up)
    k.issue("sitemap-http", 10, (c("n_sitemaps") > 0) & ~up)
    xml = up & F.trim("sitemap").startswith("<")
    k.issue("sitemap-not-xml", 10, up & ~F.trim("sitemap").startswith("<"))
    k.issue("sitemap-root", 10, xml & ~c("root").isin("urlset", "sitemapindex"))
    urlset = xml & (c("root") == "urlset")
    listed = urlset & (F.size("entries") > 0)
    k.issue("sitemap-empty", 10, urlset & (F.size("entries") == 0))
    problems = [
        ("sitemap-missing-loc", 9, c("n_no_loc") > 0), ("sitemap-invalid-loc", 8, c("n_bad_loc") > 0),
        ("sitemap-duplicates", 5, c("n_good") > F.size("locs")),
        ("sitemap-off-domain", 7, (c("n_off") > 0) & (c("n_off") == F.size("locs"))),
        ("sitemap-mixed-domain", 4, (c("n_off") > 0) & (c("n_off") != F.size("locs"))),
        ("sitemap-lastmod", 4, c("n_bad_lastmod") > 0), ("sitemap-size", 8, F.size("entries") > 50000),
    ]
    some = F.lit(False)
    for rule, weight, cond in problems:
        k.issue(rule, weight, listed & cond)
        some = some | cond
    k.ok("sitemap-valid", listed & ~some)
    index = xml & (c("root") == "sitemapindex")
    no_loc, bad = F.exists("children", lambda u: u == ""), F.exists("children", lambda u: (u != "") & ~U.is_http(u))
    k.issue("sitemap-index-empty", 9, index & (F.size("children") == 0))
    k.issue("sitemap-index-missing-loc", 8, index & no_loc).issue("sitemap-index-invalid-loc", 7, index & bad)
    lost = F.coalesce(c("n_unreachable") > 0, F.lit(False))
    k.issue("sitemap-index-unreachable", 7, index & lost)
    k.issue("sitemap-index-size", 8, index & (F.size("children") > 50000))
    k.ok("sitemap-index-valid", index & F.size("children").between(1, 50000) & ~no_loc & ~bad & ~lost)
    k.issue("sitemap-file-size", 7, xml & (F.octet_length("sitemap") > 50 * 1024 * 1024))
    return explode_findings(with_features(files), ["site"], k.column())


def audit_aeo_site(files: DataFrame) -> DataFrame:
    """``audit_aeo_site``: own groups of AI crawlers, llms.txt, browser against bot fetch."""
    k = Checks("aeo")
    up = c("robots_status").between(200, 299)
    k.issue("aeo-ai-crawlers-blocked", 12, up & (c("n_blocked") > 0), n=c("n_blocked")).ok("aeo-ai-crawlers", up & (c("n_blocked") == 0))
    has_llms = F.coalesce(trim_ws(c("llms")) != "", F.lit(False))
    k.ok("aeo-llms-txt", has_llms).issue("aeo-llms-txt-missing", 3, ~has_llms)
    lost = c("browser_status").isNotNull() & c("bot_status").isNull()
    walled = (c("browser_status") < 400) & (c("bot_status") >= 400)
    k.issue("aeo-ai-crawler-network-block", 10, lost).issue("aeo-ai-crawler-firewall-block", 10, ~lost & walled)
    k.ok("aeo-ai-crawler-firewall", c("browser_status").isNotNull() & ~lost & ~F.coalesce(walled, F.lit(False)))
    return explode_findings(with_features(files), ["site"], k.column())


def audit_robots_tool(files: DataFrame) -> DataFrame:
    """``audit_robots_tool``: here every agent line is its own group and the wildcard group counts."""
    f = files.select("*", _with_groups(robots_lines(c("robots")), shared=False).alias("lines"), robots_lines(c("robots")).alias("raw"))
    k = Checks("robots")
    st = c("robots_status")
    there = st != 404
    k.issue("robots-fetch-error", 10, st.isNull())
    k.issue("robots-missing", 3, ~there, severity="low")
    k.issue("robots-error-status", 6, there & (st >= 400)).ok("robots-reachable", st < 400)
    declared = F.exists("raw", lambda x: x["directive"] == "sitemap")
    k.issue("robots-no-sitemap", 2, there & ~declared, severity="low").ok("robots-sitemap-ref", there & declared)

    def blocks(agent: str) -> Column:
        mine = F.get(F.filter("lines", lambda x: (x["directive"] == "user-agent") & (F.lower(x["value"]) == agent)), F.lit(0))["group_no"]
        return F.when(mine.isNotNull(), F.exists("lines", lambda x: (x["group_no"] == mine) & (x["directive"] == "disallow") & (x["value"] == "/")))

    for bot in TOOL_BOTS:
        bad = F.coalesce(blocks(bot), blocks("*"), F.lit(False))
        k.issue(f"ai-bot-blocked-{bot}", 4, there & bad, severity="medium").ok(f"ai-bot-allowed-{bot}", there & ~bad)
    return explode_findings(f, ["site"], k.column())


def audit_sitemap_tool(files: DataFrame) -> DataFrame:
    """``audit_sitemap_tool``"""
    k = Checks("sitemap")
    up = c("sitemap_status") < 400
    index, known = c("sitemap").rlike("(?i)<sitemapindex"), c("sitemap").rlike("(?i)<urlset|<sitemapindex")
    n = F.regexp_count("sitemap", F.lit("(?i)<loc>[^<]+</loc>"))
    mods = F.regexp_count("sitemap", F.lit("(?i)<lastmod>"))
    k.issue("sitemap-fetch-error", 12, c("sitemap_status").isNull()).issue("sitemap-error-status", 12, ~up)
    k.issue("sitemap-not-xml", 12, up & ~known).ok("sitemap-valid-xml", up & known)
    k.issue("sitemap-empty", 8, up & (n == 0) & ~index).ok("sitemap-url-count", up & (n > 0))
    k.issue("sitemap-no-lastmod", 2, up & ~index & (n > 0) & (mods == 0), severity="low").ok("sitemap-has-lastmod", up & (mods > 0))
    k.issue("sitemap-too-large", 6, up & (n > 50000))
    return explode_findings(files, ["site"], k.column())


def ua_status(files: DataFrame) -> DataFrame:
    """``join_ua_status``: the same URL fetched as a browser and as a bot, from one fetch log."""
    log = files.select(
        c("origin").alias("url"), F.explode(F.array(
            F.struct(F.lit("browser").alias("agent"), c("browser_status").alias("status")),
            F.struct(F.lit("bot").alias("agent"), c("bot_status").alias("status")))).alias("l")).select("url", "l.agent", "l.status")
    browser = log.filter((c("agent") == "browser") & c("status").isNotNull()).select("url", c("status").alias("browser_status"))
    bot = log.filter((c("agent") == "bot") & c("status").isNotNull()).select("url", c("status").alias("bot_status"))
    return browser.join(bot, "url", "left").withColumn(
        "access", F.when(c("bot_status").isNull(), "unreachable").when((c("browser_status") < 400) & (c("bot_status") >= 400), "blocked").otherwise("open"))


# --- page speed, rendering, icons -----------------------------------------------------------------------

_METRIC = "struct<percentile:double,category:string>"
_EXP = f"struct<overall_category:string,metrics:map<string,{_METRIC}>>"
PSI = f"struct<loadingExperience:{_EXP},originLoadingExperience:{_EXP},lighthouseResult:struct<categories:struct<performance:struct<score:double>>,audits:map<string,struct<numericValue:double>>>>"


def web_vitals(responses: DataFrame) -> DataFrame:
    """``src_web_vitals``: field data of the page, else of the origin; lab data beside it."""
    p = responses.withColumn("r", F.from_json("body", PSI))
    page, site = c("r.loadingExperience"), c("r.originLoadingExperience")
    exp = F.when(page["metrics"].isNotNull(), page).when(site["metrics"].isNotNull(), site)
    m = lambda name: F.try_element_at(exp["metrics"], F.lit(name))
    rating = lambda x: F.when(x["category"].isin("FAST", "GOOD"), "good").when(x["category"].isin("SLOW", "POOR"), "poor").when(x.isNotNull(), "needs-improvement")
    lcp, inp, cls = m("LARGEST_CONTENTFUL_PAINT_MS"), m("INTERACTION_TO_NEXT_PAINT"), m("CUMULATIVE_LAYOUT_SHIFT_SCORE")
    lab = lambda name: F.try_element_at(c("r.lighthouseResult.audits"), F.lit(name))["numericValue"]
    return p.select(
        "id", page["metrics"].isNotNull().alias("is_page_level"), lcp["percentile"].alias("lcp"), rating(lcp).alias("lcp_rating"),
        inp["percentile"].alias("inp"), rating(inp).alias("inp_rating"), (cls["percentile"] / 100).alias("cls"), rating(cls).alias("cls_rating"),
        F.round(F.coalesce(c("r.lighthouseResult.categories.performance.score"), F.lit(0.0)) * 100).cast("int").alias("performance"),
        lab("largest-contentful-paint").alias("lab_lcp"), lab("cumulative-layout-shift").alias("lab_cls"), lab("total-blocking-time").alias("lab_tbt"))


def rate(value: Column, good: float, poor: float) -> Column:
    """``prj_cwv_rating``"""
    return F.when(value <= good, "good").when(value <= poor, "needs-improvement").when(value.isNotNull(), "poor")


def audit_web_vitals(vitals: DataFrame) -> DataFrame:
    k = Checks("speed")
    lcp = F.coalesce("lcp_rating", rate(c("lab_lcp"), 2500, 4000))
    cls = F.coalesce("cls_rating", rate(c("lab_cls"), 0.1, 0.25))
    tbt = F.when(c("inp").isNull(), rate(c("lab_tbt"), 200, 600))
    for rule, r, bad, mild in (("cwv-lcp", lcp, 14, 8), ("cwv-inp", c("inp_rating"), 14, 8), ("cwv-tbt", tbt, 10, 6), ("cwv-cls", cls, 12, 7)):
        k.issue(rule, F.when(r == "poor", bad).otherwise(mild), r.isin("poor", "needs-improvement")).ok(rule, r == "good")
    return explode_findings(vitals, ["id"], k.column())


def audit_js_rendering(renders: DataFrame) -> DataFrame:
    k = Checks("jsRendering")
    k.either("js-render-timeout", 4, c("timed_out"), n=c("render_ms")).either("js-render-errors", 3, c("n_errors") > 0, n=c("n_errors"))
    return explode_findings(renders, ["page_id"], k.column())


def audit_favicon(features: DataFrame, manifests: DataFrame) -> DataFrame:
    """``audit_favicon``: icon link, manifest link, and the four fields an installable manifest has.

    ``manifests`` is (page_id, body); a linked manifest without a row could not be fetched.
    """
    f = features.select("page_id", "has_icon_link", "manifest_href").join(manifests, "page_id", "left")
    linked = c("manifest_href").isNotNull()
    readable = F.try_parse_json("body").isNotNull()
    missing = sum((F.coalesce(F.get_json_object("body", f"$.{x}"), F.lit("")).isin("", "null", "false", "0").cast("int") for x in ("name", "icons", "start_url", "display")), F.lit(0))
    k = Checks("favicon")
    k.either("favicon-missing-link", 3, ~c("has_icon_link"), "favicon-link-present", severity="low")
    k.issue("manifest-missing", 2, ~linked, severity="low").ok("manifest-linked", linked)
    k.issue("manifest-fetch-error", 3, linked & ~readable, severity="low")
    k.issue("manifest-missing-fields", 3, linked & readable & (missing > 0), n=missing, severity="low").ok("manifest-valid", linked & readable & (missing == 0))
    return explode_findings(f, ["page_id"], k.column())


def read_sitemap_files(spark: SparkSession, folder: str, tag: str = "url") -> DataFrame:
    """``ext_sitemap`` of landed files of any size: loc and lastmod of every ``url`` (of an index: ``sitemap``) entry.

    A file is read as a stream of its entries, so that no expression runs over all of it and memory is that of an entry;
    the protocol keeps a file at 50,000 of them, and files are read side by side. Names of other vocabularies inside an
    entry are passed over, CDATA is text, an entry that is no XML has neither field. Folders named by partition values give those as columns.
    """
    read = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True).option("recursiveFileLookup", False)
    return read.schema("loc string, lastmod string").load(folder)
