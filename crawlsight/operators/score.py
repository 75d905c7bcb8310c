"""Scores and report rows.

A page's category scores come from the findings array inside its row, so the only shuffles are the
site roll-ups, whose keys are (category, rule): partial aggregation leaves at most a few hundred
rows per task whatever the size of the crawl.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions.findings import severity_rank
from crawlsight.operators.page_rules import PAGE_CATEGORIES

c = F.col

# Label of each report category.
LABELS = {"seo": "SEO", "aeo": "AEO", "geo": "GEO", "speed": "Performance", "a11y": "Accessibility", "conversions": "Conversions"}


class Tool(NamedTuple):
    slug: str
    engine: str
    source: str | None = None
    prefixes: tuple[str, ...] = ()


# Every tool, what runs it, the audit it shows and the rule prefixes it shows of that (none: all).
TOOLS = [
    Tool("meta-tag-checker", "audit", "seo", ("title", "meta-desc", "meta-charset", "canonical", "og-", "twitter")),
    Tool("meta-tag-generator", "generator"),
    Tool("schema-markup-generator", "generator"),
    Tool("structured-data-checker", "audit", "structured"),
    Tool("robots-txt-checker", "audit", "robots"),
    Tool("robots-txt-generator", "generator"),
    Tool("sitemap-checker", "audit", "sitemap"),
    Tool("sitemap-generator", "generator"),
    Tool("broken-link-checker", "audit", "links"),
    Tool("indexability-checker", "audit", "seo", ("noindex", "canonical")),
    Tool("redirect-status-checker", "audit", "redirect"),
    Tool("heading-structure-checker", "audit", "seo", ("h1-", "heading-order")),
    Tool("content-seo-checker", "audit", "seo", ("thin-content", "above-fold", "trust", "cta-clarity", "contact-path", "form-length", "url-structure")),
    Tool("duplicate-content-checker", "audit", "duplicate"),
    Tool("image-alt-text-checker", "audit", "seo", ("alt-text", "decorative-alt", "lazy-loading")),
    Tool("image-optimization-checker", "audit", "images"),
    Tool("url-slug-generator", "generator"),
    Tool("hreflang-checker", "audit", "seo", ("hreflang",)),
    Tool("hreflang-generator", "generator"),
    Tool("speed-signals-checker", "audit", "speed"),
    Tool("core-web-vitals-checker", "pagespeed"),
    Tool("security-headers-checker", "audit", "security"),
    Tool("security-headers-generator", "generator"),
    Tool("accessibility-checker", "audit", "a11y"),
    Tool("mobile-friendly-checker", "audit", "seo", ("mobile-viewport", "zoom-disabled")),
    Tool("tech-stack-detector", "audit", "stack"),
    Tool("favicon-pwa-checker", "audit", "favicon"),
    Tool("ai-discoverability-checker", "audit", "geo"),
    Tool("ai-citation-readiness-checker", "audit", "aeo"),
    Tool("ai-crawler-access-checker", "audit", "aeo", ("aeo-ai-crawler",)),
    Tool("llms-txt-generator", "ai"),
    Tool("ai-seo-fix-generator", "ai"),
]


def label(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in LABELS.items():
        out = F.when(category == k, v).otherwise(out)
    return F.coalesce(out, category)


def clamp(score: Column, top: int) -> Column:
    return F.greatest(F.lit(20), F.least(F.lit(top), score))


def page_category_scores(audited: DataFrame, top: int = 100) -> DataFrame:
    """``agg_page_category_score`` / ``agg_tool_score`` (top=99): 100 minus the weights, from the page's own row."""

    def score_of(category: str) -> Column:
        own = F.filter("findings", lambda f: f["category"] == category)
        return clamp(F.lit(100) - F.aggregate(own, F.lit(0), lambda a, f: a + f["weight"]), top)

    per = F.array(*[F.struct(F.lit(k).alias("category"), score_of(k).alias("score")) for k in PAGE_CATEGORIES])
    return audited.select("page_id", "url", "depth", F.inline_outer(per))


def page_scores(category_scores: DataFrame) -> DataFrame:
    """``agg_page_score``: rounded mean of the categories that ran, 50 when none did."""
    return category_scores.groupBy("page_id", "url").agg(F.coalesce(F.round(F.avg("score")), F.lit(50)).cast("int").alias("score"))


def category_scores(category_scores_df: DataFrame) -> DataFrame:
    return category_scores_df.groupBy("category").agg(
        clamp(F.round(F.avg("score")).cast("int"), 100).alias("score"), F.count(F.lit(1)).alias("pages_analyzed"))


def card_issues(findings: DataFrame) -> DataFrame:
    """Issues of a card: one row per rule. The first page by (depth, url) supplies weight and severity;
    a rule found twice on one page counts twice in ``n_affected`` and once in ``n_pages``."""
    issues = findings.filter(~c("passed"))
    first = F.min_by(F.struct("weight", "severity", c("url").alias("first_url")), F.struct("depth", "url", "weight"))
    per_page = issues.groupBy("category", "rule_id", "page_id").agg(F.count(F.lit(1)).alias("n"), first.alias("f"), F.min("depth").alias("depth"))
    return (
        per_page.groupBy("category", "rule_id")
        .agg(F.sum("n").alias("n_affected"), F.count(F.lit(1)).alias("n_pages"),
             F.min_by("f", F.struct("depth", c("f.first_url"), c("f.weight"))).alias("f"))
        .select("category", "rule_id", "n_affected", "n_pages", "f.weight", "f.severity", "f.first_url")
    )


def card_passed(findings: DataFrame) -> DataFrame:
    """``anti_passed``: a passed check stays only when no page has an issue of that id."""
    ids = findings.filter(c("passed")).select("category", "rule_id").distinct()
    issues = findings.filter(~c("passed")).select("category", "rule_id").distinct()
    return ids.join(issues, ["category", "rule_id"], "left_anti")


def category_cards(audited: DataFrame, findings: DataFrame) -> DataFrame:
    """``agg_category_card``: score of each category with its issues, heaviest first."""
    scores = category_scores(page_category_scores(audited))
    return (
        scores.join(card_issues(findings), "category", "left")
        .withColumn("label", label(c("category")))
        .withColumn("detail_suffix", F.when(
            c("n_affected") > 1,
            F.concat(F.lit("(found on "), c("n_affected").cast("string"), F.lit(" of "), c("pages_analyzed").cast("string"), F.lit(" pages scanned)")),
        ).otherwise(""))
        .orderBy("category", F.desc("weight"), "rule_id")
    )


def by_prefix(findings: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``flt_rule_prefix``: findings whose id starts with one of the prefixes (a short fixed list)."""
    return findings.join(F.broadcast(prefixes), c("rule_id").startswith(c("prefix")), "left_semi")


def tool_views(findings: DataFrame) -> DataFrame:
    """``flt_tool_view``: findings (source, subject, rule_id, passed, weight) of each tool of the fixed list."""
    rows = [(t.slug, t.source, p) for t in TOOLS if t.source for p in t.prefixes or ("",)]
    tools = findings.sparkSession.createDataFrame(rows, "tool string, tool_source string, prefix string")
    hit = findings.join(F.broadcast(tools), (c("source") == c("tool_source")) & c("rule_id").startswith(c("prefix")))
    return hit.select("tool", "source", "subject", "rule_id", "passed", "weight")


def min_severity(findings: DataFrame, floor: str) -> DataFrame:
    return findings.filter(severity_rank(c("severity")) >= severity_rank(F.lit(floor)))


def top_per_category(cards: DataFrame, n: int) -> DataFrame:
    """The heaviest open issues of each category and how many more there are."""
    w = Window.partitionBy("category").orderBy(F.desc("weight"), "rule_id")
    return (
        cards.withColumn("rank", F.row_number().over(w)).withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("category")))
        .filter(c("rank") <= n).withColumn("remaining", F.greatest(c("total") - n, F.lit(0).cast("long")))
    )


def issue_listing(findings: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``flt_issue_listing``: the first ``n`` open issues of every value of ``keys``, their rank, and how many there are.

    The count is joined on, so that the window keeps no more than ``n`` rows of a group in each task.
    """
    issues = findings.filter(~c("passed"))
    w = Window.partitionBy(*keys).orderBy("page_id", "rule_id", "weight")
    totals = issues.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return issues.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= n).join(totals, keys)


def top_findings(findings: DataFrame, issues: int, passes: int) -> DataFrame:
    """``topk_security``: the heaviest issues and the first passed checks of every page."""
    w = Window.partitionBy("page_id", "passed").orderBy(F.desc("weight"), "rule_id")
    return findings.withColumn("rank", F.row_number().over(w)).filter(c("rank") <= F.when(c("passed"), passes).otherwise(issues))


def report_summary(findings: DataFrame, resolved: DataFrame) -> DataFrame:
    """``agg_report_summary``: open, total and passed rows per category of the card; ``resolved`` (category, rule_id)
    issues are not open."""
    done = resolved.select("category", "rule_id", F.lit(True).alias("done")).distinct()
    issues = card_issues(findings).join(done, ["category", "rule_id"], "left")
    cards = issues.groupBy("category").agg(F.count_if(c("done").isNull()).alias("open_issues"), F.count(F.lit(1)).alias("total_issues"))
    passed = card_passed(findings).groupBy("category").agg(F.count(F.lit(1)).alias("passed_count"))
    return cards.join(passed, "category", "full_outer").select(
        "category", F.coalesce("open_issues", F.lit(0)).cast("long").alias("open_issues"),
        F.coalesce("total_issues", F.lit(0)).cast("long").alias("total_issues"),
        F.coalesce("passed_count", F.lit(0)).cast("long").alias("passed_count"))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 60, "warn").otherwise("critical")


def mark_resolved(scores: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``prj_mark_resolved``: a resolved issue gives its weight back, up to 97."""
    gain = resolutions.groupBy("category").agg(F.sum("weight").alias("gain"))
    return scores.join(F.broadcast(gain), "category", "left").select(
        "category", "score",
        F.when(c("gain").isNull(), c("score")).otherwise(F.least(F.lit(97), c("score") + c("gain"))).cast("int").alias("new_score"))
