"""Links of pages: extraction, classes, status join, duplicates, site-wide references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions import markup as M
from crawlsight.functions import text as T
from crawlsight.functions import urls as U
from crawlsight.functions.findings import Checks, explode_findings
from crawlsight.session import fence

c = F.col

EXTERNAL_LIMIT = 50
LINK_CHECK_LIMIT = 500
PAGES_PER_LINK = 25


def raw_links(pages: DataFrame) -> DataFrame:
    """``ext_links``: one row per <a> in document order, href NULL when missing."""
    skel = F.when(
        F.lower("html").contains("<script") | F.lower("html").contains("<style") | c("html").contains("<!--"),
        M.skeleton(c("html")),
    ).otherwise(c("html"))
    el, open_ = c("el"), c("open")
    return (
        pages.select("page_id", "url", F.posexplode(M.elements(skel, "a")).alias("pos", "el"))
        .withColumn("open", M.open_tag(el))
        .select(
            "page_id", "url", "pos",
            M.attr(open_, "href").alias("href"),
            M.element_text(el).alias("text"),
            F.lower(M.attr(open_, "rel", False)).alias("rel"),
            M.attr_or_null(open_, "target", False).alias("target"),
            T.trim_ws(M.attr(open_, "aria-label")).alias("aria_label"),
            T.trim_ws(M.attr(open_, "title")).alias("title"),
            T.trim_ws(F.coalesce(
                F.get(F.filter(F.transform(M.tags(el, "img"), lambda t: M.attr_or_null(t, "alt")), lambda a: a.isNotNull()), F.lit(0)),
                F.lit(""))).alias("img_alt"),
        )
        .withColumn("name", F.coalesce(*[F.nullif(c(x), F.lit("")) for x in ("text", "aria_label", "title", "img_alt")], F.lit("")))
    )


def classify(links: DataFrame) -> DataFrame:
    """``ext_link_class``: exactly one of the five odd classes, or a resolved URL."""
    h = F.trim("href")
    odd = (
        F.when(h == "", "empty").when(h.rlike("(?i)^javascript:"), "javascript")
        .when(h.rlike("(?i)^(mailto:|tel:|sms:)"), "contact").when(h.startswith("#"), "anchor")
    )
    tokens = F.split("rel", r"\s+")
    return (
        links.withColumn("kind", odd)
        .withColumn("absolute", F.when(c("kind").isNull(), U.absolute_form(c("href"), c("url"))))
        .withColumn("resolved_url", F.when(U.is_http(c("absolute")), U.canonical_form(c("absolute"))).otherwise(c("absolute")))
        .withColumn("kind", F.coalesce("kind", F.when(c("resolved_url").isNull(), "malformed").otherwise("link")))
        .withColumn("is_external", (c("kind") == "link") & (U.hostname(c("resolved_url")) != U.hostname(c("url"))))
        .withColumn("has_no_text", c("name") == "")
        .withColumn(
            "missing_noopener",
            F.coalesce(c("target") == "_blank", F.lit(False))
            & ~(F.array_contains(tokens, "noopener") | F.array_contains(tokens, "noreferrer")))
        .drop("absolute")
    )


def links(pages: DataFrame) -> DataFrame:
    return fence(classify(raw_links(pages)))


def checkable(links_df: DataFrame) -> DataFrame:
    return links_df.filter(c("kind") == "link")


def dedupe_status(status: DataFrame) -> DataFrame:
    """One check result per URL: a failed one if there is any."""
    return status.groupBy("resolved_url").agg(F.min(F.struct("ok", "status_code", "error")).alias("s")).select("resolved_url", "s.*")


def join_status(links_df: DataFrame, status: DataFrame) -> DataFrame:
    """``join_link_status``: links with the result of their check.

    ``status`` has one row per URL. Menu links repeat on every page of a site, so one URL can hold a large share of the
    links: AQE splits its rows, as nothing above the join needs them together.
    """
    return checkable(links_df).join(status, "resolved_url", "left")


def link_counts(links_df: DataFrame) -> DataFrame:
    """``agg_link_counts``: internal is checkable minus external."""
    n = lambda cond: F.count_if(cond).cast("long")
    return links_df.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_links"), n(c("kind") == "link").alias("n_checkable"), n(c("is_external")).alias("n_external")
    ).withColumn("n_internal", c("n_checkable") - c("n_external"))


def duplicate_links(links_df: DataFrame) -> DataFrame:
    """``agg_dup_links``: URLs linked more than once on a page, with the first three texts."""
    w = Window.partitionBy("page_id", "resolved_url").orderBy("pos")
    shown = F.coalesce(F.nullif(c("text"), F.lit("")), F.lit("(no text)"))
    ranked = checkable(links_df).select("page_id", "resolved_url", shown.alias("text"), F.row_number().over(w).alias("rn"))
    return (
        ranked.groupBy("page_id", "resolved_url")
        .agg(F.count(F.lit(1)).alias("n"), *[F.min(F.when(c("rn") == i, c("text"))).alias(f"t{i}") for i in (1, 2, 3)])
        .filter(c("n") > 1)
        .select("page_id", "resolved_url", "n", F.concat_ws(" | ", "t1", "t2", "t3").alias("sample_texts"))
    )


def link_refs(links_df: DataFrame) -> DataFrame:
    """``agg_link_refs``: distinct referring pages per URL.

    Pre-aggregated per (url, page): a menu link on every page reaches the second shuffle as one
    partial row per task.
    """
    per_page = checkable(links_df).groupBy("resolved_url", "url").agg(
        F.max("is_external").alias("is_external"), F.min(F.nullif("text", F.lit(""))).alias("text"))
    return per_page.groupBy("resolved_url").agg(
        F.count(F.lit(1)).alias("n_pages"), F.max("is_external").alias("is_external"), F.min("text").alias("sample_text"))


def most_referenced(refs: DataFrame, limit: int = LINK_CHECK_LIMIT) -> DataFrame:
    """``topk_links_by_refs``: the URLs worth checking first."""
    return refs.orderBy(F.desc("n_pages"), "resolved_url").limit(limit)


def affected_pages(links_df: DataFrame, broken: DataFrame, limit: int = PAGES_PER_LINK) -> DataFrame:
    """``lim_affected_pages``: at most ``limit`` referring pages per broken URL.

    The rank runs over (url, bucket of pages) first and over the survivors second, so a URL linked
    from a third of all pages is cut to ``limit`` rows per bucket before it meets in one task.
    """
    pages = checkable(links_df).join(broken.select("resolved_url"), "resolved_url", "left_semi").select("resolved_url", "url").distinct()
    part = Window.partitionBy("resolved_url", "bucket").orderBy("url")
    whole = Window.partitionBy("resolved_url").orderBy("url")
    return (
        pages.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(64)))
        .withColumn("rn", F.row_number().over(part)).filter(c("rn") <= limit)
        .withColumn("rn", F.row_number().over(whole)).filter(c("rn") <= limit)
        .select("resolved_url", "url", c("rn").cast("long").alias("page_no"))
    )


def page_link_features(links_df: DataFrame, status: DataFrame | None = None) -> DataFrame:
    n = lambda cond: F.count_if(cond).cast("long")
    counts = links_df.groupBy("page_id").agg(
        n(c("kind") == "empty").alias("n_empty"), n(c("kind") == "javascript").alias("n_js"),
        n(c("kind") == "malformed").alias("n_malformed"), n(c("has_no_text")).alias("n_no_text"),
        n(c("missing_noopener")).alias("n_noopener"), n(c("is_external")).alias("n_external"))
    per_url = checkable(links_df).groupBy("page_id", "resolved_url").agg(F.count(F.lit(1)).alias("n"))
    if status is not None:
        per_url = per_url.join(status.select("resolved_url", "ok"), "resolved_url", "left")
    else:
        per_url = per_url.withColumn("ok", F.lit(None).cast("boolean"))
    urls = per_url.groupBy("page_id").agg(
        n(c("n") > 1).alias("n_dup"), n(~c("ok")).alias("n_broken"), n(c("ok").isNotNull()).alias("n_checked"))
    return counts.join(urls, "page_id", "left").fillna(0, ["n_dup", "n_broken", "n_checked"])


def audit_links_page(pages: DataFrame, status: DataFrame | None = None, links_df: DataFrame | None = None) -> DataFrame:
    """``audit_links_page``: link findings of every page; pages without links are clean.

    ``links_df`` are the links of ``pages``, stored: they are read twice, and more often if ``status`` comes from them.
    """
    feats = page_link_features(links(pages) if links_df is None else links_df, status)
    f = pages.select("page_id").join(feats, "page_id", "left").fillna(0)
    k = Checks("links")
    k.issue("broken-links", 12, c("n_broken") > 0, n=c("n_broken"))
    k.ok("broken-links", (c("n_checked") > 0) & (c("n_broken") == 0))
    bad = F.lit(False)
    for rule, weight, col in (
        ("duplicate-links", 2, "n_dup"), ("empty-hrefs", 3, "n_empty"), ("javascript-links", 4, "n_js"),
        ("malformed-hrefs", 3, "n_malformed"), ("links-without-text", 5, "n_no_text"), ("missing-rel-noopener", 4, "n_noopener"),
    ):
        k.issue(rule, weight, c(col) > 0, n=c(col))
        bad = bad | (c(col) > 0)
    k.issue("too-many-external-links", 3, c("n_external") > EXTERNAL_LIMIT, n=c("n_external"))
    k.ok("link-hygiene", ~(bad | (c("n_broken") > 0) | (c("n_external") > EXTERNAL_LIMIT)))
    return explode_findings(f, ["page_id"], k.column())


def audit_links_site(links_df: DataFrame, status: DataFrame, limit: int | None = None) -> DataFrame:
    """``audit_links_site``: broken links over the whole crawl, all checked URLs. A ``limit`` is a budget of checks."""
    refs = link_refs(links_df)
    checked = (refs if limit is None else most_referenced(refs, limit)).join(status, "resolved_url")
    n = lambda cond: F.count_if(cond).cast("long")
    tested = checked.agg(
        n(~c("ok") & ~c("is_external")).alias("bad_internal"), n(~c("ok") & c("is_external")).alias("bad_external"),
        F.count(F.lit(1)).alias("n_checked"))
    totals = refs.agg(n(~c("is_external")).alias("n_internal"), n(c("is_external")).alias("n_external"), F.count(F.lit(1)).alias("n_urls"))
    k = Checks("links")
    k.issue("broken-internal-links", 12, c("bad_internal") > 0, n=c("bad_internal"))
    k.ok("broken-internal-links", (c("bad_internal") == 0) & (c("n_internal") > 0))
    k.issue("broken-external-links", 4, c("bad_external") > 0, n=c("bad_external"))
    k.ok("broken-external-links", (c("bad_external") == 0) & (c("n_external") > 0))
    k.ok("link-check-coverage", c("n_checked") < c("n_urls"), n=c("n_checked"))
    return explode_findings(tested.join(F.broadcast(totals)), [], k.column())
