"""Images of pages: extraction, probes, buckets, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import markup as M
from crawlsight.functions import urls as U
from crawlsight.functions.findings import Checks, explode_findings
from crawlsight.session import fence

c = F.col

ABOVE_FOLD = 2
MAX_BYTES = 200 * 1024
OVERSIZE_RATIO = 1.5
MODERN = ("webp", "avif")


def _image_url(src: Column, base: Column) -> Column:
    return F.when((F.trim(src) != "") & ~src.startswith("data:"), U.resolve(src, base))


def images(pages: DataFrame) -> DataFrame:
    """``ext_images``: one row per <img>. A picture and its sources travel as one match.

    Pages without images are passed over inside the row: a filter would move below the dealing of the pages, into the few
    tasks that read them.
    """
    skel = M.skeleton(c("html"))
    units = F.regexp_extract_all(
        skel,
        F.lit(rf"(?is)<picture(?=[\s/>]){M.ATTRS}>(?:(?!</picture).)*+</picture\s*+>|<img(?=[\s/>]){M.ATTRS}>"),
        F.lit(0))
    per_img = F.flatten(F.transform(
        units,
        lambda u: F.transform(
            M.tags(u, "img"),
            lambda t: F.struct(
                t.alias("tag"),
                F.when(u.rlike("(?i)^<picture"), F.filter(
                    F.transform(M.tags(u, "source"), lambda s: F.lower(M.attr(s, "type", False))), lambda x: x != "")
                ).otherwise(F.array().cast("array<string>")).alias("source_types")))))
    tag = c("img.tag")
    rows = pages.select(
        "page_id", "url", F.posexplode(F.when(F.lower("html").contains("<img"), per_img)).alias("idx", "img")).select(
        "page_id", "url", "idx", c("img.source_types").alias("source_types"),
        F.coalesce(M.attr_or_null(tag, "src"), M.attr(tag, "data-src")).alias("src"),
        M.attr_or_null(tag, "alt").alias("alt"),
        M.attr_or_null(tag, "loading", False).alias("loading"),
        F.coalesce(M.attr_or_null(tag, "srcset"), M.attr(tag, "data-srcset")).alias("srcset"),
        M.attr(tag, "sizes").alias("sizes"),
        F.nullif(F.regexp_extract(M.attr(tag, "width", False), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("width"),
        F.nullif(F.regexp_extract(M.attr(tag, "height", False), r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)).alias("height"),
    )
    firsts = F.filter(
        F.transform(F.split("srcset", ","), lambda p: F.get(F.split(F.trim(p), r"\s+"), F.lit(0))), lambda u: u != "")
    return fence(
        rows.withColumn("resolved_url", _image_url(c("src"), c("url")))
        .withColumn("srcset_urls", F.when(F.trim("srcset") == "", F.array().cast("array<string>")).otherwise(
            F.array_distinct(F.filter(F.transform(firsts, lambda u: _image_url(u, c("url"))), lambda u: u.isNotNull()))))
        .withColumn("extension", U.extension(c("src")))
        .withColumn(
            "is_modern",
            F.coalesce(c("extension").isin(*MODERN), F.lit(False))
            | F.exists("srcset_urls", lambda u: F.coalesce(U.extension(u).isin(*MODERN), F.lit(False)))
            | F.exists("source_types", lambda t: t.isin("image/webp", "image/avif")))
        .withColumn("is_lazy", F.coalesce(c("loading") == "lazy", F.lit(False)))
        .withColumn("above_fold", c("idx") < ABOVE_FOLD)
        .withColumn("has_srcset", F.trim("srcset") != "")
        .withColumn("in_picture", F.size("source_types") > 0)
        .withColumn("is_responsive", (c("has_srcset") & (c("sizes") != "")) | c("in_picture"))
    )


def srcset(images_df: DataFrame) -> DataFrame:
    """``ext_srcset``: candidate URLs, one row each."""
    return images_df.select("page_id", "idx", F.explode("srcset_urls").alias("candidate_url"))


def image_urls(images_df: DataFrame) -> DataFrame:
    """Distinct URLs to probe: sources and srcset candidates."""
    has_src = images_df.filter(c("resolved_url").isNotNull())
    return has_src.select(c("resolved_url")).union(has_src.select(F.explode("srcset_urls"))).distinct()


def join_status(images_df: DataFrame, status: DataFrame) -> DataFrame:
    """``join_image_status``: probe result and the two oversize tests."""
    j = images_df.filter(c("resolved_url").isNotNull()).join(status, "resolved_url", "left")
    ratio = F.when((c("actual_width") > 0) & (c("width") > 0), c("actual_width") / c("width"))
    return j.withColumn("too_many_pixels", F.coalesce(ratio >= OVERSIZE_RATIO, F.lit(False))).withColumn(
        "too_many_bytes", F.coalesce(c("ok") & (c("file_size_bytes") > MAX_BYTES), F.lit(False)))


def duplicate_images(images_df: DataFrame) -> DataFrame:
    """``agg_dup_images``"""
    return (
        images_df.filter(c("resolved_url").isNotNull()).groupBy("page_id", "resolved_url").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > 1)
    )


def image_report(images_df: DataFrame) -> DataFrame:
    """``agg_image_report``: how many images of a page fall in each bucket."""
    n = lambda cond: F.count_if(cond).cast("long")
    return images_df.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_images"),
        n(~c("is_lazy") & ~c("above_fold")).alias("n_missing_lazy"), n(c("is_lazy") & c("above_fold")).alias("n_lazy_above_fold"),
        n(~c("has_srcset") & ~c("in_picture")).alias("n_missing_srcset"), n(~c("is_modern") & ~c("in_picture")).alias("n_legacy_format"),
        n(F.coalesce(c("alt") == "", F.lit(False))).alias("n_decorative"), n(c("alt").isNull()).alias("n_missing_alt"),
        n(c("is_responsive")).alias("n_responsive"), n(~c("is_responsive")).alias("n_fixed"))


def audit_images(pages: DataFrame, imgs: DataFrame, status: DataFrame) -> DataFrame:
    """``audit_images``: ``imgs`` are the images of ``pages``, read four times."""
    report = image_report(imgs)
    n = lambda cond: F.count_if(cond).cast("long")
    sized = join_status(imgs, status).groupBy("page_id").agg(n(c("too_many_pixels") | c("too_many_bytes")).alias("n_oversized"))
    has_src = imgs.filter(c("resolved_url").isNotNull())
    probed = has_src.select("page_id", c("resolved_url")).union(has_src.select("page_id", F.explode("srcset_urls"))).distinct()
    broken = probed.join(status, "resolved_url").groupBy("page_id").agg(n(~c("ok")).alias("n_broken"))
    f = (
        pages.select("page_id").join(report, "page_id", "left").join(sized, "page_id", "left").join(broken, "page_id", "left").fillna(0))
    k = Checks("images")
    k.either("images-oversized", 6, c("n_oversized") > 0, "images-sized-ok", n=c("n_oversized"), severity="medium")
    k.either("images-missing-alt", 5, c("n_missing_alt") > 0, "images-alt-ok", n=c("n_missing_alt"), severity="medium")
    k.either("images-legacy-format", 2, c("n_legacy_format") > 0, "images-modern-format", n=c("n_legacy_format"), severity="low")
    k.either("images-no-lazy-load", 2, c("n_missing_lazy") > 0, "images-lazy-ok", n=c("n_missing_lazy"), severity="low")
    k.issue("images-lazy-above-fold", 4, c("n_lazy_above_fold") > 0, n=c("n_lazy_above_fold"), severity="medium")
    k.issue("images-broken", 8, c("n_broken") > 0, n=c("n_broken"), severity="high")
    return explode_findings(f, ["page_id"], k.column())
