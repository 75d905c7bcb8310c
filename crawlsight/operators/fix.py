"""Page repair: what a repair run does with each finding, and the repaired HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import markup as M

c = F.col

# Findings a repair settles by itself, needs a written value for, or only reports.
FIXED = ("canonical", "meta-charset", "favicon", "og-basic", "og-url", "og-type", "twitter-card", "lang", "mobile-viewport", "render-blocking-js", "lazy-loading", "h1-multiple", "heading-order")
NEEDS_VALUE = {"title": "title", "meta-desc": "meta-description", "alt-text": "alt-text", "labels": "aria-label", "button-names": "aria-label", "cta-clarity": "cta-text"}
REPORTED = ("noindex", "canonical-cross-domain", "landmarks", "cls-images", "hreflang-invalid", "hreflang-no-x-default", "form-length")


def plan(findings: DataFrame) -> DataFrame:
    """``audit_fix_plan``: status of every finding a repair run touches."""
    rule = c("rule_id")
    status = F.when(rule.isin(*FIXED), "fixed").when(rule.isin(*NEEDS_VALUE), "ai-needed").when(rule.isin(*REPORTED), "skipped")
    kind = F.coalesce(*[F.when(rule == r, k) for r, k in NEEDS_VALUE.items()])
    return findings.filter(~c("passed")).withColumn("status", status).withColumn("kind", kind).filter(c("status").isNotNull())


def summary(planned: DataFrame) -> DataFrame:
    """``agg_fix_summary``"""
    n = lambda s: F.count_if(c("status") == s).alias(s.replace("-", "_"))
    return planned.groupBy("page_id").agg(n("fixed"), n("ai-needed"), n("skipped"))


def clamp_levels(pages: DataFrame) -> DataFrame:
    """``win_heading_clamp``: a level may exceed the one before it by one; the clamped level feeds forward."""
    levels = F.transform(M.elements(M.skeleton(c("html")), "h[1-6]"), lambda e: F.substring(M.tag_name(e), 2, 1).cast("int"))
    state = F.struct(F.lit(0).alias("prev"), F.lit("").alias("seq"))
    step = lambda a, x: F.struct(
        F.when(a["prev"] == 0, x).otherwise(F.least(x, a["prev"] + 1)).alias("prev"),
        F.concat(a["seq"], F.when(a["prev"] == 0, x).otherwise(F.least(x, a["prev"] + 1)).cast("string")).alias("seq"))
    return pages.select("page_id", F.aggregate(levels, state, step)["seq"].alias("levels"))


def bank(values: DataFrame) -> DataFrame:
    """``agg_fix_bank_update``: newest accepted value per (kind, category)."""
    return values.groupBy("kind", "category").agg(F.max_by("value", "seq").alias("value"))


def banked_values(targets: DataFrame, stored: DataFrame) -> DataFrame:
    """``join_fix_bank``: targets with the bank's value for their kind and category, where it has one."""
    return targets.join(stored, ["kind", "category"]).select("target_id", "kind", "category", "value")


def apply_values(targets: DataFrame, values: DataFrame, stored: DataFrame) -> DataFrame:
    """``audit_fix_apply``: a supplied value, else the bank's, else skipped."""
    j = targets.join(values.select("target_id", c("value").alias("own"), "confidence"), "target_id", "left").join(
        stored.select("kind", "category", c("value").alias("banked")), ["kind", "category"], "left")
    status = (
        F.when(c("own").isNotNull() & (c("confidence") == "low"), "needs-review").when(c("own").isNotNull(), "fixed")
        .when(c("banked").isNotNull(), "duplicated").otherwise("skipped"))
    return j.select("target_id", status.alias("status"), F.coalesce("own", "banked").alias("value"))


def open_items(planned: DataFrame, resolved: DataFrame) -> DataFrame:
    """``set_open_fix_items``: unresolved targets and reported findings as one work list."""
    targets = planned.filter(c("status") == "ai-needed").join(resolved, ["page_id", "rule_id"], "left_anti").select("page_id", "rule_id", F.lit("target").alias("item"))
    return targets.unionByName(planned.filter(c("status") == "skipped").select("page_id", "rule_id", F.lit("result").alias("item")))


def response_values(raw: Column) -> Column:
    """The values of a model's answer: id, value, low (it is unsure) of each fix whose id and value are texts.

    A code fence around the JSON is tolerated; what is no JSON has no values.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?", ""), r"```$", ""))
    fixes = F.try_variant_get(F.try_parse_json(plain), "$.fixes", "array<variant>")
    text = lambda x, key: F.when(F.schema_of_variant(F.try_variant_get(x, f"$.{key}", "variant")) == "STRING", F.try_variant_get(x, f"$.{key}", "string"))
    rows = F.transform(fixes, lambda x: F.struct(text(x, "id").alias("id"), F.trim(text(x, "value")).alias("value"), F.coalesce(F.lower(text(x, "confidence")) == "low", F.lit(False)).alias("low")))
    return F.coalesce(F.filter(rows, lambda r: r["id"].isNotNull() & (r["value"] != "")), F.array().cast("array<struct<id:string,value:string,low:boolean>>"))


def rewrite_problem(original: Column, modified: Column, path: Column) -> Column:
    """``audit_fix_integrity`` of a file written anew as a whole: why it must be rejected, NULL when it is sound."""
    new = F.trim(modified)
    n = lambda ch: F.length(new) - F.length(F.replace(new, F.lit(ch), F.lit("")))
    sized = F.length(original) > 200
    exports = lambda text: text.rlike(r"export\s+default")
    whole = lambda text: text.rlike(r"(?i)<html[\s>]")
    return (
        F.when(new == "", "empty").when(sized & (F.length(new) < F.length(original) * 0.4), "truncated").when(sized & (F.length(new) > F.length(original) * 3), "padded")
        .when(n("{") != n("}"), "curly-braces").when(n("(") != n(")"), "parentheses").when(n("[") != n("]"), "square-brackets")
        .when(path.rlike(r"\.(tsx|jsx)$") & exports(original) & ~exports(new), "export-lost").when(whole(original) & ~whole(new), "html-lost"))
