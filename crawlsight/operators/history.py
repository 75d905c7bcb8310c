"""Scan history: series, comparison, schedules, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.functions.text import count_of

c = F.col


def previous_scan(scans: DataFrame) -> DataFrame:
    """``win_prev_scan`` / ``join_prev_scan``: the latest earlier scan of the same site and mode."""
    w = Window.partitionBy("url", "mode").orderBy("created_at", "scan_id")
    return scans.withColumn("prev_scan_id", F.lag("scan_id").over(w)).withColumn("prev_score", F.lag("overall_score").over(w)).withColumn(
        "delta", c("overall_score") - c("prev_score"))


def category_deltas(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """``join_scan_diff`` / ``set_union_categories``: categories of either scan, a missing score counts 0."""
    cur = pairs.join(scores, "scan_id").select("scan_id", "prev_scan_id", "category", c("score").alias("current_score"))
    prev = pairs.join(scores.withColumnRenamed("scan_id", "prev_scan_id"), "prev_scan_id").select(
        "scan_id", "prev_scan_id", "category", c("score").alias("previous_score"))
    both = cur.join(prev, ["scan_id", "prev_scan_id", "category"], "full_outer")
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    return both.select(
        "scan_id", "category", zero("previous_score").alias("previous_score"), zero("current_score").alias("current_score"),
        (zero("current_score") - zero("previous_score")).alias("delta"))


def issue_changes(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """``set_except_issues``: new = current - previous, resolved = previous - current, per category."""
    issues = findings.select("scan_id", "category", "rule_id").distinct()
    cur = pairs.join(issues, "scan_id").select("scan_id", "category", "rule_id")
    prev = pairs.join(issues.withColumnRenamed("scan_id", "prev_scan_id"), "prev_scan_id").select("scan_id", "category", "rule_id")
    keys = ["scan_id", "category", "rule_id"]
    return cur.join(prev, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(
        prev.join(cur, keys, "left_anti").withColumn("change", F.lit("resolved")))


def overall(scores: DataFrame) -> DataFrame:
    """``agg_overall_score``: rounded mean of the category scores of a scan."""
    return scores.groupBy("scan_id").agg(F.round(F.avg("score")).cast("int").alias("overall_score"))


def summary_text(delta: Column, now: Column, n_new: Column, n_resolved: Column) -> Column:
    """``prj_summary_text``"""
    parts = F.concat_ws(
        ", ",
        F.when(delta != 0, F.concat(F.lit("score "), F.when(delta > 0, "+").otherwise(""), delta.cast("string"), F.lit(" (now "), now.cast("string"), F.lit(")"))),
        F.when(n_new > 0, count_of(n_new, "new issue")),
        F.when(n_resolved > 0, F.concat(n_resolved.cast("string"), F.lit(" resolved"))),
    )
    return F.when(parts == "", F.lit("No change since the last scan.")).otherwise(parts)


def comparisons(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One summary row per scan that has a predecessor."""
    pairs = previous_scan(scans).filter(c("prev_scan_id").isNotNull())
    changes = issue_changes(findings, pairs.select("scan_id", "prev_scan_id")).groupBy("scan_id").agg(
        F.count_if(c("change") == "new").alias("n_new"), F.count_if(c("change") == "resolved").alias("n_resolved"))
    j = pairs.join(changes, "scan_id", "left").fillna(0, ["n_new", "n_resolved"])
    return j.select(
        "scan_id", "delta", "n_new", "n_resolved",
        summary_text(c("delta"), c("overall_score"), c("n_new"), c("n_resolved")).alias("summary"))


def next_run(frequency: Column, start: Column) -> Column:
    """Fixed hours for hourly, daily and weekly; the calendar for monthly and yearly (month ends clamp)."""
    return (
        F.when(frequency == "hourly", start + F.expr("INTERVAL 1 HOUR")).when(frequency == "weekly", start + F.expr("INTERVAL 168 HOURS"))
        .when(frequency == "monthly", start + F.make_ym_interval(F.lit(0), F.lit(1)))
        .when(frequency == "yearly", start + F.make_ym_interval(F.lit(1), F.lit(0))).otherwise(start + F.expr("INTERVAL 24 HOURS"))
    )


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """``flt_due_schedules``"""
    return schedules.filter(c("enabled") & (c("next_run_at") <= now))


def run_due(schedules: DataFrame, now: Column) -> DataFrame:
    """``str_due_schedules``: due schedules get their next run, whatever became of this one."""
    is_due = c("enabled") & (c("next_run_at") <= now)
    return schedules.withColumn("last_run_at", F.when(is_due, now).otherwise(c("last_run_at"))).withColumn(
        "next_run_at", F.when(is_due, next_run(c("frequency"), now)).otherwise(c("next_run_at")))


def retained(scans: DataFrame, now: Column, days: int) -> DataFrame:
    """``flt_retention``: scans of the last ``days`` days, 0 keeps all."""
    return scans if days <= 0 else scans.filter(c("created_at") >= now - F.make_dt_interval(F.lit(days)))


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``sink_scan_upsert``: the incoming row replaces the stored row of the same id.

    An anti join, not a window over all versions: a hot id cannot pile up in one task.
    """
    return stored.join(incoming.select("scan_id"), "scan_id", "left_anti").unionByName(incoming)


def merge_missing(local: DataFrame, remote: DataFrame) -> DataFrame:
    """``merge_scan_stores``"""
    return local.unionByName(remote.join(local.select("scan_id"), "scan_id", "left_anti"))


def recent(scans: DataFrame, n: int) -> DataFrame:
    """``topk_recent_scans`` / ``win_recent_history``"""
    return scans.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n)
