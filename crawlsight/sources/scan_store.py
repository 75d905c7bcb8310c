"""Scans kept as a table partitioned by day, in the shared store: idempotent upserts, merges and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.session import stored

c = F.col


def _write(scans: DataFrame, path: str) -> None:
    """The days of ``scans`` are replaced, no others. A day's rows lie in several files, so that a busy day is no task."""
    dealt = scans.repartition("day", F.pmod(F.xxhash64("scan_id"), F.lit(16)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def create(scans: DataFrame, path: str) -> None:
    """A new store of scans (scan_id, created_at and any other columns); the newest row of an id counts."""
    newest = scans.groupBy("scan_id").agg(F.max_by(F.struct(*scans.columns), "created_at").alias("newest_row")).select("newest_row.*")
    _write(newest.withColumns({"day": c("created_at").cast("date"), "gone": F.lit(False)}), path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """All scans of a store. A filter on ``day`` reads that day's files only."""
    return spark.read.parquet(path).filter(~c("gone")).drop("gone")


def upsert(spark: SparkSession, path: str, incoming: DataFrame) -> None:
    """``sink_scan_upsert``: incoming rows replace the rows of their ids.

    Only the days that hold such an id, now or before, are read again and replaced; a second run of the same batch finds
    what it would write. A scan that moves to another day leaves a mark in its old one, since a day without rows would
    stay as it was. The new days are stored first: a run that breaks off leaves whole days, and is run again.
    """
    new = incoming.withColumns({"day": c("created_at").cast("date"), "gone": F.lit(False)})
    ids = new.select("scan_id", c("day").alias("new_day"))
    kept = spark.read.parquet(path)
    moved = kept.filter(~c("gone")).join(ids, "scan_id").filter(c("day") != c("new_day"))
    days = new.select("day").unionByName(moved.select("day")).distinct()
    rest = kept.join(days, "day", "left_semi").join(ids, "scan_id", "left_anti")
    marks = moved.drop("new_day").withColumn("gone", F.lit(True))
    _write(stored(rest.unionByName(marks).unionByName(new.select(kept.columns)), "scan-days"), path)


def merge(spark: SparkSession, path: str, remote: DataFrame) -> None:
    """``merge_scan_stores``: scans that this store lacks are taken over; its own are left alone."""
    lacking = remote.join(table(spark, path).select("scan_id"), "scan_id", "left_anti")
    upsert(spark, path, stored(lacking, "scans-lacking"))


def lookup(spark: SparkSession, path: str, day: str, scan_id: str) -> DataFrame:
    """``src_scan_history``: one scan, from its day's files."""
    return table(spark, path).filter((c("day") == F.lit(day).cast("date")) & (c("scan_id") == scan_id))
