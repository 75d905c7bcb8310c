"""Streams of landed page and event files.

Results go to Parquet tables under the shared checkpoint folder, never through the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlsight.functions import urls as U
from crawlsight.operators import page_rules as R
from crawlsight.session import shared_folder

c = F.col


def work_folder(spark: SparkSession) -> str:
    """A new folder under the shared folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, folder: str, glob: str, files_per_trigger: int = 1000) -> DataFrame:
    """Files landing in a folder whose name matches ``glob``."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def landed(df: DataFrame, folder: str, files: int) -> str:
    """``df`` as a folder of so many files, as if they had landed one after the other."""
    df.repartition(files).write.parquet(f"{folder}/landed")
    return f"{folder}/landed"


def append_to_table(stream: DataFrame, folder: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run all available data in append mode and read the table back."""
    w = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start(f"{folder}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def replace_table(stream: DataFrame, folder: str) -> DataFrame:
    """Complete-mode aggregate: every trigger replaces the result table (its size is the number of groups)."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True)
    q.start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out")


def each_batch(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None]) -> None:
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def page_audit(pages: DataFrame) -> DataFrame:
    """``str_page_audit``: stateless; the batch operator as it is."""
    return R.all_findings(pages)


def progress(events: DataFrame, key: str) -> DataFrame:
    """``str_progress``"""
    return events.groupBy(key).count()


def partial_report(pages: DataFrame) -> DataFrame:
    """``str_partial_report``: running sums per category; the mean is taken when the table is read."""
    from crawlsight.operators.score import page_category_scores

    return page_category_scores(R.page_audit(pages)).groupBy("category").agg(
        F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("pages"))


def seen_dedup(events: DataFrame, keys: list[str], time: str | None = None, keep: str | None = None) -> DataFrame:
    """``str_seen_dedup``: the first row of every key of the stream.

    Without ``time`` the keys stay in the state for as long as the stream's folder does: a crawl has one stream, and its
    state goes with it. A stream that goes on names its event time and how long a key is kept (``keep``, as '7 days').
    """
    return events.dropDuplicates(keys) if time is None else events.withWatermark(time, keep).dropDuplicatesWithinWatermark(keys)


def unseen(pages: DataFrame, seen: DataFrame) -> DataFrame:
    """``anti_seen_urls`` / ``str_resume``: pages whose normalised URL has not been scanned."""
    done = seen.select(U.normalize(c("url")).alias("norm_url")).distinct()
    return pages.withColumn("norm_url", U.normalize(c("url"))).join(done, "norm_url", "left_anti")


def resume(spark: SparkSession, stream: DataFrame, seen: DataFrame, folder: str) -> DataFrame:
    """Each batch skips finished pages. A batch that runs again overwrites its own partition."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        unseen(batch, seen).select("page_id", "url", "norm_url").write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    each_batch(stream, folder, handle)
    return spark.read.parquet(f"{folder}/out").drop("batch")


def read_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of landed NDJSON files; the last line of a file needs no line feed."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """``src_events_ndjson``: the fields of each line and ``bad``, the line itself where it is no JSON object of the schema.

    Blank lines are no events.
    """
    read = F.from_json("value", f"{schema}, bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    return lines.filter(F.trim("value") != "").select(read.alias("e")).select("e.*")


def route(spark: SparkSession, lines: DataFrame, schema: str, key: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """``str_event_router``: events as a table partitioned by ``key``, and the lines that are none as a table of their own.

    Both are written from one reading of a batch; a batch that runs again overwrites its own part of both.
    """
    fields = [f.split()[0] for f in schema.split(", ")]

    def handle(batch: DataFrame, batch_id: int) -> None:
        events = parsed_lines(batch, schema).persist()
        events.filter("bad is null").select(fields).write.mode("overwrite").partitionBy(key).parquet(f"{folder}/events/batch={batch_id}")
        events.filter("bad is not null").select("bad").write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch_id}")
        events.unpersist()

    each_batch(lines, folder, handle)
    return spark.read.parquet(f"{folder}/events").select(fields), spark.read.parquet(f"{folder}/rejected").select("bad")


class SiteScans(StatefulProcessor):
    """The scans of one site and mode: what each found, and their order in time.

    A batch's rows touch some of its scans. Only those, the ones after them and the ones before either are needed; what a
    batch costs does not grow with the batches before it, but for the list of the site's scans, which is kept as
    (time, id, part) triples. What scans found is kept in parts of up to ``PART`` scans, in the order they were first met:
    every call to the state is a message to the JVM, so a part is read and written once a batch, however many of its scans
    the batch touches.
    """

    PART = 64

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getValueState("order", "times array<long>, ids array<string>, parts array<int>")
        self.found = handle.getMapState("found", "part int", "ids array<string>, issues array<array<string>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new: dict[str, tuple[int, set[str]]] = {}
        for part in rows:
            for scan_id, at, category, rule_id in zip(part["scan_id"], part["at"], part["category"], part["rule_id"], strict=True):
                latest, issues = new.get(scan_id, (at, set()))
                issues.add(f"{category}\x00{rule_id}")
                new[scan_id] = max(latest, at), issues
        kept = self.order.get() if self.order.exists() else None
        times = dict(zip(kept[1], kept[0], strict=True)) if kept else {}
        part_of = dict(zip(kept[1], kept[2], strict=True)) if kept else {}
        n_kept, parts = len(part_of), {}

        def found_in(number: int) -> dict[str, set[str]]:
            if number not in parts:
                of = self.found.getValue((number,)) if number * self.PART < n_kept else ([], [])
                parts[number] = {scan_id: set(issues) for scan_id, issues in zip(of[0], of[1], strict=True)}
            return parts[number]

        before = self.previous(times)
        for scan_id, (at, issues) in new.items():
            times[scan_id] = max(at, times.get(scan_id, at))
            found_in(part_of.setdefault(scan_id, len(part_of) // self.PART)).setdefault(scan_id, set()).update(issues)
        for number in {part_of[scan_id] for scan_id in new}:
            self.found.updateValue((number,), (list(parts[number]), [sorted(x) for x in parts[number].values()]))
        after = self.previous(times)
        ids = sorted(times, key=lambda x: (times[x], x))
        self.order.update(([times[x] for x in ids], ids, [part_of[x] for x in ids]))
        out = []
        for scan_id, prev in after.items():
            if scan_id in new or prev in new or before.get(scan_id, prev) != prev:
                now, then = found_in(part_of[scan_id])[scan_id], found_in(part_of[prev])[prev] if prev else set()
                out.append((scan_id, None, None, None))  # what is known of the scan holds no more
                if prev:
                    out += [(scan_id, *x.split("\x00", 1), "new") for x in sorted(now - then)]
                    out += [(scan_id, *x.split("\x00", 1), "resolved") for x in sorted(then - now)]
        yield pd.DataFrame(out, columns=["scan_id", "category", "rule_id", "change"])

    @staticmethod
    def previous(times: dict[str, int]) -> dict[str, str | None]:
        """For each scan the one before it."""
        ids = sorted(times, key=lambda x: (times[x], x))
        return dict(zip(ids, [None, *ids], strict=False))

    def close(self) -> None:
        pass


def scan_compare(spark: SparkSession, events: DataFrame, folder: str) -> DataFrame:
    """``str_scan_compare``: every scan against the scan of its site before it, however its events fall into batches.

    ``events`` has url, mode, scan_id, ts, category and rule_id. The scans of a (url, mode) are keyed state; a batch
    reads its own rows and the state of the sites that it touches. Of a scan's comparisons that of the last batch holds;
    a batch that runs again overwrites its own part.
    """
    rows = events.select("url", "mode", "scan_id", F.unix_micros(c("ts").cast("timestamp")).alias("at"), "category", "rule_id")
    compared = rows.groupBy("url", "mode").transformWithStateInPandas(
        statefulProcessor=SiteScans(), outputStructType="scan_id string, category string, rule_id string, change string", outputMode="Append", timeMode="None")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    store, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    old = spark.conf.get(store, None)
    spark.conf.set(store, rocks)  # keyed state of this kind needs it
    try:
        each_batch(compared, folder, handle)
    finally:
        spark.conf.set(store, old) if old else spark.conf.unset(store)
    out = spark.read.parquet(f"{folder}/out")
    last = out.filter("change is null").groupBy("scan_id").agg(F.max("batch").alias("batch"))
    return out.filter("change is not null").join(last, ["scan_id", "batch"]).select("scan_id", "category", "rule_id", "change")
