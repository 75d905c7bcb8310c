"""What the operators share: the documents, tables kept for one run, Arrow stages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of most contracts: runs without the six ASCII white-space characters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z only, in UTF-8 bytes (every byte of a longer character is above 0x7F).
LOWER_AZ = bytes.maketrans(UPPER.encode(), LOWER.encode())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session that names none gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="crawlsight-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of this run alone; the shared folder's owner empties it."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the rows are computed once, lost executors cost no redo."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` stored in the shared folder in buckets of ``batch``: a join on it moves only the other side."""
    path = scratch(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "batch").saveAsTable(table)
    return df.sparkSession.table(table)


def in_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str | StructType) -> DataFrame:
    """``fn`` turns a batch into columns; small batches keep long texts from adding up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield pa.RecordBatch.from_pydict(fn(batch.slice(at, 1000)))

    return df.mapInArrow(run, schema)


def range_ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in global order of ``keys``, stored with their partition's number as ``part`` and a running number ``at``.

    Nulls come first. Rows equal in all keys are dealt out by their place in the input, so one key may hold any share
    of the rows and still be split.
    """
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    order = [*keys, "tie"]
    return tied.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("tie")


def prefix_sums(placed: DataFrame, value: str) -> DataFrame:
    """Adds start (the sum of ``value`` over all rows before), number (the rows before) and total (the sum of all).

    ``placed`` has ``part`` and ``at`` from :func:`range_ordered` and is stored. Each part is summed on its own; only
    one row per part meets in one place.
    """
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumns({"value_to": F.sum(value).over(inside), "rows_to": F.count(F.lit(1)).over(inside)})
    totals = placed.groupBy("part").agg(F.sum(value).alias("values"), F.count(F.lit(1)).alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("values").over(before), F.lit(0)).alias("values_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("values").over(everything).alias("total"),
    )
    summed = running.join(F.broadcast(bases), "part").withColumns(
        {"start": F.col("values_before") + F.col("value_to") - F.col(value), "number": F.col("rows_before") + F.col("rows_to") - 1}
    )
    return summed.drop("value_to", "rows_to", "values_before", "rows_before")


def numbered(docs: DataFrame, name: str = "row_no") -> DataFrame:
    """A number for each row: its split and its place there. Another scan may split the files otherwise (splits follow
    the live executors' cores), so what reads the numbers twice reads them from a stored table."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def with_texts(rows: DataFrame, names: list[str]) -> DataFrame:
    """row_no, doc_id, text of rows whose columns ``names`` are called c0, c1 and so on."""
    return rows.select("row_no", *[F.col(f"c{names.index(c)}").alias(c) for c in ("doc_id", "text")])
