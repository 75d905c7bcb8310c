"""Session settings that belong to the deployment, read once and never forced on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "crawlsight", cpus: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and the bench. On a cluster the submitted session is used as is."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session that names none gets a folder of its own, once."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="crawlsight-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: what several branches of a query read is computed once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *scans: DataFrame) -> DataFrame:
    """``df`` as it is, unless the scans that feed it have fewer splits than the session has cores.

    Extraction is map-only on any input with enough splits (``spark.sql.files.maxPartitionBytes`` sets how much a task
    reads). Only an input of a few splits, so at most cores x that size, is dealt over the cores first: auditing a page
    takes far longer than moving it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = sum(s.rdd.getNumPartitions() for s in scans or (df,))
    return df if splits >= cores else df.repartition(cores)


def dealt(df: DataFrame, rows: int = 4000) -> DataFrame:
    """``df`` as it is if its splits hold even shares of its rows, else dealt over tasks of at most ``rows`` rows.

    A file of many splits may still hold its rows in one or two row groups, so that one task gets them all and the other
    splits are empty. The rows of the splits come from the files' footers; auditing a page takes far longer than moving it.
    """
    splits = df.groupBy(F.spark_partition_id().alias("split")).count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    if not splits["n"]:
        return df
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-splits["n"] // rows))
    return df if splits["most"] <= 2 * -(-splits["n"] // tasks) else df.repartition(tasks)


def fence(df: DataFrame) -> DataFrame:
    """Keep later filters above the columns computed so far.

    The optimizer pushes a filter below the projection that makes its columns by copying their
    expressions into it. For columns made by long chains of regular expressions that computes the
    chain twice and makes the plan explode. A one-row generator stops that and costs nothing else.
    """
    return df.select(F.inline_outer(F.array(F.struct(*df.columns))))
