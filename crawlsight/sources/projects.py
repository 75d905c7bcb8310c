"""Projects as they are handed in: folders of files, or archives of them.

Both are read by Spark's own file source, so they may lie in any store that Spark reads, one archive to a task at least.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

#: Bytes that the files of one project may have together, and how many files.
MAX_BYTES, MAX_FILES = 60 << 20, 4000
ENTRY = "archive string, path string, size long, content string, problem string"


def plain_path(path: str) -> str:
    """Parts of a path without ``.``, ``..`` and empty ones; it may come out empty."""
    return "/".join(p for p in re.split(r"[/\\]+", path) if p not in ("", ".", ".."))


def plain_path_column(path: Column) -> Column:
    return F.array_join(F.filter(F.split(path, r"[/\\\\]+"), lambda p: ~p.isin("", ".", "..")), "/")


def archived_files(archives: DataFrame, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> DataFrame:
    """``src_project_files`` of archives (archive, content as bytes): archive, path, size, content, problem.

    Sizes come from an archive's directory, before any of its bytes is inflated. An archive with too many files or too
    large ones, or that is none, gives one row with its ``problem``. Bytes that are no UTF-8 are replaced by U+FFFD, as
    a browser reads them. Files without a path of their own are left out; null archives are no archives.
    """

    def entries(name: str, raw: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                files = [e for e in z.infolist() if not e.is_dir()]
                if len(files) > max_files:
                    yield name, None, len(files), None, "too many files"
                elif (total := sum(e.file_size for e in files)) > max_bytes:
                    yield name, None, total, None, "too large"
                else:
                    for e in files:
                        if path := plain_path(e.filename):
                            with z.open(e) as f:  # no more than the directory says, whatever the bytes inflate to
                                yield name, path, e.file_size, f.read(e.file_size).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, OSError) as error:
            yield name, None, None, None, type(error).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in ENTRY.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = list(entries(name, raw.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return archives.select("archive", "content").mapInArrow(run, ENTRY)


def read_archives(spark: SparkSession, folder: str, **limits: int) -> DataFrame:
    """The files of every zip in a folder, by :func:`archived_files`; ``archive`` is the zip's name without its ending."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[zZ][iI][pP]").option("recursiveFileLookup", True).load(folder)
    return archived_files(read.select(F.regexp_extract("path", r"([^/]+)\.[zZ][iI][pP]$", 1).alias("archive"), "content"), **limits)


def read_tree(spark: SparkSession, folder: str, max_file_bytes: int | None = None) -> DataFrame:
    """The files below ``folder``, whose first folder names the project: project, path, size, content.

    Larger files than ``max_file_bytes`` are left out by their size, before they are read; Spark leaves out empty ones.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if max_file_bytes is not None:
        read = read.filter(c("length") <= max_file_bytes)
    root = re.sub(r"^[a-z]+:/*", "/", folder.rstrip("/")).rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(root) + "/", "")
    rows = read.select(below.alias("below"), c("length").alias("size"), "content")
    parts = F.split("below", "/", 2)
    return as_text(rows.filter(c("below").contains("/")).select(F.get(parts, F.lit(0)).alias("project"), plain_path_column(F.get(parts, F.lit(1))).alias("path"), "size", "content"))


def as_text(files: DataFrame) -> DataFrame:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    names = files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in batch.column("content").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if n == "content" else batch.column(n) for n in names], names)

    return files.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.name == 'content' else f.dataType.simpleString()}" for f in files.schema))


def zipped(files: DataFrame, keys: list[str]) -> DataFrame:
    """archive, content (a zip's bytes) of the files (path, content) of each value of ``keys``."""

    def pack(table: pa.Table) -> pa.Table:
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for path, content in zip(table.column("path").to_pylist(), table.column("content").to_pylist(), strict=True):
                info = zipfile.ZipInfo(path)  # a fixed date, so that equal files make equal archives
                info.filename, info.compress_type = path, zipfile.ZIP_DEFLATED
                z.writestr(info, content or "")
        return pa.table({"archive": table.column("archive")[:1].cast(pa.string()), "content": pa.array([raw.getvalue()], pa.binary())})

    named = files.select(F.concat_ws("/", *[c(k).cast("string") for k in keys]).alias("archive"), "path", "content")
    return named.groupBy("archive").applyInArrow(pack, "archive string, content binary")
