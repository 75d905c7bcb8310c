"""Rows that every operator has to take: nulls, empty and long texts, repeated rows, columns with clashing names."""

import contextlib

from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 30_000
ODD = [
    (None, None),
    (None, "a null id"),
    (1, ""),
    (1, ""),
    (2, "same text of some words here"),
    (2, "same text of some words here"),
    (3, "same text of some words here"),
    (4, "   \n\t "),
    (5, LONG),
    (6, "Ünï ¢ode — 文字列 \U0001f642 é \x1c\x85 <|endoftext|>x"),
    (7, "word"),
    (8, "one two three four five six seven eight nine ten eleven twelve"),
]
CLASHING = ("row_no", "part", "at", "tie", "size", "key", "c0", "batch", "n_words", "row", "start", "prefix", "component", "quality", "kept", "length", "found")


def odd(spark, rows=ODD):
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHING}).repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def given(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def bag(rows):
    return sorted(map(repr, rows))


def in_files(spark, folder, rows):
    """Rows in twelve files of different sizes."""
    path = str(folder / "documents.parquet")
    for i in range(12):
        own = [(k, t) for k, t in rows if k % 12 == i]
        spark.createDataFrame(own[: len(own) - i % 3], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
        if i % 3:
            spark.createDataFrame(own[len(own) - i % 3 :], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


@contextlib.contextmanager
def resplit(spark, monkeypatch, module, name):
    """Files are read in one split at first, and in one split each once ``module`` has stored table ``name``."""
    key, stored = "spark.sql.files.openCostInBytes", module.stored
    least = "spark.sql.files.minPartitionNum"

    def then(df, table):
        out = stored(df, table)
        if table == name:
            spark.conf.set(key, str(1 << 40))
        return out

    monkeypatch.setattr(module, "stored", then)
    spark.conf.set(key, "0")
    spark.conf.set(least, "1")
    try:
        yield
    finally:
        spark.conf.unset(key)
        spark.conf.unset(least)
