"""User rules over finished scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.conversion import ArrowTableToRowsConversion
from pyspark.sql.types import StructType

c = F.col


def registry(rules: DataFrame) -> DataFrame:
    """``udf_rule_registry``: newest version of each rule, enabled ones only."""
    newest = rules.groupBy("rule_id").agg(F.max_by(F.struct("enabled", "updated_at"), "updated_at").alias("r"))
    return newest.select("rule_id", "r.enabled", "r.updated_at").filter("enabled")


def run_rules(scan: DataFrame, rules: list[tuple[str, str | Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``udf_custom_rules``: each rule is a SQL predicate or a DataFrame function.

    A rule that does not compile is reported beside the findings and does not stop the others.
    """
    out, errors = None, []
    for rule_id, rule in rules:
        try:
            hit = rule(scan) if callable(rule) else scan.filter(F.expr(rule))
            rows = hit.withColumn("custom_rule", F.lit(rule_id)).withColumn("severity", F.lit("info")).withColumn("title", F.lit("Untitled finding"))
            rows = rows.select("custom_rule", "severity", "title", *scan.columns)
        except Exception as e:  # user code
            errors.append((rule_id, str(e).splitlines()[0]))
            continue
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = scan.limit(0).select(F.lit("").alias("custom_rule"), F.lit("").alias("severity"), F.lit("").alias("title"), "*")
    return out, errors


def row_rules(scan: DataFrame, rules: dict[str, Callable], keys: list[str]) -> DataFrame:
    """``udf_custom_rules`` as Python: each rule sees one row and says what it found (a text, or None for nothing).

    The result has the ``keys`` of the row, whatever their types, and custom_rule, found, error. A rule that fails on a
    row gives that row's error and goes on with the next; the other rules are not touched. Rows come and go in Arrow
    batches: only what a rule sees and says is made in Python.
    """
    schema, own = scan.schema, [f for f in scan.schema.fields if f.name in keys]
    tried = list(rules.items())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, names, texts, errors = [], [], [], []
            for i, row in enumerate(ArrowTableToRowsConversion.convert(pa.Table.from_batches([part]), schema)):
                for name, rule in tried:
                    try:
                        found, error = rule(row), None
                    except Exception as e:  # user code
                        found, error = None, f"{type(e).__name__}: {e}"
                    if found is not None or error is not None:
                        at.append(i)
                        names.append(name)
                        texts.append(None if found is None else str(found))
                        errors.append(error)
            of = part.take(pa.array(at, pa.int64()))
            said = [pa.array(x, pa.string()) for x in (names, texts, errors)]
            yield pa.RecordBatch.from_arrays([of.column(f.name) for f in own] + said, [f.name for f in own] + ["custom_rule", "found", "error"])

    return scan.mapInArrow(run, StructType([*own]).add("custom_rule", "string").add("found", "string").add("error", "string"))
