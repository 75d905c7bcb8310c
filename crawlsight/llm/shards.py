"""Contiguous shards of near-equal bytes from global prefix sums.

Every document has its place in the order (doc_id, crc, size). Range partitions are summed on their own, the totals of
the partitions are summed in their order, and a document's prefix is its partition's base plus the running sum inside
the partition. A shard is cut where the prefix passes an equal share of all bytes. Texts are never shuffled: only
(doc_id, size, crc) rows are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import prefix_sums, range_ordered, stored


def byte_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    size is the UTF-8 length plus 1; a null text counts as no bytes (size 1, crc 0). A null doc_id sorts first, rows
    with one doc_id by crc and size, equal rows in any order. A document goes to the shard in which the middle of its
    bytes lies, so shards differ from the mean by less than the largest document. No rows give no rows; with fewer
    documents than shards some shards are empty. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = stored(range_ordered(rows, "doc_id", "text_crc32", "size"), "shards-order")
    prefix = prefix_sums(placed, "size")
    share = F.expr(f"div((2 * start + size) * {int(shards)}, 2 * total)")
    cut = prefix.withColumn("shard", F.least(F.lit(shards - 1), share).cast("int"))
    sharded = stored(cut.select("doc_id", "size", "text_crc32", "shard", "number"), "shards-cut")
    firsts = sharded.groupBy("shard").agg(F.min("number").alias("first"))  # a row per shard
    return sharded.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("first")).alias("slot"))
