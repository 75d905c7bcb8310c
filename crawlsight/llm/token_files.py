"""Token ids in ORC files: documents in the order of their ids, integers run-length encoded.

ORC writes the ids of many documents as one integer column in run-length form, cut into stripes that tasks read apart;
row indexes hold the least and largest doc_id of every run of rows and Bloom filters the doc_ids in it, so a reader that
asks for some documents skips the rest by metadata.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crawlsight.llm.common import in_arrow, prefix_sums, range_ordered, stored
from crawlsight.llm.vocab import encoder

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "2000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, options: dict[str, str] = ORC_OPTIONS) -> None:
    """Write part, at, doc_id, ids of every document to ORC files under ``path``, in ascending doc_id order.

    A null text has only the end id. Null doc_ids come first; rows with one doc_id follow in the order of their texts'
    hash, equal rows in any order; all of them are written. Other columns are ignored. Texts are range-partitioned
    before they are encoded, so each is encoded once.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    end = end_id.to_bytes(4, "little")

    def ids(batch: pa.RecordBatch) -> dict:
        encode = encoder(vocabulary).encode
        raw = [encode(t) + end for t in batch.column("text").to_pylist()]
        offsets = [0]
        for r in raw:
            offsets.append(offsets[-1] + len(r) // 4)
        flat = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(raw))])
        return {"part": batch.column("part"), "at": batch.column("at"), "doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)}

    ordered = range_ordered(rows, "doc_id", "text_hash").select("part", "at", "doc_id", "text")
    in_arrow(ordered, ids, f"part int, at long, doc_id {kind}, ids array<int>").write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The written rows; filters on doc_id reach row indexes and Bloom filters."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.orc(path)


def token_index(tokens: DataFrame) -> DataFrame:
    """One row per written document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def sums(batch: pa.RecordBatch) -> dict:
        lists = batch.column("ids")
        flat = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        at = lists.offsets.to_pylist()
        spans = [(4 * (a - at[0]), 4 * (b - at[0])) for a, b in zip(at, at[1:], strict=False)]
        return {
            "part": batch.column("part"),
            "at": batch.column("at"),
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array([(b - a) // 4 for a, b in spans], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(flat[a:b]) for a, b in spans], pa.int64()),
        }

    read = in_arrow(tokens, sums, f"part int, at long, doc_id {kind}, n_tokens long, ids_crc32 long")
    return prefix_sums(stored(read, "token-index"), "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")
