"""How many texts hold a shingle, asked batch by batch, and the texts whose rarest shingles others have too.

The method of ``crawlsight.llm.jaccard``, kept here as well, since the audits run without that package. Texts are stored in
batches; a batch asks each partition of the shingles once, with its distinct ones as a sorted array, and gets an array of
counts back. The counts decide the order only, so they may be kept for 40-bit prefixes and coarsely above 128.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight import session

#: Bytes of text in a batch.
BATCH = 8 << 20
#: Shingles of all batches that one partition counts at once, at about 60 bytes each.
PARTITION = 3_000_000
#: Longs of the bitmap of a set.
BITMAP = 8
KEY_BITS = 40
#: Lower-cases A-Z only, in UTF-8 bytes.
LOWER_AZ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def numbered(docs: DataFrame) -> DataFrame:
    """A number for each row: its split and its place there. What reads the numbers twice reads them from a stored table."""
    return docs.withColumn("row_no", F.monotonically_increasing_id())


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``df`` stored in the shared folder in buckets of ``batch``: a join on it moves only the other side."""
    path = f"{session.shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "batch").saveAsTable(table)
    return df.sparkSession.table(table)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; fewer words make one, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    mixed = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        mixed = (mixed ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


@dataclass(frozen=True)
class Similarity:
    """Linked: ``den`` * intersection >= ``num`` * union, over shingles of ``words`` words."""

    words: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, size: int) -> int:
        """So many first elements of a set of this size that a similar set must share one of them."""
        return size + (-self.num * size // self.den) + 1

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)

    def may_link(self, a: str, b: str) -> Column:
        """Length, positional and suffix filter on two postings of one shingle: columns n, at, alone and bits."""
        na, nb, ia, ib = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.at"), F.col(f"{b}.at")
        length = (self.num * na <= self.den * nb) & (self.num * nb <= self.den * na)
        most = F.least(ia - F.col(f"{a}.alone"), ib - F.col(f"{b}.alone")) + 1 + F.least(na - ia - 1, nb - ib - 1)
        position = (self.num + self.den) * most >= self.num * (na + nb)
        differ = sum((F.bit_count(F.col(f"{a}.b{i}").bitwiseXOR(F.col(f"{b}.b{i}"))) for i in range(1, BITMAP)), F.bit_count(F.col(f"{a}.b0").bitwiseXOR(F.col(f"{b}.b0"))))
        suffix = (self.num + self.den) * differ <= (self.den - self.num) * (na + nb)
        return length & position & suffix


def bitmap(sets: np.ndarray) -> np.ndarray:
    """Parities of the number of elements in 64 * BITMAP classes: two bitmaps differ in no more bits than the sets do
    in elements."""
    bits = np.bincount((sets % np.uint64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def batches(docs: DataFrame, size: int = BATCH) -> DataFrame:
    """batch, row_nos, doc_ids, texts: rows of ``numbered`` documents in groups of about ``size`` bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        for part in parts:
            lengths = pa.compute.fill_null(pa.compute.binary_length(part.column("text")), 0).to_numpy()
            group = (np.cumsum(lengths) - lengths) // size
            for a, b in zip(starts := np.flatnonzero(np.diff(group, prepend=-1)), [*starts[1:], part.num_rows], strict=True):
                own = part.slice(a, b - a)
                offsets = pa.array([0, own.num_rows], pa.int32())
                lists = {name: pa.ListArray.from_arrays(offsets, own.column(c)) for name, c in (("row_nos", "row_no"), ("doc_ids", "doc_id"), ("texts", "text"))}
                yield pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64())} | lists)
                number += 1

    return docs.select("row_no", "doc_id", "text").mapInArrow(run, f"batch long, row_nos array<long>, doc_ids array<{kind}>, texts array<string>")


def sets_of(row: dict, sim: Similarity) -> list[tuple[int, np.ndarray]]:
    """(row_no, set) of the first documents of the classes in a batch."""
    return [(row["row_nos"][i], shingles(row["texts"][i], sim.words)) for i in sorted(row["firsts"])]


def short_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct short keys of all sets, and the place of every element in them."""
    flat = np.concatenate(sets) >> np.uint64(64 - KEY_BITS)
    return np.unique(flat, return_inverse=True)


def partition_starts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partitions are ranges of the key."""
    edges = (np.arange(parts + 1, dtype=object) * (1 << KEY_BITS) // parts).astype(np.uint64)
    return np.searchsorted(keys, edges)


def planes(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, one plane of bytes after the other, so that high bytes, mostly zero, compress."""
    raw = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return raw[:, : KEY_BITS // 8].T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(KEY_BITS // 8, -1)
    wide = np.zeros((own.shape[1], 8), np.uint8)
    wide[:, : KEY_BITS // 8] = own.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def ask(rows: DataFrame, sim: Similarity, parts: int) -> DataFrame:
    """Each batch's distinct n-grams and in how many of its classes they are, by partition."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row in table.to_pylist():
                keys, place = short_keys([s for _, s in sets_of(row, sim)])
                counts = np.bincount(place, minlength=len(keys)).astype("<u4")
                at = partition_starts(keys, parts)
                for p in np.flatnonzero(np.diff(at)):
                    own = slice(at[p], at[p + 1])
                    columns = {"part": pa.array([p], pa.int32()), "batch": pa.array([row["batch"]], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | {"keys": [planes(keys[own])], "counts": [counts[own].view(np.uint8).reshape(-1, 4).T.tobytes()]})

    return rows.select("batch", "row_nos", "texts", "firsts").mapInArrow(run, "part int, batch long, keys binary, counts binary")


def rarity(counts: np.ndarray) -> np.ndarray:
    """Counts in one byte: themselves up to 128, in eighths of a power of two above."""
    high = 128 + 8 * np.log2(np.maximum(counts, 128) / 128)
    return np.where(counts < 128, counts, np.minimum(255, high)).astype(np.uint8)


def answer(asked: DataFrame) -> DataFrame:
    """For each asked slice the rarity of its n-grams among all classes."""

    def group(table: pa.Table) -> pa.Table:
        owns = [from_planes(k) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for c in table.column("counts").to_pylist()])
        distinct, place = np.unique(np.concatenate(owns), return_inverse=True)
        code = rarity(np.bincount(place, weights=counts, minlength=len(distinct)))[place]
        at = np.cumsum([0, *map(len, owns)])
        codes = [code[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]
        return pa.table({"part": table.column("part"), "batch": table.column("batch"), "codes": pa.array(codes, pa.binary())})

    return asked.groupBy("part").applyInArrow(group, "part int, batch long, codes binary")


def candidates(rows: DataFrame, sim: Similarity) -> DataFrame:
    """Classes whose prefix has an n-gram that another class has too: row_no, n, alone (elements that no other class
    has), hub (how much the others are shared, on the mean), elements (the set), b0.. (its bitmap), prefix (shingle and
    at, its place in the rare-first order)."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row in table.to_pylist():
                own = sets_of(row, sim)
                _, place = short_keys([s for _, s in own])
                codes = np.concatenate([np.frombuffer(a["codes"], np.uint8) for a in sorted(row["answers"], key=lambda a: a["part"])])[place]
                out, at = [], 0
                for row_no, s in own:
                    code = codes[at : at + len(s)]
                    at += len(s)
                    length, alone = sim.prefix(len(s)), int((code == 1).sum())
                    if alone >= length:
                        continue
                    order = np.lexsort((s, code))[:length]
                    shared = np.flatnonzero(code[order] > 1)
                    prefix = [{"shingle": int(x), "at": int(i)} for x, i in zip(s[order[shared]].view(np.int64), shared, strict=True)]
                    hub = (int(code.sum()) - alone) / len(s)
                    out.append((row_no, len(s), alone, hub, s.tobytes(), *bitmap(s).tolist(), prefix))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), *[pa.int64()] * BITMAP, pa.list_(pa.struct([("shingle", pa.int64()), ("at", pa.int64())])))
                names = ("row_no", "n", "alone", "hub", "elements", *[f"b{i}" for i in range(BITMAP)], "prefix")
                yield pa.RecordBatch.from_pydict({c: pa.array([x[j] for x in out], k) for j, (c, k) in enumerate(zip(names, kinds, strict=True))})

    bits = ", ".join(f"b{i} long" for i in range(BITMAP))
    return rows.mapInArrow(run, f"row_no long, n long, alone long, hub double, elements binary, {bits}, prefix array<struct<shingle: long, at: long>>")
