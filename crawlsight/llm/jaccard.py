"""Near-duplicate documents by the Jaccard similarity of their word n-grams: a prefix-filtered join, rare n-grams first.

1. Documents with equal sets are one class; from here on a class is its first document.
2. The number of classes that hold an n-gram is counted for all n-grams. All sets are put in one order, rare first.
3. Two sets that are similar enough share an n-gram among the first few of both (prefix filter). Only n-grams that some
   other class has too make a posting, so most documents make none.
4. Postings of one n-gram meet. First each class is paired with one other only and verified: with the hub of an n-gram's
   classes, the one whose n-grams are shared the most. Among copies that were edited each in its own way, the least
   edited one is similar to all that are similar to any, so large groups join without their pairs. Then pairs across
   groups follow, of which one side is outside the n-gram's largest group. Lengths, positions and a bitmap of the whole
   set (a bound on what the two suffixes can still share) are tested in the join; what passes is verified once per pair,
   exactly. N-grams that no other class has lie before a posting but cannot be common, so positions do not count them.

The counts do not come by a join on n-grams. A batch of documents asks each partition of the n-gram table once, with its
distinct n-grams as a sorted array, and gets an array of counts back; batches are stored bucketed by their number, so
texts do not move for that. The counts decide the order only, so they may be kept for 40-bit prefixes of the n-grams'
hashes and coarsely above 128 without changing a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import LOWER_AZ, bucketed, numbered, stored, with_texts

#: Bytes of text in a batch.
BATCH = 8 << 20
#: N-grams of all batches that one partition of the table counts at once, at about 60 bytes each.
PARTITION = 3_000_000
#: Longs of the bitmap of a set.
BITMAP = 8
KEY_BITS = 40


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


def classes_of(rows: DataFrame, sim: Similarity) -> DataFrame:
    """One row per document: batch, place, row_no, doc_id, n_shingles, key (of its set; null for an empty one)."""
    kind = dict(rows.dtypes)["doc_ids"].removeprefix("array<")[:-1]

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for i in range(table.num_rows):
                texts = table.column("texts")[i].values.to_pylist()
                sizes, keys = [], []
                for text in texts:
                    s = shingles(text, sim.words)
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                yield pa.RecordBatch.from_pydict(
                    {
                        "batch": pa.array([table.column("batch")[i].as_py()] * len(texts), pa.int64()),
                        "place": pa.array(range(len(texts)), pa.int32()),
                        "row_no": table.column("row_nos")[i].values,
                        "doc_id": table.column("doc_ids")[i].values,
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "key": pa.array(keys, pa.binary()),
                    }
                )

    return rows.select("batch", "row_nos", "doc_ids", "texts").mapInArrow(run, f"batch long, place int, row_no long, doc_id {kind}, n_shingles long, key binary")


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


def verified(pairs: DataFrame, sets: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, each tested once on the whole sets."""
    a = sets.select(F.col("row_no").alias("a"), F.col("elements").alias("set_a"))
    b = sets.select(F.col("row_no").alias("b"), F.col("elements").alias("set_b"))

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            keep = []
            for x, y in zip(table.column("set_a"), table.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(sim.linked(common, len(x), len(y)))
            yield table.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``links`` (a, b).

    Every round a node takes the smallest component among its neighbours and itself, then that component's own; the
    labels of a round are a stored table. Rounds grow with the logarithm of a component's width, not with its size.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        taken = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("taken"))
        up = labels.select(F.col("node").alias("up"), F.col("component").alias("over"))
        new = stored(taken.join(up, F.col("taken") == F.col("up"), "left").select("node", F.least("taken", F.coalesce("over", "taken")).alias("component"), F.col("component").alias("before")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> before").isEmpty():
            return labels


def postings_of(sets: DataFrame) -> DataFrame:
    """A row per class and n-gram of its prefix that others have too, with what :meth:`Similarity.may_link` asks for."""
    own = ["row_no", "n", "alone", "hub", *[f"b{i}" for i in range(BITMAP)]]
    return stored(sets.select(*own, F.explode("prefix").alias("p")).select(*own, "p.shingle", "p.at"), "postings")


def all_links(sets: DataFrame, sim: Similarity) -> DataFrame:
    """Every link (a, b) between candidates, verified: as many rows as there are similar pairs of different sets."""
    postings = postings_of(sets)
    met = postings.alias("x").join(postings.alias("y"), "shingle").filter((F.col("x.row_no") < F.col("y.row_no")) & sim.may_link("x", "y"))
    pairs = stored(met.select(F.col("x.row_no").alias("a"), F.col("y.row_no").alias("b")).distinct(), "all-pairs")
    return verified(pairs, sets.select("row_no", "elements"), sim)


def links(sets: DataFrame, sim: Similarity) -> DataFrame:
    """Links (a, b) between candidates, enough to join every two that a chain of similar pairs joins.

    A pair is left out only if both are in one group already.
    """
    postings = postings_of(sets)
    best_hub = F.struct("hub", (-F.col("row_no")).alias("before"), "row_no", "n", "at", "alone", *[f"b{i}" for i in range(BITMAP)])
    hubs = stored(postings.groupBy("shingle").agg(F.max(best_hub).alias("f"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("shingle", "f.*"), "blocks")
    led = postings.alias("x").join(hubs.alias("y"), "shingle").filter(F.col("x.row_no") != F.col("y.row_no")).filter(sim.may_link("x", "y"))
    votes = led.groupBy(F.col("x.row_no").alias("b"), F.col("y.row_no").alias("a"), F.col("y.hub").alias("hub")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("b").agg(F.max(F.struct("votes", "hub", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    one = stored(verified(stored(best, "first-pairs"), sets.select("row_no", "elements"), sim), "first-links")
    groups = components(one)

    grouped = postings.join(groups, F.col("row_no") == F.col("node"), "left").withColumn("c", F.coalesce("component", "row_no")).drop("node", "component")
    per_group = grouped.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("size"))
    # blocks that hold several groups, and the largest group of each
    mixed = stored(per_group.groupBy("shingle").agg(F.max(F.struct("size", "c")).alias("m"), F.count(F.lit(1)).alias("n_groups")).filter("n_groups > 1").select("shingle", F.col("m.c").alias("largest")), "mixed-blocks")
    rows = stored(grouped.join(mixed, "shingle"), "mixed-postings")
    x, y = rows.filter("c <> largest").alias("x"), rows.alias("y")
    across = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") != F.col("y.c")) & sim.may_link("x", "y"))
    pairs = across.select(F.least("x.row_no", "y.row_no").alias("a"), F.greatest("x.row_no", "y.row_no").alias("b")).distinct()
    two = verified(stored(pairs, "second-pairs"), sets.select("row_no", "elements"), sim)
    return stored(one.unionByName(two), "all-links")


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """One row per document: row_no, doc_id, n_shingles, component_id, component.

    component_id is the smallest doc_id of the documents that links reach (null if all are null), component the smallest
    row_no of the classes that they do. Documents without words have an empty set and are linked with nothing, not
    with each other. Repeated rows and equal sets are linked. Other columns are ignored; no rows give no rows.
    """
    members, labelled = near_classes(numbered(docs.select("doc_id", "text")), sim)
    per_group = stored(labelled.groupBy("component").agg(F.min("least_id").alias("component_id")), "jaccard-groups")
    named = stored(labelled.join(per_group, "component").select("key", "component", "component_id"), "jaccard-named")
    found = members.filter("key is not null").join(named, "key").select("row_no", "doc_id", "n_shingles", "component_id", "component")
    alone = members.filter("key is null").select("row_no", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("row_no").alias("component"))
    return found.unionByName(alone)


def similar_classes(docs: DataFrame, sim: Similarity = Similarity()) -> tuple[DataFrame, DataFrame]:
    """The whole join: class_no of every document (row_no, doc_id; null without words), and every link between classes
    with different sets (a, b; class numbers, a < b) once.

    Links are as many as there are similar pairs of different sets, which in a large group of edited copies grows with
    its square; components need far fewer (:func:`near_duplicates`). Nulls, empty texts and repeated rows as there.
    """
    members, classes, sets = prepared(numbered(docs.select("doc_id", "text")), sim)
    named = members.join(classes.select("key", F.col("f.row_no").alias("class_no")), "key", "left")
    return named.select("row_no", "doc_id", "class_no"), all_links(sets, sim)


def prepared(docs: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows that have their row_no: the documents with the key of their set, the classes, the candidates' sets."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(batches(docs), "jaccard-batches", buckets)
    members = stored(classes_of(rows, sim), "jaccard-members")
    filled = members.filter("key is not null")
    first, stays = F.min(F.struct("row_no", "batch", "place")), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    classes = stored(filled.groupBy("key").agg(first.alias("f"), F.min("doc_id").alias("least_id"), stays.alias("stays")), "jaccard-classes")
    firsts = stored(classes.groupBy("f.batch").agg(F.collect_list("f.place").alias("firsts")), "jaccard-firsts")
    total = filled.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(buckets, math.ceil(total / PARTITION))

    own = rows.join(firsts, "batch")
    codes = stored(answer(ask(own, sim, parts)), "jaccard-rarity")
    answers = codes.groupBy("batch").agg(F.collect_list(F.struct("part", "codes")).alias("answers"))
    return members, classes, stored(candidates(own.join(answers, "batch").select("batch", "row_nos", "texts", "firsts", "answers"), sim), "jaccard-candidates")


def near_classes(docs: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """The documents with the key of their set, and each key's least_id, stays (its first document) and component."""
    members, classes, sets = prepared(docs, sim)
    groups = components(links(sets, sim))
    labelled = classes.select("key", "least_id", "stays", F.col("f.row_no").alias("row_no")).join(groups, F.col("row_no") == F.col("node"), "left")
    return members, stored(labelled.select("key", "least_id", "stays", F.coalesce("component", "row_no").alias("component")), "jaccard-labels")


def one_of_each(docs: DataFrame, sim: Similarity = Similarity()) -> DataFrame:
    """The rows of ``docs``, with all their columns, that come first in their group: smallest doc_id, then first row.

    A null doc_id comes after all others. Null and empty texts, and those of white space, have no words: such rows all
    stay, repeated or not. Of other repeated rows one stays.
    """
    names = docs.columns
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split, place = F.shiftright("row_no", 33), F.col("row_no").bitwiseAND((1 << 33) - 1)  # of monotonically_increasing_id
    rows = bucketed(numbered(docs.toDF(*[f"c{i}" for i in range(len(names))])).withColumn("batch", split), "numbered_documents", buckets)
    members, labelled = near_classes(with_texts(rows, names), sim)
    first = labelled.groupBy("component").agg(F.min("stays").alias("m")).select("m.row_no")
    stay = stored(first.unionByName(members.filter("key is null").select("row_no")), "near-duplicates")

    def marks(table: pa.Table) -> pa.Table:
        at = table.column("place").to_numpy()
        bits = np.zeros(int(at.max()) + 1, np.uint8)
        bits[at] = 1
        return pa.table({"batch": table.column("batch")[:1], "marks": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    # one bitmap of the rows that stay for each split that was numbered; texts lie in buckets by split and do not move
    staying = stored(stay.select(split.alias("batch"), place.alias("place")).groupBy("batch").applyInArrow(marks, "batch long, marks binary"), "rows-that-stay")
    byte = F.conv(F.hex(F.expr("substring(marks, cast(place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.pow(F.lit(2), 7 - F.col("place") % 8).cast("int")
    marked = rows.withColumn("place", place).join(staying, "batch").filter(byte.bitwiseAND(bit) != 0)
    return marked.select(*[F.col(f"c{i}") for i in range(len(names))]).toDF(*names)
