"""Packing of documents into sequences by exact complements.

Documents longer than a sequence are cut; what is packed are pieces of 1 to ``capacity`` tokens. Two pieces of one
length are interchangeable, so the plan is made over the number of pieces of each length - at most ``capacity`` numbers,
whatever the size of the corpus - and the pieces then look up their places by (length, rank among that length).

The plan goes from the longest length down. The gap that a piece leaves is looked up as a single length, then, for long
pieces, in the sums of two and of three lengths; a combination that fills the gap exactly is used as often as its lengths
last. What no combination completes is packed best-fit, longest first. How long is long is chosen by the number of
sequences, so that there are never more than best-fit alone makes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsight.llm.common import stored
from crawlsight.llm.vocab import encoder

CAPACITY = 1024
Pattern = tuple[tuple[int, ...], int]  # lengths of one sequence, number of such sequences


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, with what is over in the first."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n_tokens, capacity)]]


class Lengths:
    """How many pieces of each length are still free, and which combinations of lengths have a given sum."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.free = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.free[length] = n

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.free[x]) // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], n: int) -> None:
        for x in lengths:
            self.free[x] -= n

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two free lengths of this sum, as alike as can be: short pieces are kept, which fill what others leave."""
        high = min(most, total - 1)
        low = (total + 1) // 2
        if high < low:
            return None
        a = np.arange(low, high + 1)
        both = np.flatnonzero((self.free[a] > 0) & (self.free[total - a] > (a == total - a)))
        return (int(a[both[0]]), total - int(a[both[0]])) if both.size else None

    def triple(self, total: int, most: int) -> tuple[int, int, int] | None:
        for a in range((total + 2) // 3, min(most, total - 2) + 1):
            if self.free[a] > 0 and (two := self.pair(total - a, a)) and self.times((a, *two)) > 0:
                return (a, *two)
        return None


def exact(counts: dict[int, int], capacity: int, least: int) -> tuple[list[Pattern], dict[int, int]]:
    """Sequences that are filled to the last token, and the pieces that are left.

    All full pieces first, then the gaps that one piece fills exactly, then, of pieces of ``least`` and more, those of
    two and of three, each from the longest piece down.
    """
    lengths, out = Lengths(counts, capacity), []
    finders = (
        (1, lambda gap, longest: () if gap == 0 else None),
        (1, lambda gap, longest: (gap,) if 0 < gap <= longest and lengths.free[gap] > 0 else None),
        (least, lambda gap, longest: lengths.pair(gap, longest) if gap > 1 else None),
        (least, lambda gap, longest: lengths.triple(gap, longest) if gap > 2 else None),
    )
    for down_to, find in finders:
        for longest in range(capacity, down_to - 1, -1):
            while lengths.free[longest] > 0 and (rest := find(capacity - longest, longest)) is not None:
                n = lengths.times((longest, *rest))
                if n == 0:  # the combination needs the last piece of this length more than once
                    break
                lengths.take((longest, *rest), n)
                out.append(((longest, *rest), n))
    return out, {x: int(n) for x, n in enumerate(lengths.free) if n}


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequences for so many pieces of each length. Every piece is placed once; no sequence is over ``capacity``.

    Exact complements, then best-fit for the rest. Sums of two and three fill gaps without waste, but spend the short
    pieces that longer ones would need: down to which length they pay is found by planning with several, and the plan
    with the fewest sequences (of equal ones that with the most exact complements) is it. Best-fit alone is tried too.
    """
    plans = []
    for sixteenth in range(18):
        filled, rest = exact(counts, capacity, sixteenth * capacity // 16 + 1)
        plans.append(filled + best_fit(rest, capacity))
    plans.append(best_fit(counts, capacity))
    return min(plans, key=lambda p: sum(n for _, n in p))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over counts: equal sequences with equal gaps are kept together."""
    open_: dict[tuple[int, ...], int] = {}  # contents -> number
    gaps: list[tuple[int, tuple[int, ...]]] = []  # (gap, contents), sorted

    def add(contents: tuple[int, ...], n: int) -> None:
        if contents not in open_:
            insort(gaps, (capacity - sum(contents), contents))
        open_[contents] = open_.get(contents, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(gaps, (length, ()))
            if at < len(gaps):
                contents = gaps[at][1]
                n = min(left, open_[contents])
                open_[contents] -= n
                if not open_[contents]:
                    del open_[contents]
                    gaps.pop(at)
                add((*contents, length), n)
                left -= n
            else:
                fit = min(capacity // length, left)  # a new sequence takes more of the same length before another opens
                n = left // fit
                add((length,) * fit, n)
                left -= n * fit
    return list(open_.items())


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence_from, offset): where the pieces of a length go, by their rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            rank = used.get(x, 0)
            out.append((x, rank, rank + n, sequence, offset))
            used[x] = rank + n
            offset += x
        sequence += n
    return out


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and place: the piece's number in its task among its length."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = ("piece", "start", "length", "ids_crc32", "place")

    def run(batches):
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        encode = encoder(vocabulary).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows, of = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = encode(text) + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), seen[length]))
                        seen[length] += 1
                        of.append(i)
                columns = {"doc_id": batch.column("doc_id").take(pa.array(of, pa.int64()))}
                columns |= {n: pa.array([r[j] for r in rows], pa.int64()) for j, n in enumerate(names)}
                yield pa.RecordBatch.from_pydict(columns | {"part": pa.array([part] * len(rows), pa.int32())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece long, start long, length long, ids_crc32 long, place long, part int")


def packed(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, its end id. Rows are packed as they stand: repeated rows are packed again, null
    ids are kept, other columns are ignored, an empty table gives no rows. Offsets in a sequence run gapless from 0.
    """
    spark = docs.sparkSession
    rows = stored(pieces(docs, vocabulary, end_id, capacity), "packing-pieces")
    counts = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = rows.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    found = places(plan(by_length, capacity))
    # the rows of the plan follow from the lengths, not from the documents: a few thousand at most
    table = spark.createDataFrame(found, "at_length long, rank_from long, rank_to long, sequence_from long, offset long")
    hit = (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(F.broadcast(table), hit).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"
    )
