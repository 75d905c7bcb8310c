"""A Katz back-off bigram model of the corpus, and the log probability of every text under it.

p(w | v) = d(c(v w)) c(v w) / c(v) where the pair was seen, else alpha(v) p(w); p(w) likewise backs off to one class of
unknown words. d are Good-Turing discounts of the counts up to K, and alpha(v) is what makes the probabilities after v
sum to exactly 1 over all known words and the unknown class.

Counts are kept in tables that are partitioned by word (or context). A batch of documents does not look up every token:
it asks each partition once for its distinct words, and later for its distinct pairs, as sorted arrays, and gets the
answers as arrays in the same order. Batches are stored once, bucketed by their number, so that answers are joined to
them without moving the texts. A context with more than its share of the tokens is split over all partitions by its
second word; its sums are added up afterwards, one row per partition and context.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsight.llm.common import LOWER_AZ, bucketed, stored

K = 5
#: Tokens in a batch: what a task holds at once, beside one text.
BATCH = 1_600_000
#: Distinct words or pairs that a partition of a table answers for, at about 100 bytes each while it works.
PARTITION = 1_200_000
#: The most frequent words of a partition that are looked at when contexts are split. Splitting changes no result.
TOP = 64
END = xxhash.xxh64_intdigest(b"\n")  # no word has a line feed
REMEMBERED = 500_000


def held_out(doc_id: object, folds: int = 7, fold: int = 2) -> bool:
    """crc32 of the id as text decides; a null id is the empty text."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == fold


_hashes: dict[bytes, int] = {}


def token_hashes(text: str | None) -> list[int]:
    """64-bit hashes of the words (A-Z lower-cased), then of the end."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    get = _hashes.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _hashes[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    out.append(END)
    return out


def batches(docs: DataFrame, size: int = BATCH) -> DataFrame:
    """batch, doc_ids, sizes (tokens of each document), held, words (their hashes, sorted), tokens (places in words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, hashes, sizes = TaskContext.get().partitionId() << 24, [], [], []

        def row() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
            held = bytes(held_out(i) for i in ids)
            columns = {"batch": pa.array([number], pa.int64()), "doc_ids": pa.array([ids], pa.list_(id_type)), "sizes": [np.array(sizes, "<u4").tobytes()], "held": [held]}
            return pa.RecordBatch.from_pydict(columns | {"words": [words.astype("<u8").tobytes()], "tokens": [tokens.astype("<u4").tobytes()]})

        total = 0
        for part in parts:
            id_type = part.column("doc_id").type
            for doc_id, text in zip(part.column("doc_id"), part.column("text"), strict=True):
                h = np.array(token_hashes(text.as_py()), np.uint64)
                if total and total + len(h) > size:
                    yield row()
                    number, total = number + 1, 0
                    ids, hashes, sizes = [], [], []
                ids.append(doc_id.as_py())
                hashes.append(h)
                sizes.append(len(h))
                total += len(h)
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(run, f"batch long, doc_ids array<{kind}>, sizes binary, held binary, words binary, tokens binary")


@dataclass
class Batch:
    """One row of :func:`batches`, as arrays."""

    sizes: np.ndarray
    held: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Batch:
        return cls(np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["held"], "u1") > 0, np.frombuffer(row["words"], "<u8"), np.frombuffer(row["tokens"], "<u4").astype(np.int64))

    @property
    def trains(self) -> np.ndarray:
        """Whether each token stands in a document that the model learns from."""
        return np.repeat(~self.held, self.sizes)

    def pairs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of each token as numbers of the vocabulary plus 1; the context at a start is 0."""
        now = ids[self.tokens] + 1
        before = np.empty_like(now)
        before[1:] = now[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = 0
        return before, now


def slices(sorted_keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` begins in sorted partition numbers, and the end."""
    return np.searchsorted(sorted_keys, np.arange(parts + 1))


def word_partition(words: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash: sorted hashes stay in runs."""
    return ((words >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def pair_partition(context: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """Contexts by their own hash; hot contexts by context and word."""
    mixed = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= np.where(np.isin(context, hot), word.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def ask_words(rows: DataFrame, parts: int) -> DataFrame:
    """Each batch's distinct words with their counts in training documents, by partition of the vocabulary."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row in table.to_pylist():
                b = Batch.of(row)
                counts = np.bincount(b.tokens[b.trains], minlength=len(b.words)).astype("<u4")
                at = slices(word_partition(b.words, parts), parts)
                for p in np.flatnonzero(np.diff(at)):
                    own = slice(at[p], at[p + 1])
                    columns = {"part": pa.array([p], pa.int32()), "batch": pa.array([row["batch"]], pa.int64())}
                    yield pa.RecordBatch.from_pydict(columns | {"keys": [b.words[own].tobytes()], "counts": [counts[own].tobytes()]})

    return rows.select("batch", "sizes", "held", "words", "tokens").mapInArrow(run, "part int, batch long, keys binary, counts binary")


WORD_ANSWERS = "part int, batch long, places binary, counts binary, known long, tokens long, spectrum array<long>, distinct long, top array<struct<place: long, count: long>>"


def answer_words(asked: DataFrame) -> DataFrame:
    """For each asked slice: its words' places in the partition and their counts in all training documents.

    One more row per partition (batch -1) has its number of training words and tokens, how many words occur 1 to K + 1
    times, the number of distinct words, and the most frequent words.
    """

    def group(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u8") for k in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in table.column("counts").to_pylist()]).astype(np.int64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, weights=counts, minlength=len(distinct)).astype(np.int64)
        at = np.cumsum([0, *map(len, keys)])
        owns = [place[a:b] for a, b in zip(at, at[1:], strict=False)]
        part, n = table.column("part")[0].as_py(), len(keys)
        spectrum = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()
        top = [{"place": int(i), "count": int(total[i])} for i in np.argsort(total)[-TOP:]]
        return pa.table(
            {
                "part": pa.array([part] * (n + 1), pa.int32()),
                "batch": pa.array([*table.column("batch").to_pylist(), -1], pa.int64()),
                "places": pa.array([*[o.astype("<u4").tobytes() for o in owns], None], pa.binary()),
                "counts": pa.array([*[total[o].astype("<u4" if total.max() < 1 << 32 else "<u8").tobytes() for o in owns], None], pa.binary()),
                "known": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
                "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
                "spectrum": pa.array([None] * n + [spectrum], pa.list_(pa.int64())),
                "distinct": pa.array([None] * n + [len(distinct)], pa.int64()),
                "top": pa.array([None] * n + [top], pa.list_(pa.struct([("place", pa.int64()), ("count", pa.int64())]))),
            }
        )

    return asked.groupBy("part").applyInArrow(group, WORD_ANSWERS)


@dataclass(frozen=True)
class Discounts:
    """factor[r] for counts r up to K (0 and above K: 1)."""

    factor: tuple[float, ...]

    @classmethod
    def of(cls, spectrum: list[int]) -> Discounts:
        """Good-Turing as Katz has it. Where the spectrum is too thin for that, every small count loses the share
        n1 / (n1 + 2 n2) of one, or a half if no count is 1."""
        n = [0, *spectrum]
        try:
            much = (K + 1) * n[K + 1] / n[1]
            factor = [1.0, *[((r + 1) * n[r + 1] / (n[r] * r) - much) / (1 - much) for r in range(1, K + 1)]]
        except ZeroDivisionError:
            factor = [0.0]
        if not all(0 < f <= 1 for f in factor) or min(factor[1:], default=1.0) >= 1:
            less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            factor = [1.0, *[(r - less) / r for r in range(1, K + 1)]]
        return cls(tuple([*factor, 1.0]))

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.asarray(self.factor)[np.minimum(counts, K + 1)] * counts


@dataclass(frozen=True)
class Unigrams:
    """The bottom of the model. ``mass`` is what discounting leaves to unknown words."""

    tokens: int
    known: int
    starts: int
    discounts: Discounts
    kept: float

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """Counts of 0 get the unknown class's probability; all words and that class sum to 1.

        If discounting leaves nothing (no count is small), one more token is reckoned, and it is the unknown one.
        """
        n = max(1, self.tokens + (self.kept >= self.tokens))
        return np.where(counts > 0, self.discounts.kept(counts) / n, 1 - self.kept / n)


def ask_pairs(rows: DataFrame, parts: int, word_parts: int, width: int, unigrams: Unigrams, hot: np.ndarray) -> DataFrame:
    """Each batch's distinct pairs, by partition: contexts once with their number of words, words, counts in training,
    and the words' unigram counts."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for row in table.to_pylist():
                p = Pairs.of(row, word_parts, width, hot, parts)
                seen = np.bincount(p.which[p.batch.trains], minlength=len(p.context))
                at = slices(p.part, parts)
                for k in np.flatnonzero(np.diff(at)):
                    own = slice(at[k], at[k + 1])
                    context, runs = np.unique(p.context[own], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array([k], pa.int32()),
                            "batch": pa.array([row["batch"]], pa.int64()),
                            "contexts": [narrow(context)],
                            "runs": [narrow(runs)],
                            "context_counts": [narrow(p.count_of(context, unigrams.starts))],
                            "words": [narrow(p.word[own])],
                            "counts": [narrow(seen[own])],
                            "word_counts": [narrow(p.count_of(p.word[own], 0))],
                        }
                    )

    kinds = ", ".join(f"{c} binary" for c in ("contexts", "runs", "context_counts", "words", "counts", "word_counts"))
    return rows.mapInArrow(run, f"part int, batch long, {kinds}")


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, after one byte that says how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(values) or int(values.max()) <= np.iinfo(k).max)
    return kind[2].encode() + values.astype(kind).tobytes()


def widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{chr(raw[0])}", offset=1).astype(np.int64)


@dataclass
class Pairs:
    """A batch's distinct pairs in the order (part, context, word), and which of them each token is."""

    batch: Batch
    context: np.ndarray
    word: np.ndarray
    part: np.ndarray
    which: np.ndarray
    ids: np.ndarray  # of the batch's words, ascending
    counts: np.ndarray  # of the batch's words in all training documents

    @classmethod
    def of(cls, row: dict, word_parts: int, width: int, hot: np.ndarray, parts: int) -> Pairs:
        b = Batch.of(row)
        answers = sorted(row["answers"], key=lambda a: a["part"])
        ids = np.concatenate([np.frombuffer(a["places"], "<u4").astype(np.int64) + a["part"] * width for a in answers])
        counts = np.concatenate([np.frombuffer(a["counts"], "<u4" if len(a["counts"]) == len(a["places"]) else "<u8").astype(np.int64) for a in answers])
        before, now = b.pairs(ids)
        local = np.concatenate([[0], ids + 1])  # ascending: words are sorted by hash, partitions are ranges of it
        key = np.searchsorted(local, before) * len(local) + np.searchsorted(local, now)
        distinct, which = np.unique(key, return_inverse=True)
        context, word = local[distinct // len(local)], local[distinct % len(local)]
        part = pair_partition(context, word, hot, parts)
        order = np.argsort(part, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return cls(b, context[order], word[order], part[order], rank[which], ids, counts)

    def count_of(self, numbers: np.ndarray, starts: int) -> np.ndarray:
        """Training counts of vocabulary numbers plus 1; 0 is the start of a text."""
        at = np.searchsorted(self.ids, np.maximum(numbers - 1, 0))
        return np.where(numbers == 0, starts, self.counts[np.minimum(at, len(self.counts) - 1)])


def distinct_pairs(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, place): where each distinct pair stands first, ordered by context and word, and the place of every pair."""
    words, w = np.unique(word, return_inverse=True)
    _, c = np.unique(context, return_inverse=True)
    _, first, place = np.unique(c * len(words) + w, return_index=True, return_inverse=True)
    return first, place


def sums_by_context(context: np.ndarray, total: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct contexts, how many of their seen words have each count 1 to K (columns), and the words' unigram mass."""
    contexts, c = np.unique(context, return_inverse=True)
    small = (total >= 1) & (total <= K)
    counts = np.bincount(c[small] * K + total[small] - 1, minlength=len(contexts) * K).reshape(-1, K)
    return contexts, counts, np.bincount(c, weights=np.where(total > 0, chance, 0.0), minlength=len(contexts))


PAIR_ANSWERS = "part int, batch long, totals binary, discounted binary, counts binary, chances binary, spectrum array<long>, hot array<struct<context: long, counts: array<long>, chance: double>>"


def answer_pairs(asked: DataFrame, unigrams: Unigrams, hot: np.ndarray) -> DataFrame:
    """For each asked slice: the counts of its pairs in all training documents; for each of its contexts whether any of
    its counts is discounted (a bit); and for contexts with a pair that training has not, what alpha is made of: how
    many of the context's words have each small count, and their unigram mass.

    One more row per partition (batch -1) has how many pairs occur 1 to K + 1 times, and the partition's share of the
    sums of the hot contexts.
    """

    def group(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        owns = [np.repeat(widened(r["contexts"]), widened(r["runs"])) for r in rows]
        context, word = np.concatenate(owns), np.concatenate([widened(r["words"]) for r in rows])
        counts, word_counts = (np.concatenate([widened(r[c]) for r in rows]) for c in ("counts", "word_counts"))
        first, place = distinct_pairs(context, word)
        total = np.bincount(place, weights=counts, minlength=len(first)).astype(np.int64)
        contexts, small, chance = sums_by_context(context[first], total, unigrams.probability(word_counts[first]))
        at = np.cumsum([0, *map(len, owns)])
        out = {c: [] for c in ("totals", "discounted", "counts", "chances")}
        for r, a, b in zip(rows, at, at[1:], strict=False):
            own, known = total[place[a:b]], widened(r["context_counts"])
            here = np.searchsorted(contexts, widened(r["contexts"]))
            need = unseen_contexts(own, widened(r["runs"]), known) & ~np.isin(contexts[here], hot)
            out["totals"].append(narrow(own))
            out["discounted"].append(np.packbits(small[here].any(axis=1)).tobytes())
            out["counts"].append(narrow(small[here[need]].ravel()))
            out["chances"].append(chance[here[need]].tobytes())
        shared = [{"context": int(c), "counts": small[i].tolist(), "chance": float(chance[i])} for i, c in enumerate(contexts) if c in split]
        n = len(rows)
        columns = {"part": pa.array([rows[0]["part"]] * (n + 1), pa.int32()), "batch": pa.array([*[r["batch"] for r in rows], -1], pa.int64())}
        columns |= {c: pa.array([*v, None], pa.binary()) for c, v in out.items()}
        columns["spectrum"] = pa.array([None] * n + [np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1 : K + 2].tolist()], pa.list_(pa.int64()))
        kind = pa.struct([("context", pa.int64()), ("counts", pa.list_(pa.int64())), ("chance", pa.float64())])
        return pa.table(columns | {"hot": pa.array([None] * n + [shared], pa.list_(kind))})

    split = set(hot.tolist())
    return asked.groupBy("part").applyInArrow(group, PAIR_ANSWERS)


def unseen_contexts(totals: np.ndarray, runs: np.ndarray, context_counts: np.ndarray) -> np.ndarray:
    """For each context of a slice, whether it is known and one of its pairs is not."""
    starts = np.cumsum(runs) - runs
    return (np.minimum.reduceat(totals, starts) == 0) & (context_counts > 0) if len(runs) else np.zeros(0, bool)


@dataclass(frozen=True)
class Bigrams:
    """Discounts of pairs and, for the hot contexts, their sums."""

    discounts: Discounts
    hot: dict[int, tuple[list[int], float]]

    def kept(self, context_counts: np.ndarray, small: np.ndarray) -> np.ndarray:
        """Discounted counts of all words after a context: small counts by their number, the rest undiscounted."""
        r = np.arange(1, K + 1)
        factors = np.asarray(self.discounts.factor[1 : K + 1])
        return context_counts - (small * r * (1 - factors)).sum(axis=1)


def batch_scores(row: dict, word_parts: int, width: int, hot: np.ndarray, parts: int, unigrams: Unigrams, bigrams: Bigrams) -> dict[str, np.ndarray]:
    """Columns of one batch's documents."""
    p = Pairs.of(row, word_parts, width, hot, parts)
    at = slices(p.part, parts)
    log_p = np.empty(len(p.context))
    for a in row["pair_answers"]:
        own = slice(at[a["part"]], at[a["part"] + 1])
        contexts, runs = np.unique(p.context[own], return_counts=True)
        known, total = p.count_of(contexts, unigrams.starts), widened(a["totals"])
        any_small = np.unpackbits(np.frombuffer(a["discounted"], "u1"), count=len(contexts)).astype(bool)
        need = unseen_contexts(total, runs, known) & ~np.isin(contexts, hot)
        small, chance = np.zeros((len(contexts), K), np.int64), np.zeros(len(contexts))
        small[need] = widened(a["counts"]).reshape(-1, K)
        chance[need] = np.frombuffer(a["chances"])
        for i in np.flatnonzero(np.isin(contexts, hot)):
            small[i], chance[i] = bigrams.hot[int(contexts[i])]
            any_small[i] = small[i].any()
        # a context none of whose counts is discounted is reckoned one occurrence more, of an unseen word
        size = np.maximum(1, known + ~any_small)
        alpha = (1 - bigrams.kept(known, small) / size) / (1 - chance)
        alpha = np.where(known > 0, alpha, 1.0)
        below = unigrams.probability(p.count_of(p.word[own], 0))
        chances = np.where(total > 0, bigrams.discounts.kept(total) / np.repeat(size, runs), np.repeat(np.where(need | np.isin(contexts, hot) | (known == 0), alpha, 1.0), runs) * below)
        log_p[own] = np.log10(chances)
    b = p.batch
    first = np.cumsum(b.sizes) - b.sizes
    count = p.counts[b.tokens]
    base = np.log10((count + 1) / (unigrams.tokens + unigrams.known + 1))
    add = lambda values: np.add.reduceat(values, first)
    return {"held_out": b.held, "n_tokens": b.sizes, "n_known": add((count > 0).astype(np.int64)), "base_score": add(base), "score": add(log_p[p.which])}


def gathered(answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """A batch's answers of all partitions in one row."""
    rows = answers.filter("batch >= 0").groupBy("batch")
    return rows.agg(F.sort_array(F.collect_list(F.struct("part", *columns))).alias(name))


def log_scores(docs: DataFrame, batch: int = BATCH) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents that are not held out and scores all. Scores are log10 probabilities of the
    whole text with its end; base_score is the add-one unigram score. A null or empty text is its end alone. Repeated
    rows are learnt and scored as often as they stand there; a null doc_id counts as the empty text in the choice of the
    held-out documents. If nothing is learnt every word is unknown. Other columns are ignored; no rows give no rows.
    """
    spark: SparkSession = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(batches(docs, batch), "lm-batches", buckets)
    size = rows.agg(F.sum(F.octet_length("words") / 8).alias("words"), F.sum(F.octet_length("tokens") / 4).alias("tokens")).first()
    parts, pair_parts = (max(buckets, math.ceil((n or 0) / PARTITION)) for n in size)

    answers = stored(answer_words(ask_words(rows, parts)), "lm-words")
    per_part = answers.filter("batch < 0").select("part", "known", "tokens", "spectrum", "distinct", "top").collect()  # a row per partition
    spectrum = [sum(r["spectrum"][i] for r in per_part) for i in range(K + 1)]
    tokens, known, width = sum(r["tokens"] for r in per_part), sum(r["known"] for r in per_part), max((r["distinct"] for r in per_part), default=1)
    discounts = Discounts.of(spectrum)
    lost = sum(spectrum[r - 1] * r * (1 - discounts.factor[r]) for r in range(1, K + 1))
    held_rows = rows.select(F.sum(F.size("doc_ids")).alias("n"), F.sum(F.length(F.replace(F.hex("held"), F.lit("00"), F.lit(""))) / 2).alias("held")).first()
    starts = int((held_rows["n"] or 0) - (held_rows["held"] or 0))
    unigrams = Unigrams(tokens, known, starts, discounts, tokens - lost)
    share = max(1, tokens // (4 * pair_parts))
    often = [r["part"] * width + x["place"] + 1 for r in per_part for x in r["top"] if x["count"] > share]
    hot = np.array(sorted([0, *often]), np.int64)  # at most 4 contexts for each partition, and the start of a text

    joined = rows.join(gathered(answers, "answers", "places", "counts"), "batch")
    pairs = stored(answer_pairs(ask_pairs(joined, pair_parts, parts, width, unigrams, hot), unigrams, hot), "lm-pairs")
    own = pairs.filter("batch < 0")
    pair_spectrum = own.select(*[F.sum(F.col("spectrum")[i]).alias(f"n{i}") for i in range(K + 1)]).first()
    shared = own.select(F.explode("hot").alias("h")).groupBy("h.context").agg(*[F.sum(F.col("h.counts")[i]).alias(f"n{i}") for i in range(K)], F.sum("h.chance").alias("chance"))
    bigrams = Bigrams(Discounts.of([n or 0 for n in pair_spectrum]), {r["context"]: ([r[f"n{i}"] for i in range(K)], r["chance"]) for r in shared.collect()})

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            for i, row in enumerate(table.drop_columns(["doc_ids"]).to_pylist()):
                scored = batch_scores(row, parts, width, hot, pair_parts, unigrams, bigrams)
                ids = table.column("doc_ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_pydict({"doc_id": ids} | {k: pa.array(v) for k, v in scored.items()})

    answered = joined.join(gathered(pairs, "pair_answers", "totals", "discounted", "counts", "chances"), "batch")
    scores = answered.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.withColumn("train_tokens", F.lit(tokens).cast("long"))
