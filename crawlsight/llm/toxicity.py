"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, votes by distance.

1. Examples are labelled documents, at most ``per_class`` of each label (chosen by a hash of the id), outside the held-out
   fold. Terms are words and beginnings of words; those that tell the labels apart beyond chance (G-squared, held against
   the number of terms tried) make the vocabulary, at most ``terms`` of them.
2. Every document becomes its vocabulary's term counts. Document frequencies are counted over all documents.
3. An example's postings lie in blocks of examples; each term's largest weight in a block bounds what a block can reach.
   Blocks are opened in the order of their bounds until none can hold a nearer example: the k nearest are exact.
4. Votes are weighted by nearness and by how many documents an example stands for, drawn to the base rate by a weight of
   their own where examples are far. A logistic curve fitted to the examples' own votes (each without itself) makes the
   votes a probability. Texts without any term have the rate of such examples.

A score depends on the text alone, and the nearest examples come with it as evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import in_arrow, stored

WORD = re.compile(r"[^\W\d_]+")
#: Documents that a task scores.
ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    """per_class and terms bound the classifier's size; everything else covers all rows."""

    per_class: int = 4000
    terms: int = 1024
    neighbours: int = 25
    block: int = 64
    stems: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    least_documents: int = 4
    folds: int = 5
    fold: int = 0


def terms_of(word: str, stems: tuple[int, ...]) -> list[str]:
    """The word, and its beginnings marked with a hyphen."""
    return [word, *(word[:n] + "-" for n in stems if n < len(word))]


class Vocabulary(dict):
    """Of a word the numbers of its terms; words are remembered."""

    def __init__(self, terms: list[str], stems: tuple[int, ...]) -> None:
        super().__init__()
        self.number, self.stems = {t: i for i, t in enumerate(terms)}, stems

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 300_000:
            self.clear()
        own = self[word] = tuple(self.number[t] for t in terms_of(word, self.stems) if t in self.number)
        return own

    def vector(self, text: str | None) -> tuple[list[int], list[int]]:
        """Numbers of the text's terms in order, and how often each occurs."""
        counts: Counter[int] = Counter()
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            for t in self[word]:
                counts[t] += n
        own = sorted(counts.items())
        return [t for t, _ in own], [n for _, n in own]


def held_out(doc_id: Column, s: Settings) -> Column:
    """crc32 of the id as text decides; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % s.folds == s.fold


def examples(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, dict[int, float]]:
    """doc_id, toxic, text of the examples (stored), and how many labelled documents one example of a class stands for."""
    learnt = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), s))
    known = learnt.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = [known.filter(F.col("toxic") == c).orderBy(place, "doc_id").limit(s.per_class) for c in (0, 1)]
    ids = stored(chosen[0].unionByName(chosen[1]), "toxicity-examples")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return stored(found, "toxicity-texts"), {c: n / min(n, s.per_class) for c, n in sizes.items()}


def vocabulary(texts: DataFrame, s: Settings) -> list[str]:
    """The terms whose documents differ between the classes by more than chance, the most telling first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            terms = list(both[0] | both[1])
            out = pa.RecordBatch.from_pydict({"term": pa.array(terms, pa.string()), "n0": pa.array([both[0][t] for t in terms], pa.int64()), "n1": pa.array([both[1][t] for t in terms], pa.int64())})
            both[0].clear()
            both[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                both[toxic].update({t for w in words for t in terms_of(w, s.stems)})
                if len(both[0]) + len(both[1]) > 1_000_000:
                    yield flushed()
        yield flushed()

    counted = texts.select("text", "toxic").mapInArrow(count, "term string, n0 long, n1 long")
    sums = stored(counted.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= s.least_documents), "toxicity-terms")
    classes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n0, n1 = classes.get(0, 0), classes.get(1, 0)
    if not n0 or not n1:
        return []
    tried = sums.count()
    # P(G2 > x) of one degree of freedom is below exp(-x / 2); one term in all may pass by chance
    least = 2 * math.log(max(tried, 1) + 1) + 2
    a, b = F.col("n0").cast("double"), F.col("n1").cast("double")
    share = (a + b) / (n0 + n1)
    part = lambda got, of, p: F.when(got > 0, 2 * got * F.log(got / (of * p))).otherwise(0.0)
    g2 = part(a, n0, share) + part(b, n1, share) + part(n0 - a, n0, 1 - share) + part(n1 - b, n1, 1 - share)
    best = sums.withColumn("g2", g2).filter(F.col("g2") >= least).orderBy(F.desc("g2"), "term").limit(s.terms)
    return [r["term"] for r in best.select("term", "g2").collect()]


def vectors(rows: DataFrame, terms: list[str], s: Settings, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` of each row and its terms and counts."""

    def one(batch: pa.RecordBatch) -> dict:
        own = [known.vector(t) for t in batch.column("text").to_pylist()]
        return {c: batch.column(c) for c in keep} | {"terms": pa.array([t for t, _ in own], pa.list_(pa.int32())), "counts": pa.array([n for _, n in own], pa.list_(pa.int32()))}

    known = Vocabulary(terms, s.stems)
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return in_arrow(rows.select(*keep, "text"), one, f"{schema}, terms array<int>, counts array<int>")


class BlockMaxIndex:
    """Unit vectors of examples as inverted lists by term, cut at blocks of examples, with each list's block maxima."""

    def __init__(self, rows: list[tuple[list[int], list[int]]], idf: np.ndarray, block: int) -> None:
        self.idf, self.block, self.size = idf, block, len(rows)
        n_blocks = max(1, -(-len(rows) // block))
        term = np.concatenate([np.asarray(t, np.int64) for t, _ in rows]) if rows else np.zeros(0, np.int64)
        example = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        weight = np.concatenate([self.unit(t, n) for t, n in rows]) if rows else np.zeros(0)
        order = np.lexsort((example, term))
        term, self.example, self.weight = term[order], example[order], weight[order]
        cell = term * n_blocks + self.example // block
        self.at = np.searchsorted(cell, np.arange(len(idf) * n_blocks + 1)).astype(np.int64)
        self.most = np.zeros(len(idf) * n_blocks)
        np.maximum.at(self.most, cell, self.weight)
        self.most = self.most.reshape(len(idf), n_blocks)
        self.n_blocks = n_blocks

    def unit(self, terms: list[int], counts: list[int]) -> np.ndarray:
        w = (1 + np.log(np.asarray(counts, np.float64))) * self.idf[np.asarray(terms, np.int64)]
        return w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, terms: list[int], counts: list[int], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples with the largest cosine above 0, and the cosines; equal ones go by the example's number."""
        q, own = self.unit(terms, counts), np.asarray(terms, np.int64)
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(own) or not self.size:
            return none
        bound = q @ self.most[own]
        # the blocks with the largest bounds first; what they hold says which others may hold a nearer example
        order = np.argsort(-bound, kind="stable")
        near = self.scores(own, q, order[:4])
        near[without : without + 1] = 0
        least = np.partition(near, -k)[-k] if len(near) >= k else 0.0
        open_blocks = np.flatnonzero((bound > 0) & (bound >= least - 1e-9))  # rounding of the two sums aside
        scores = self.scores(own, q, open_blocks)
        scores[without : without + 1] = 0
        hit = np.flatnonzero(scores)
        if len(hit) > k:
            hit = hit[scores[hit] >= np.partition(scores[hit], -k)[-k]]
        best = hit[np.lexsort((hit, -scores[hit]))[:k]]
        return best, scores[best]

    def scores(self, terms: np.ndarray, q: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of all examples in ``blocks`` (0 elsewhere): the blocks' postings of all terms in one go."""
        cells = (terms[:, None] * self.n_blocks + np.sort(blocks)).ravel()
        starts = self.at[cells]
        lengths = self.at[cells + 1] - starts
        at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        return np.bincount(self.example[at], np.repeat(np.repeat(q, len(blocks)), lengths) * self.weight[at], self.size)


@dataclass
class Model:
    """The examples' index, what their votes count, and the curve from votes to probabilities."""

    index: BlockMaxIndex
    doc_ids: list
    toxic: np.ndarray
    stands_for: np.ndarray
    base: float
    bare: float
    neighbours: int
    n_docs: int = 0
    curve: tuple[float, float] = (0.0, 1.0)
    seen: dict = field(default_factory=dict, repr=False)

    def vote(self, terms: list[int], counts: list[int], without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of the votes of the nearest, drawn to the base rate by one far example's weight."""
        ids, near = self.index.nearest(terms, counts, self.neighbours, without)
        weight = self.stands_for[ids] * near / (1.02 - np.minimum(near, 1.0))
        pull = float(np.mean(self.stands_for)) if len(self.stands_for) else 1.0
        p = (float((weight * self.toxic[ids]).sum()) + pull * self.base) / (float(weight.sum()) + pull)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p)), ids, near

    def score(self, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
        """The probability that a text with these terms is toxic, and its nearest examples."""
        key = (tuple(terms), tuple(counts))
        if key not in self.seen:
            if len(self.seen) > 50_000:
                self.seen.clear()
            if terms:
                odds, ids, near = self.vote(terms, counts)
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, self.curve[0] + self.curve[1] * odds))))
                shown = [{"doc_id": self.doc_ids[i], "similarity": float(x), "toxic": int(self.toxic[i])} for i, x in zip(ids[:5].tolist(), near[:5].tolist(), strict=True)]
            else:
                p, shown = self.bare, []
            self.seen[key] = (p, shown)
        return self.seen[key]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) of a weighted logistic fit, with a slight pull to the identity."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        r, v = w * (y - p), w * p * (1 - p)
        g = np.array([r.sum() - a, (r * x).sum() - (b - 1)])
        h = np.array([[v.sum() + 1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 1]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return a, max(b, 0.0)


def frequencies(counted: DataFrame, n_terms: int) -> DataFrame:
    """term, n: in how many documents each term is. A partition sends one row for each term that it has."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        here = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(here, pa.int32()), "n": pa.array(n[here], pa.int64())})

    return counted.select("terms").mapInArrow(tally, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, counted: DataFrame, terms: list[str], stands: dict[int, float], s: Settings) -> Model:
    """The model of the examples; document frequencies are those of ``counted``, the vectors of all documents."""
    n_docs = counted.count()
    frequency = np.zeros(len(terms))
    for r in frequencies(counted, len(terms)).collect():
        frequency[r["term"]] = r["n"]
    idf = np.log1p(n_docs / np.maximum(frequency, 1))
    rows = vectors(texts, terms, s, ("doc_id", "toxic")).collect()  # at most 2 * per_class, of at most ``terms`` terms
    weight = lambda r: stands.get(r["toxic"], 1.0)
    total = sum(map(weight, rows))
    base = sum(weight(r) * r["toxic"] for r in rows) / total if total else 0.0
    bare = [r for r in rows if not r["terms"]]
    bare_rate = (sum(weight(r) * r["toxic"] for r in bare) + base) / (sum(map(weight, bare)) + 1)
    # examples with the same leading term lie together, so that few blocks have high bounds
    leads = lambda r: (r["terms"][int(np.argmax(np.log1p(r["counts"]) * idf[r["terms"]]))], r["toxic"], r["terms"], r["counts"], str(r["doc_id"]))
    rows = sorted((r for r in rows if r["terms"]), key=leads)
    index = BlockMaxIndex([(r["terms"], r["counts"]) for r in rows], idf, s.block)
    model = Model(index, [r["doc_id"] for r in rows], np.array([r["toxic"] for r in rows], float), np.array([weight(r) for r in rows]), base, bare_rate, s.neighbours, n_docs)
    spark = texts.sparkSession
    if rows:
        given = spark.sparkContext.broadcast(model)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = given.value
            for batch in batches:
                out = [m.vote(t, n, i)[0] for i, t, n in zip(*(batch.column(c).to_pylist() for c in ("at", "terms", "counts")), strict=True)]
                yield pa.RecordBatch.from_pydict({"at": batch.column("at"), "odds": pa.array(out, pa.float64())})

        asked = spark.createDataFrame([(i, r["terms"], r["counts"]) for i, r in enumerate(rows)], "at int, terms array<int>, counts array<int>")
        odds = np.zeros(len(rows))
        for r in asked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(own, "at int, odds double").collect():
            odds[r["at"]] = r["odds"]
        model.curve = logistic(odds, model.toxic, model.stands_for)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, evidence (up to five nearest examples).

    Null and empty texts have no terms: their score is the rate of examples without terms. A null id counts as held out.
    Rows of one text get one score; several rows of a labelled doc_id give one example, of the least text. Several
    labels of a doc_id are toxic if one is; null labels and ids are no labels. Without labels, or with one class only,
    all rows get the share of toxic labels (0 without any). Other columns are ignored; no rows give no rows.
    """
    texts, stands = examples(docs, labels, s)
    terms = vocabulary(texts, s)
    counted = stored(vectors(docs, terms, s, ("doc_id",)), "toxicity-vectors")
    model = counted.sparkSession.sparkContext.broadcast(fit(texts, counted, terms, stands, s))
    kind = docs.schema["doc_id"].dataType

    def one(batch: pa.RecordBatch) -> dict:
        m = model.value
        own = [m.score(t, n) for t, n in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        near = pa.list_(pa.struct([("doc_id", batch.column("doc_id").type), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        return {"doc_id": batch.column("doc_id"), "score": pa.array([p for p, _ in own], pa.float64()), "evidence": pa.array([e for _, e in own], near)}

    # vectors are small, so that the stored files are few: they are dealt out for the search
    parts = max(counted.sparkSession.sparkContext.defaultParallelism, -(-model.value.n_docs // ROWS))
    scored = in_arrow(counted.repartition(parts), one, f"doc_id {kind.simpleString()}, score double, evidence array<struct<doc_id: {kind.simpleString()}, similarity: double, toxic: int>>")
    return scored.select("doc_id", held_out(F.col("doc_id"), s).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
