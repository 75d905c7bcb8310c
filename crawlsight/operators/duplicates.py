"""Exact and near duplicates.

Near duplicates are exact: every pair with Jaccard similarity >= 0.9 over 5-word shingles is found.
Length and prefix filters (Chaudhuri 2006, Bayardo 2007, Xiao 2008) keep the candidate join small;
a final intersection count decides.

Texts are stored once, in batches, and do not move again. A set of shingles is made from its text where it is needed: at
8 bytes a word it is larger than the text. How many texts hold a shingle is asked batch by batch (``operators/shingles.py``).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.functions import text as T
from crawlsight.functions.findings import Checks, explode_findings
from crawlsight.operators import shingles as J
from crawlsight.session import fence, stored

c = F.col

THRESHOLD = 0.9
MIN_WORDS = 30
#: Shingles of the sets in a block that are checked together; a set counts for 256 at least.
BLOCK = 65536


def normalised(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with whitespace collapsed and case folded, computed once per text."""
    return fence(texts.select(c(id_col).alias("id"), F.lower(T.collapse_ws(c(text_col))).alias("text")))


def body_keys(docs: DataFrame) -> DataFrame:
    """Documents long enough to compare with the hash of their text."""
    return docs.filter(T.word_count(c("text")) >= MIN_WORDS).select("id", F.sha2("text", 256).alias("body_key"), "text")


def member_rows(docs: DataFrame) -> DataFrame:
    """Rows of every group of equal texts. Only ids and hashes are kept; texts are read and hashed once."""
    return members(stored(body_keys(docs).select("id", "body_key"), "body-keys"), "body_key")


def groups_by(df: DataFrame, key: str) -> DataFrame:
    """``agg_dup_groups``: rows sharing a key, as (key, size, smallest id).

    Members stay rows (see :func:`members`): a group can hold a third of all pages, so it is never
    collected into one array.
    """
    return (
        df.filter(c(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter(c("n") > 1)
    )


def members(df: DataFrame, key: str) -> DataFrame:
    """Rows of every group of two or more."""
    return df.join(groups_by(df, key).select(key, "n", "first_id"), key)


def without_exact(keys: DataFrame) -> DataFrame:
    """``anti_exact_dupes``: documents whose text nobody else has."""
    return keys.join(groups_by(keys, "body_key"), "body_key", "left_anti")


def text_batches(docs: DataFrame) -> DataFrame:
    """(id, text) stored as (batch, row_nos, doc_ids, texts), bucketed by batch. A row's number is its own, whatever its id."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return J.bucketed(J.batches(J.numbered(docs.select(c("id").alias("doc_id"), "text"))), "text-batches", buckets)


def batch_keys(batches: DataFrame) -> DataFrame:
    """(id, body_key, batch, place) of every text of the batches; the texts stay where they are."""
    keys = F.transform("texts", lambda t: F.sha2(t, 256))
    rows = batches.select("batch", F.posexplode(F.arrays_zip(c("doc_ids").alias("id"), keys.alias("body_key"))).alias("place", "r"))
    return rows.select("r.id", "r.body_key", "batch", "place")


def _of_batches(batches: DataFrame, chosen: DataFrame) -> DataFrame:
    """The batches with the places of the chosen rows; only those move."""
    return batches.join(stored(chosen.groupBy("batch").agg(F.collect_list("place").alias("firsts")), "chosen-places"), "batch")


def representatives(batches: DataFrame) -> DataFrame:
    """One document per distinct text: the smallest id stands for all exact copies."""
    first = F.min(F.struct(c("id").isNull().alias("no_id"), "id", "batch", "place")).alias("f")
    return _of_batches(batches, batch_keys(batches).groupBy("body_key").agg(first).select("f.batch", "f.place"))


def lone_texts(batches: DataFrame, keys: DataFrame) -> DataFrame:
    """The batches with the places of the texts that nobody else has (:func:`without_exact` of their ``keys``)."""
    return _of_batches(batches, without_exact(keys))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """Texts whose sets are to be compared: (id, text) of normalised texts, or batches with the chosen places.

    A set holds the 64-bit hashes of the distinct 5-word runs of its text. It is made in the task that works on it.
    """
    if "firsts" in docs.columns:
        return docs
    batches = text_batches(docs.filter(F.trim("text") != ""))
    return batches.withColumn("firsts", F.sequence(F.lit(0), F.size("texts") - 1))


def near_duplicates(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``join_near_dup``: (id_a, id_b, similarity, common) for id_a < id_b.

    With n shingles and threshold t, two similar sets share at least one of the n - ceil(t n) + 1
    rarest shingles of each, so only those go into the join. A shingle all documents share is last
    in that order and reaches the join only for documents that have nothing rarer; there the shingles that a
    document has alone count against every pair (positional filter), so a passage that many documents share
    makes pairs only of those that are little else.

    A hot shingle that still holds many documents is not paired inside one task: the join key is
    (shingle, size class, chunk of the probing side), so its rows spread over the cluster.
    """
    sim = J.Similarity(words=5, num=round(threshold * 100))
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_words = F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + T.word_count(t))
    total = sets.agg(F.sum(n_words)).first()[0] or 0
    rarity = stored(J.answer(J.ask(sets, sim, max(buckets, math.ceil(total / J.PARTITION)))), "shingle-rarity")
    answers = rarity.groupBy("batch").agg(F.collect_list(F.struct("part", "codes")).alias("answers"))
    # the documents whose prefix has a shingle that others have too: few, and only their sets are kept
    asked = sets.join(answers, "batch")
    found = stored(J.candidates(asked.select("batch", "row_nos", "texts", "firsts", "answers"), sim), "candidate-sets")
    postings = stored(found.select("row_no", F.explode("prefix").alias("p")).select("row_no", "p.shingle", "p.at"), "postings")
    # Of shingles that the same documents have, one makes their pairs: a pair that is similar passes with any shingle it shares.
    held = [F.bit_xor(F.xxhash64(F.lit(k), "row_no")).alias(f"held_{k}") for k in (1, 2)]
    df = postings.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), *held).filter(c("df") > 1)
    first = df.groupBy("df", "held_1", "held_2").agg(F.min("shingle").alias("shingle")).select("shingle", "df")
    ids = sets.select(F.inline(F.arrays_zip(c("row_nos").alias("row_no"), c("doc_ids").alias("id"))))
    named = stored(found.drop("hub", "prefix", "elements").join(ids, "row_no"), "named-candidates")
    ranked = stored(postings.join(first, "shingle").join(named, "row_no"), "shared-postings")
    # Size classes: similar sets differ in size by at most 1/t, so they fall in the same or the next class.
    cls = F.floor(F.log(c("n").cast("double")) / math.log(1.0 / threshold) + 1e-9).cast("int")
    # A shingle with many documents is cut into chunks: the left row goes to one chunk of its own, the
    # right row is copied to every chunk, so each pair still meets exactly once.
    chunks = F.ceil(c("df") / 256).cast("int")
    left = ranked.withColumns({"cls": F.explode(F.array(cls - 1, cls, cls + 1)), "chunk": F.pmod(F.xxhash64("row_no"), chunks).cast("int")})
    right = ranked.withColumns({"cls": cls, "chunk": F.explode(F.sequence(F.lit(0), chunks - 1))})
    met = left.alias("x").join(right.alias("y"), ["shingle", "cls", "chunk"]).filter((c("x.id") < c("y.id")) & sim.may_link("x", "y"))
    candidates = stored(met.select(c("x.row_no").alias("a"), c("y.row_no").alias("b")).distinct(), "candidates")
    checked = shared_counts(candidates, named, found).withColumn("similarity", c("common") / (c("n_a") + c("n_b") - c("common")))
    return checked.filter(c("similarity") >= threshold).select("id_a", "id_b", "similarity", "common")


def shared_counts(pairs: DataFrame, named: DataFrame, sets: DataFrame) -> DataFrame:
    """``set_intersect_shingles``: (id_a, id_b, n_a, n_b, common) of the pairs: ids and sizes of both sets, and how many shingles they share.

    A set does not move for each of its pairs. Documents with the same first partner lie in one block, or in several if
    they are many, and a set goes once to each pair of blocks that has pairs of it.
    """
    ends = pairs.select(F.explode(F.array(F.struct(c("a").alias("row_no"), F.least("a", "b").alias("near")), F.struct(c("b").alias("row_no"), F.least("a", "b").alias("near")))).alias("e"))
    near = ends.groupBy("e.row_no").agg(F.min("e.near").alias("near"))
    weighed = near.join(named.select("row_no", "id", F.greatest("n", F.lit(256)).alias("weight")), "row_no")
    groups = weighed.groupBy("near").agg(F.ceil(F.sum("weight") / BLOCK).alias("parts"))
    blocks = stored(weighed.join(groups, "near").select("row_no", "id", "weight", F.xxhash64("near", F.pmod(F.xxhash64("row_no"), c("parts"))).alias("own")), "blocks")
    # groups that are small share a block
    n_blocks = F.lit(-(-(blocks.agg(F.sum("weight")).first()[0] or 1) // BLOCK))
    ends = [blocks.select(c("row_no").alias(x), c("id").alias(f"id_{x}"), F.pmod("own", n_blocks).alias(f"block_{x}")) for x in ("a", "b")]
    at = pairs.join(ends[0], "a").join(ends[1], "b")
    at = stored(at.select("a", "b", "id_a", "id_b", F.least("block_a", "block_b").alias("p"), F.greatest("block_a", "block_b").alias("q")), "placed-pairs")
    block = [c("p").alias("to_p"), c("q").alias("to_q")]
    moved = at.select(c("a").alias("row_no"), *block).unionByName(at.select(c("b").alias("row_no"), *block)).distinct()
    needed = moved.join(sets.select("row_no", "elements"), "row_no")

    def count(some: pa.Table, own: pa.Table) -> pa.Table:
        place = {r: i for i, r in enumerate(own.column("row_no").to_pylist())}
        a, b = ([place[r] for r in some.column(x).to_pylist()] for x in ("a", "b"))
        elements = [np.frombuffer(x.as_buffer(), np.uint64) for x in own.column("elements")]
        n = np.array([len(x) for x in elements], np.int64)
        return pa.table({"id_a": some.column("id_a"), "id_b": some.column("id_b"), "n_a": n[a], "n_b": n[b], "common": common_of(elements, a, b)})

    kind = named.schema["id"].dataType.simpleString()
    return at.groupBy("p", "q").cogroup(needed.groupBy("to_p", "to_q")).applyInArrow(count, f"id_a {kind}, id_b {kind}, n_a long, n_b long, common long")


def common_of(sets: list[np.ndarray], a: list[int], b: list[int]) -> np.ndarray:
    """How many elements each pair of sets shares. Few pairs are counted one by one, many by one product of the sets."""
    if len(a) < 8 * len(sets):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    distinct, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), count[column] > 1
    new = np.cumsum(count > 1) - 1
    row, column = row[shared], new[column[shared]]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column.max(initial=-1)) + 1, 8192):  # whole numbers below 2 ** 24 are exact
        own = (column >= at) & (column < at + 8192)
        has = np.zeros((len(sets), 8192), np.float32)
        has[row[own], column[own] - at] = 1
        total += (has @ has.T).astype(np.int64)
    return total[a, b]


def audit_duplicates(titles: DataFrame, descriptions: DataFrame, docs: DataFrame) -> DataFrame:
    """``audit_duplicates``: one finding of each kind for the whole crawl.

    ``titles`` and ``descriptions`` are (id, key) with a normalised key, ``docs`` is (id, text).
    """
    batches = text_batches(body_keys(docs))
    keys = stored(batch_keys(batches), "body-keys")  # texts are read and hashed once; only the documents without a copy need theirs

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    one = (
        size(groups_by(titles, "key"), "n_title").join(F.broadcast(size(titles.filter(c("key") != "").limit(1), "any_title")))
        .join(F.broadcast(size(groups_by(descriptions, "key"), "n_desc")))
        .join(F.broadcast(size(descriptions.filter(c("key") != "").limit(1), "any_desc")))
        .join(F.broadcast(size(groups_by(keys, "body_key"), "n_body")))
        .join(F.broadcast(size(near_duplicates(shingle_sets(lone_texts(batches, keys))), "n_near")))
        .join(F.broadcast(size(keys.limit(2), "n_compared")))
    )
    k = Checks("duplicateContent")
    k.issue("duplicate-title", 8, c("n_title") > 0, n=c("n_title"))
    k.ok("duplicate-title", (c("n_title") == 0) & (c("any_title") > 0))
    k.issue("duplicate-meta-description", 5, c("n_desc") > 0, n=c("n_desc"))
    k.ok("duplicate-meta-description", (c("n_desc") == 0) & (c("any_desc") > 0))
    k.issue("duplicate-body-content", 10, c("n_body") > 0, n=c("n_body"))
    k.issue("near-duplicate-content", 6, c("n_near") > 0, n=c("n_near"))
    k.ok("duplicate-content", (c("n_body") == 0) & (c("n_near") == 0) & (c("n_compared") > 1))
    return explode_findings(one, [], k.column())


# --- keywords --------------------------------------------------------------------------------------


def keyword_density(texts: DataFrame, id_col: str, text_col: str, top: int = 8) -> DataFrame:
    """``agg_keyword_density``: the eight most frequent words of a text and their share of all words.

    Counted inside the row: a text's words are one array, no shuffle.
    """
    tokens = F.regexp_extract_all(F.lower(c(text_col)), F.lit("[a-z0-9']{3,}"), F.lit(0))
    kept = F.array_sort(F.filter("tokens", lambda w: ~w.isin(*T.STOPWORDS)))
    rows = fence(fence(texts.select(c(id_col), tokens.alias("tokens"))).select(id_col, F.size("tokens").alias("total"), kept.alias("kept")))
    # Runs of the sorted array: a word starts where it differs from its left neighbour.
    starts = F.filter(F.sequence(F.lit(0), F.size("kept") - 1), lambda i: (i == 0) | (F.get("kept", i) != F.get("kept", i - 1)))
    runs = rows.filter(F.size("kept") > 0).withColumn("starts", starts)
    counted = F.transform(
        "starts",
        lambda s, i: F.struct(
            (s - F.coalesce(F.get("starts", i + 1), F.size("kept"))).alias("minus_n"), F.get("kept", s).alias("word")))
    return (
        runs.select(id_col, "total", F.posexplode(F.slice(F.array_sort(counted), 1, top)).alias("pos", "w"))
        .select(
            id_col, (c("pos") + 1).cast("long").alias("rank"), c("w.word").alias("word"), (-c("w.minus_n")).cast("long").alias("n"),
            F.round(-c("w.minus_n") * 100.0 / c("total"), 2).alias("density"))
    )
