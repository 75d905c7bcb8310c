"""Benchmark texts inside documents, found through a positional inverted index.

A benchmark item is cut into windows of consecutive words. A window can only occur where its rarest word does, so words
are counted over all documents first, and each window is looked up by the word of it that occurs least. The index holds
the postings of these words: document, position and the words around it. It is split by documents, as search engines
split theirs: a document's postings lie together, so a window is compared with the words around the posting and
nothing is shuffled for it. Lists of a window's other words are neither kept nor intersected.

The benchmark is taken in blocks of a fixed number of windows; each block is broadcast and met by all documents once.
Everything is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import LOWER, UPPER, numbered, stored, with_texts

WINDOW = 10
#: Rows broadcast at once: windows (about 200 bytes each) or words. A larger benchmark is met block by block.
BLOCK = 100_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str = "text") -> Column:
    """Runs of ASCII letters and digits and of characters above U+007F; A-Z in lower case. Null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NOT_WORD), "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and win: ``size`` consecutive words; an item of fewer, but not none, is one window. Equal ones once."""
    w = items.select("item_id", words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    return w.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("win")).distinct()


def blocks(df: DataFrame, key: str, size: int = BLOCK) -> list[DataFrame]:
    """``df`` in parts of about ``size`` rows, split by a hash of ``key``."""
    n = -(-df.count() // size)
    return [df] if n <= 1 else [df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)]


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences of each of ``terms`` in all documents; words that never occur are absent."""
    tokens = docs.select(F.explode(words()).alias("term"))
    parts = [tokens.join(F.broadcast(part), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")) for part in blocks(terms, "term")]
    return reduce(DataFrame.unionByName, parts)


def anchored(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Windows that may occur, with term (their rarest word; the first of equals) and offset (its place, from 0)."""
    parts = windows.select("item_id", "win", F.posexplode("win").alias("offset", "term"))
    terms = stored(parts.select("term").distinct(), "benchmark-terms")
    counts = stored(term_counts(docs, terms), "benchmark-counts")
    known = parts.join(counts, "term").groupBy("item_id", "win").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "offset", "term")).alias("rarest"))
    # a window with a word that no document has cannot occur
    return known.filter(F.col("found") == F.size("win")).select("item_id", "win", "rarest.offset", "rarest.term")


def postings(numbered_docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """The index: row_no, doc_id, n_words, term, at (from 1), around (words from ``at - reach`` on), first (its place).

    Every document has one more posting with the empty term at 0, so that documents without postings are kept too.
    ``terms`` is one block of words.
    """
    rows = numbered_docs.select("row_no", "doc_id", words().alias("w"))
    tokens = rows.select("row_no", "doc_id", "w", F.posexplode(F.concat(F.array(F.lit("")), "w")).alias("at", "term"))
    first = F.greatest(F.lit(1), F.col("at") - reach)
    around = F.slice("w", first, F.col("at") + reach - first + 1)
    hits = tokens.join(F.broadcast(terms), "term")
    return hits.select("row_no", "doc_id", F.size("w").alias("n_words"), "term", "at", F.when(F.col("term") != "", around).alias("around"), first.alias("first"))


def phrase_at(slop: int = 0) -> tuple[Column, Column]:
    """(exact, near) for a posting joined with a window: the window stands there word by word; all its words stand
    within ``slop`` places of where they would."""
    start = F.col("at") - F.col("offset") - F.col("first") + 1  # in ``around``, from 1
    n = F.size("win")
    exact = (start >= 1) & (F.slice("around", F.greatest(F.lit(1), start), n) == F.col("win"))
    low = F.greatest(F.lit(1), start - slop)
    near = F.size(F.array_except("win", F.slice("around", low, start + n + slop - low))) == 0
    return exact, near


def looked_up(docs: DataFrame, items: DataFrame, size: int) -> list[DataFrame]:
    """The windows of ``items`` that may occur, with the word they are looked up by, in blocks."""
    windows = stored(item_windows(items, size), "benchmark-windows")
    return blocks(stored(anchored(windows, docs), "benchmark-anchors"), "win")


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW, slop: int = 0) -> DataFrame:
    """row_no, doc_id, n_words of every document, and start, end (words, from 1), item_id, exact of each occurrence.

    Documents without an occurrence have one row with nulls there. With ``slop`` above 0, occurrences in which all
    words of a window stand within so many places of their own count too, with exact false.
    """
    parts = looked_up(docs, items, size)
    rows = numbered(docs.select("doc_id", "text"))
    # each block scans the documents
    return row_matches(stored(rows, "numbered-documents") if len(parts) > 1 else rows, parts, size, slop)


def row_matches(rows: DataFrame, windows: list[DataFrame], size: int, slop: int = 0) -> DataFrame:
    """:func:`matches` of rows that have their row_no, in a stored table if there are several blocks of ``windows``."""
    exact, near = phrase_at(slop)
    parts = []
    for i, block in enumerate(windows):
        # every block finds the hits; the rows for the documents themselves come from the first
        always = block.sparkSession.createDataFrame([("",)] if i == 0 else [], "term string")
        terms = block.select("term").distinct().unionByName(always)
        index = stored(postings(rows, terms, size - 1 + slop), "training-postings")
        hit = index.filter("term != ''").join(F.broadcast(block), "term").filter(near if slop else exact)
        start = F.col("at") - F.col("offset")
        own = index.filter("term = ''").select("row_no", "doc_id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"))])
        own = own.withColumns({"item_id": F.lit(None).cast(block.schema["item_id"].dataType), "exact": F.lit(None).cast("boolean")})
        parts += [hit.select("row_no", "doc_id", "n_words", start.alias("start"), (start + F.size("win") - 1).alias("end"), "item_id", exact.alias("exact")), own]
    return reduce(DataFrame.unionByName, parts)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: row_no, doc_id, n_words, n_hit (words inside any occurrence), items (sorted, as strings).

    Null and empty texts have no words and no hits; null and empty items have no windows; a null item_id counts as an
    occurrence but is not listed. Repeated rows are reported one by one. Without items nothing is hit. Other columns of
    both tables are ignored.
    """
    return by_row(matches(docs, items, size))


def by_row(found: DataFrame) -> DataFrame:
    """The occurrences of :func:`matches`, one row per document."""
    spans = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "end")))
    by_row = found.groupBy("row_no", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), spans.alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    none = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        F.sort_array("spans"),
        none,
        lambda a, s: F.struct(
            (a["covered"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["start"] - 1))).alias("covered"), F.greatest(a["upto"], s["end"]).alias("upto")
        ),
    )
    return by_row.select("row_no", "doc_id", "n_words", covered["covered"].cast("long").alias("n_hit"), "items")


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of ``items`` occurs.

    Null and empty texts have no words and stay; so do repeated rows without a hit. Items that are null, empty or blank
    have no window; without items all rows stay.
    """
    names = docs.columns
    rows = stored(numbered(docs.toDF(*[f"c{i}" for i in range(len(names))])), "numbered-documents")
    texts = with_texts(rows, names)
    found = by_row(row_matches(texts, looked_up(texts, items, size), size))
    hit = stored(found.filter("n_hit > 0").select("row_no"), "contaminated")
    return rows.join(hit, "row_no", "left_anti").drop("row_no").toDF(*names)


ORACLE = """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT n FROM win
), grams AS (
  SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, lengths WHERE len(w) >= n)
), hits AS (
  SELECT r, s, n, item_id FROM grams JOIN win USING (n, t)
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
