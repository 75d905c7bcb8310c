"""Which of several filters takes what: every order of them, and each one's exact Shapley share of the removals.

1. A document becomes a mask, one bit for each filter that it fails. Counts of a part by mask say everything.
2. Coalition removals: v(S), the documents that the filters S remove together, for all 2^n sets S. What a filter takes at
   its step is a difference of two of them, whatever the order.
3. Shapley values are the constrained least-squares fit of v by a sum over S's members: kernel weights, the sum fixed to
   v(all). The normal equations are the same for every part, so they are solved once, in rationals, for all unit vectors
   of v; the result is a matrix of integers (over n! orders) that Spark applies to each part's coalition removals.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import UPPER, stored

#: White space that separates words.
GAPS = "[\\x20\\x09-\\x0D]+"
NAMES = "ABCDE"


def shapley_matrix(n: int) -> list[list[Fraction]]:
    """For each of n players the factors of v(S), by S as a bit mask: its Shapley value is their sum (v(none) is 0)."""
    everything = (1 << n) - 1
    # one row a player and one for the constraint; columns: values, multiplier, then one right-hand side a coalition
    rows = [[Fraction(0)] * (n + 1 + (1 << n)) for _ in range(n + 1)]
    for s in range(1, everything):
        size = s.bit_count()
        kernel = Fraction(n - 1, comb(n, size) * size * (n - size))
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            rows[i][n + 1 + s] += kernel
            for j in members:
                rows[i][j] += kernel
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][n + 1 + everything] = Fraction(1)
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and (by := rows[r][c]):
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[c], strict=True)]
    return [row[n + 1 :] for row in rows[:n]]


def over_all_orders(n: int) -> list[list[int]]:
    """The matrix times n!: sums over all orders, which are whole numbers."""
    scaled = [[x * factorial(n) for x in row] for row in shapley_matrix(n)]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D as conditions under which a text fails; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, GAPS), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit 0 is filter A) of every document.

    A text's first doc_id comes from one row per distinct text; rows find it by text and id, so a text that a third of
    all rows have makes no large group.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    conditions = text_failures(F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    own = stored(docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), mask.alias("mask")), "filter-masks")
    firsts = own.filter("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    found = own.join(firsts, ["key", "doc_id"], "left")
    return found.select("doc_id", "part", (F.col("mask") + F.when(later, 1 << len(conditions)).otherwise(0)).alias("mask"))


def coalition_removals(counted: DataFrame, n: int) -> DataFrame:
    """part and, as arrays over all 2^n sets of filters, removed, good, toxic: what the set takes away together;
    n_docs. ``counted`` has part, mask, n, good, toxic."""
    cells = counted.groupBy("part").agg(F.sum("n").alias("n_docs"), F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def taken(what: str) -> Column:
        of = lambda s: F.aggregate("cells", F.lit(0).cast("long"), lambda x, c: x + F.when(c["mask"].bitwiseAND(s) != 0, c[what]).otherwise(0))
        return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), of)

    return cells.select("part", "n_docs", taken("n").alias("removed"), taken("good").alias("good"), taken("toxic").alias("toxic"))


def steps(tabulated: DataFrame, names: str = NAMES) -> DataFrame:
    """One row per part, order of the filters and step, from the coalition removals of each part."""
    n = len(names)
    shares = [F.aggregate(F.zip_with("removed", F.array(*map(F.lit, row)), lambda v, c: v * c), F.lit(0).cast("long"), lambda x, y: x + y) for row in over_all_orders(n)]
    shared = tabulated.withColumn("shares", F.array(*shares))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    rows = shared.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    ahead = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    rows = rows.withColumns(
        {
            "own": sum((F.when(letter == c, 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0)),
            "before": sum((F.when(F.instr(ahead, F.lit(c)) > 0, 1 << i).otherwise(0) for i, c in enumerate(names)), F.lit(0)),
            "which": F.instr(F.lit(names), letter),
        }
    )
    at = lambda name, s: F.element_at(name, s + 1)
    after, everything = F.col("before") + F.col("own"), F.lit((1 << n) - 1)
    removed = at("removed", after) - at("removed", F.col("before"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        (F.col("n_docs") - at("removed", after)).alias("kept"),
        removed.alias("removed"),
        (at("removed", F.col("own")) - removed).alias("redundant"),
        (at("removed", everything) - at("removed", everything - F.col("own"))).alias("unique_fails"),
        (at("good", after) - at("good", F.col("before"))).alias("good_lost"),
        (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"),
        F.element_at("shares", F.col("which")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null is the empty one), order of the five filters and step.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. Null texts
    are empty. A null doc_id is no smaller id of any other and has none itself, so such rows fail no E. Repeated rows
    count as often as they stand there; rows of one doc_id with one text are no duplicates of each other. A doc_id with
    several labels is good (toxic) if one of them says so; null labels say nothing. Other columns are ignored; an empty
    table has no parts and gives no rows.
    """
    yes = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    named = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic"))
    marked = failures(docs).join(named, "doc_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    counted = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good"), count("toxic"))
    return steps(coalition_removals(counted, len(NAMES)))


#: The same by the definition: every document in its cell, every order walked, each cell taken by its first failing filter.
ORACLE = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), smaller AS (
  SELECT text, min(doc_id) AS least_id FROM words GROUP BY text
), flags AS (
  SELECT doc_id, part,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
     100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(least_id < doc_id, false)] AS fails
  FROM words JOIN smaller USING (text)
), label AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), cells AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM flags LEFT JOIN label USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT chr(65 + i::INT) AS c FROM range(5) r(i)
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), walked AS (
  SELECT part, filter_order, fails, n, good, toxic,
    list_position([fails[ascii(filter_order[k]) - 64] FOR k IN [1, 2, 3, 4, 5]], true) AS gone
  FROM cells, orders
), stepped AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step::INT] AS f,
    coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0) AS kept,
    coalesce(sum(n) FILTER (gone = step), 0) AS removed,
    coalesce(sum(n) FILTER (gone < step AND fails[ascii(filter_order[step::INT]) - 64]), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[ascii(filter_order[step::INT]) - 64] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (gone = step), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
  FROM walked, range(1, 6) s(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM stepped
"""
