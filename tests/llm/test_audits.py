"""Operators 11 and 12 against brute force and held-out rows."""

import collections
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from crawlsight.llm import interactions, queries, toxicity
from crawlsight.llm.toxicity import BlockMaxIndex, Settings
from tests.llm.helpers import LONG, bag, empty, odd

GAP = re.compile(r"[\x20\x09-\x0D]+")


# filter interactions


def test_the_matrix_gives_shapley_values():
    rnd = random.Random(1)
    for n in (2, 3, 5):
        v = [0] + [rnd.randint(0, 50) for _ in range((1 << n) - 1)]
        for i, row in enumerate(interactions.shapley_matrix(n)):
            plain = Fraction(0)
            for order in itertools.permutations(range(n)):
                before = sum(1 << j for j in order[: order.index(i)])
                plain += v[before | 1 << i] - v[before]
            assert sum(f * x for f, x in zip(row, v, strict=True)) == plain / math.factorial(n)


def walked(docs, labels):
    """Every order of the filters applied document by document."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    ids = collections.defaultdict(list)
    for d, text, _ in docs:
        ids[text or ""].append(d)
    cells = []
    for d, text, source in docs:
        text = text or ""
        words = [w for w in GAP.split(text) if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text))]
        fails.append(d is not None and any(o is not None and o < d for o in ids[text]))
        cells.append((source or "", d, fails))
    out, shares = [], collections.Counter()
    for part in {c[0] for c in cells}:
        own = [c for c in cells if c[0] == part]
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, letter in enumerate(order, 1):
                f = "ABCDE".index(letter)
                gone = [c for c in alive if c[2][f]]
                alive = [c for c in alive if not c[2][f]]
                failing = sum(c[2][f] for c in own)
                unique = sum(c[2][f] and sum(c[2]) == 1 for c in own)
                shares[part, letter] += len(gone)
                out.append([part, "".join(order), step, len(alive), len(gone), failing - len(gone), unique, sum(c[1] in good for c in gone), sum(c[1] in toxic for c in gone), letter])
    return [(*r[:-1], shares[r[0], r[-1]]) for r in out]


def test_steps_are_those_of_walking_every_order(spark):
    rnd = random.Random(2)
    texts = ["a " * 150 + "b c d", " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(210)), "short # one", "", None, "UPPER", "x y " * 120, "tab\tand\x0bfeed\n" * 70, LONG]
    docs = [(rnd.choice([i, i, None, 3]), rnd.choice(texts), rnd.choice(["one", "two", "", None])) for i in range(150)]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS mask", "2 AS part", "3 AS key", "4 AS first", "5 AS good", "6 AS toxic", "7 AS n")
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "1 AS good", "'x' AS part")
    got = interactions.filter_interactions(rows.repartition(4), named)
    assert bag(map(tuple, got.collect())) == bag(walked(docs, labels))


def test_no_documents_have_no_parts(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert interactions.filter_interactions(empty(spark), labels).collect() == []
    some = interactions.filter_interactions(odd(spark), labels.limit(0))
    assert some.count() == 600 and some.filter("good_lost + toxic_lost <> 0").isEmpty()


# toxicity


def cosine(index, a, b):
    x, y = dict(zip(a[0], index.unit(*a), strict=True)), dict(zip(b[0], index.unit(*b), strict=True))
    return sum(w * y[t] for t, w in x.items() if t in y)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_nearest_examples_are_exact(block):
    rnd = random.Random(3)
    vector = lambda: (sorted(rnd.sample(range(40), n := rnd.randint(1, 8))), [rnd.choice([1, 1, 2, 5]) for _ in range(n)])
    rows = [vector() for _ in range(300)]
    rows += rows[:40]
    index = BlockMaxIndex(rows, np.linspace(0.2, 5, 40), block)
    for _ in range(200):
        q, without = vector(), rnd.choice([-1, rnd.randrange(340)])
        ids, near = index.nearest(*q, 25, without)
        every = sorted(((cosine(index, q, r), i) for i, r in enumerate(rows) if i != without), key=lambda x: (-round(x[0], 12), x[1]))
        every = [x for x in every if x[0] > 0][:25]
        assert np.allclose(near, [x for x, _ in every]) and len(set(ids.tolist())) == len(every)
        kth = every[-1][0] if every else 0
        assert {i for x, i in every if x > kth + 1e-9} <= set(ids.tolist())
    assert [len(x) for x in index.nearest([], [], 25)] == [0, 0]


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op11_toxicity"](spark, sf).collect()
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    yes, no = [s for s, t in held if t], [s for s, t in held if not t]
    area = np.mean([(a > b) + (a == b) / 2 for a in yes for b in no])
    assert area > 0.95 and np.mean([s >= 0.5 for s in yes]) > 0.85 and np.mean([s >= 0.5 for s in no]) < 0.02
    assert abs(np.mean([s for s, _ in held]) - len(yes) / len(held)) < 0.02  # calibrated as a whole
    assert all(e.doc_id % 1 == 0 and zlib.crc32(str(e.doc_id).encode()) % 5 for r in rows for e in r.evidence)


def labelled(spark, n=200):
    texts = [f"plain words of document {'abcdefgh'[i % 8]} and more" + (" awful vile" if i % 4 == 0 else "") for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(n)], "doc_id long, toxic int")


def test_scores_depend_on_the_text_alone(spark):
    docs, labels = labelled(spark)
    twins = docs.union(spark.createDataFrame([(900, "so awful"), (901, "so awful"), (None, "so awful"), (902, ""), (903, None)], docs.schema))
    got = {r.doc_id: r for r in toxicity.toxicity(twins, labels).collect()}
    assert got[900].score == got[901].score == got[None].score > 0.5 and got[None].held_out
    assert got[902].score == got[903].score < 0.5 and got[902].evidence == []
    assert all(got[i].score > 0.5 if i % 4 == 0 else got[i].score < 0.5 for i in range(200))


def test_odd_rows_and_odd_labels(spark):
    docs, labels = labelled(spark)
    rows = odd(spark).selectExpr("*", "1 AS terms", "2 AS counts", "3 AS toxic", "4 AS score").repartition(2)
    some = rows.select("doc_id", "text").union(docs)
    strange = labels.union(spark.createDataFrame([(None, 1), (3, None), (4, 0), (10**9, 1)], labels.schema)).selectExpr("*", "'x' AS text", "1 AS label")
    assert toxicity.toxicity(some, strange).count() == rows.count() + 200
    assert toxicity.toxicity(rows, strange).count() == rows.count()
    assert toxicity.toxicity(empty(spark), labels).collect() == []
    for known, rate in ((labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0), (labels.filter("toxic = 0"), 0.0)):
        assert {r.score for r in toxicity.toxicity(docs, known).collect()} == {rate}


def test_the_sample_is_bounded(spark):
    docs, labels = labelled(spark, 400)
    texts, stands = toxicity.examples(docs, labels, Settings(per_class=20))
    assert texts.groupBy("toxic").count().collect() == [(0, 20), (1, 20)] or {tuple(r) for r in texts.groupBy("toxic").count().collect()} == {(0, 20), (1, 20)}
    assert stands[0] > 5 and stands[1] > 2
