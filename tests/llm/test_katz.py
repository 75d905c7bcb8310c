"""The model against one that is written down plainly, and its probabilities against their sum."""

import collections
import math
import zlib

import numpy as np
import pytest

from crawlsight.llm import katz

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_model(rows):
    """p(word | context) from dictionaries."""
    one, two = collections.Counter(), collections.Counter()
    starts = 0
    for doc_id, text in rows:
        if zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2:
            continue
        tokens = [*words(text), None]
        starts += 1
        one.update(tokens)
        two.update(zip(["<s>", *tokens], tokens, strict=False))
    spectrum = lambda c: [sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]
    d1, d2 = katz.Discounts.of(spectrum(one)), katz.Discounts.of(spectrum(two))
    cut = lambda d, c: d.factor[min(c, katz.K + 1)] * c
    total = sum(one.values())
    kept = sum(cut(d1, c) for c in one.values())
    n = max(1, total + (kept >= total))
    follow = collections.defaultdict(dict)
    for (v, w), c in two.items():
        follow[v][w] = c

    def p1(w):
        return cut(d1, one[w]) / n if one[w] else 1 - kept / n

    def p2(w, v):
        seen = follow.get(v)
        if not seen:
            return p1(w)
        size = sum(seen.values())
        size += all(c > katz.K for c in seen.values())
        if w in seen:
            return cut(d2, seen[w]) / size
        return (1 - sum(cut(d2, c) for c in seen.values()) / size) / (1 - sum(p1(x) for x in seen)) * p1(w)

    return one, follow, p1, p2


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


ODD = [(None, "a b a"), (None, None), (7, ""), (7, ""), (8, "the " * 500), (9, "É é É A\u000ba\x1cb")]


@pytest.mark.parametrize("batch", [katz.BATCH, 3000])
def test_scores_are_those_of_the_plain_model(spark, batch):
    rows = documents(spark) + ODD
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"], r["train_tokens"]) for r in katz.log_scores(df, batch).collect()))
    one, _, _, p2 = plain_model(rows)
    total, known = sum(one.values()), len(one)
    want = []
    for i, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((one[w] + 1) / (total + known + 1)) for w in tokens)
        score = sum(math.log10(p2(w, v)) for v, w in zip(["<s>", *tokens], tokens, strict=False))
        want.append((i is None, i or 0, len(tokens), sum(one[w] > 0 for w in tokens), base, score, total))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:4] == w[:4] and g[6] == w[6]
        assert g[4] == pytest.approx(w[4], rel=1e-9) and g[5] == pytest.approx(w[5], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    one, follow, p1, p2 = plain_model(documents(spark)[:60])
    assert sum(p1(w) for w in one) + p1("never seen") == pytest.approx(1)
    for v in list(follow)[:25] + ["never seen"]:
        assert sum(p2(w, v) for w in one) + p2("never seen", v) == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_the_base(spark):
    rows = katz.log_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_empty_table_and_nothing_learnt(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.log_scores(none).collect() == []
    held = next(i for i in range(100) if katz.held_out(i))
    (row,) = katz.log_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["n_tokens"] == 3 and np.isfinite(row["score"])
