"""The near-duplicate join against all pairs."""

import collections
import random
import re

import pytest

from crawlsight.llm import jaccard
from tests.llm.helpers import bag, empty, given, in_files, odd, resplit


def plain_sets(rows, words):
    out = []
    for i, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        out.append((i, frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset()))
    return out


def plain_components(rows, sim):
    """(doc_id, size, smallest doc_id) by testing every two documents."""
    sets = plain_sets(rows, sim.words)
    over = list(range(len(sets)))

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for a, (_, s) in enumerate(sets):
        for b in range(a):
            t = sets[b][1]
            if s and t and sim.den * len(s & t) >= sim.num * len(s | t):
                over[top(a)] = top(b)
    least = collections.defaultdict(lambda: None)
    for a, (i, _) in enumerate(sets):
        k = top(a)
        least[k] = i if least[k] is None else least[k] if i is None else min(i, least[k])
    return [(i, len(s), least[top(a)]) for a, (i, s) in enumerate(sets)]


def compare(df, sim):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, sim).collect()]
    assert bag(got) == bag(plain_components(rows, sim))


@pytest.mark.parametrize("sim", [jaccard.Similarity(4, 85), jaccard.Similarity()])
def test_given_documents(spark, sim):
    compare(given(spark), sim)


def edited(rnd, words, share):
    return [rnd.choice("qrstuvwxyz") + str(rnd.random()) if rnd.random() < share else w for w in words]


def test_groups_at_the_threshold(spark):
    """Copies with edits on both sides of the threshold, passages that many share, and rows that repeat."""
    rnd = random.Random(2)
    rows = []
    passage = [f"p{i}" for i in range(40)]
    for g in range(12):
        base = [f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(3, 90))]
        rows += [" ".join(edited(rnd, base, rnd.choice([0, 0.005, 0.01, 0.02, 0.04]))) for _ in range(14)]
        rows += [" ".join([*passage, *[str(rnd.random()) for _ in range(rnd.randint(0, 12))]]) for _ in range(5)]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(rows)] + [(3, rows[3]), (500, rows[4].upper())]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), jaccard.Similarity(4, 85))


def test_odd_rows(spark):
    compare(odd(spark), jaccard.Similarity(4, 85))
    assert jaccard.near_duplicates(empty(spark)).collect() == []
    one = jaccard.one_of_each(odd(spark))
    assert one.columns == odd(spark).columns
    assert bag(r["doc_id"] for r in one.collect()) == bag([None, None, 1, 1, 2, 4, 5, 6, 7, 8])


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r["node"]: r["component"] for r in jaccard.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


def test_prefix_and_bitmap_are_bounds():
    rnd = random.Random(4)
    for sim in (jaccard.Similarity(4, 85), jaccard.Similarity()):
        for _ in range(300):
            import numpy as np

            a = {rnd.getrandbits(63) for _ in range(rnd.randint(1, 80))}
            b = {x for x in a if rnd.random() > 0.1} | {rnd.getrandbits(63) for _ in range(rnd.randint(0, 6))}
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            if not len(y):
                continue
            differ = sum(bin(int(p) ^ int(q)).count("1") for p, q in zip(jaccard.bitmap(x).view("<u8"), jaccard.bitmap(y).view("<u8"), strict=True))
            assert differ <= len(a ^ b)
            if sim.linked(len(a & b), len(a), len(b)):
                assert set(sorted(a)[: sim.prefix(len(a))]) & set(sorted(b)[: sim.prefix(len(b))])


def test_keys_survive_their_planes():
    import numpy as np

    keys = np.unique(np.random.default_rng(0).integers(0, 1 << jaccard.KEY_BITS, 1000).astype(np.uint64))
    assert (jaccard.from_planes(jaccard.planes(keys)) == keys).all()


def test_the_right_rows_stay_when_a_later_scan_splits_the_files_otherwise(spark, tmp_path, monkeypatch):
    docs = in_files(spark, tmp_path, [(i, f"text {i // 2} of five words") for i in range(60)])
    with resplit(spark, monkeypatch, jaccard, "near-duplicates"):
        assert bag(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == bag(range(0, 60, 2))


def test_all_links_and_their_classes(spark):
    """Every similar pair of different sets once, whatever groups they are in."""
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [" ".join(edited(rnd, base, 0.02)) for _ in range(60)] + [" ".join(base)] * 5 + ["", None, "one two"]
    docs, sim = list(enumerate(rows)), jaccard.Similarity()
    members, links = jaccard.similar_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), sim)
    named = {r["doc_id"]: r["class_no"] for r in members.collect()}
    sets = plain_sets(docs, sim.words)
    assert all((named[i] is None) == (not s) for i, s in sets)
    assert all((named[i] == named[j]) == (s == t) for i, s in sets for j, t in sets if s and t)
    of = {named[i]: s for i, s in sets if s}
    linked = {(a, b) for a in of for b in of if a < b and sim.den * len(of[a] & of[b]) >= sim.num * len(of[a] | of[b])}
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == linked and linked


def test_a_large_group_joins_without_its_pairs(spark):
    """Copies edited each in its own way, around the threshold: few pairs are left once the hub has taken its own."""
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    rows = [" ".join(edited(rnd, base, rnd.choice([0.003, 0.01, 0.02, 0.03]))) for _ in range(500)]
    docs, sim = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4), jaccard.Similarity()
    compare(docs, sim)
    _, _, sets = jaccard.prepared(jaccard.numbered(docs), sim)
    assert jaccard.links(sets, sim).count() < 3 * len(rows) < jaccard.all_links(sets, sim).count()
