"""Boundaries of rules and invariants on hand-made rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from crawlsight.functions import markup as M
from crawlsight.functions import text as T
from crawlsight.functions import urls as U
from crawlsight import session
from crawlsight.operators import duplicates as D
from crawlsight.operators import extract as X
from crawlsight.operators import graph as GR
from crawlsight.operators import history as H
from crawlsight.operators import page_rules as R


def page(head="", body="", html_attrs=' lang="en"'):
    return f"<!DOCTYPE html><html{html_attrs}><head>{head}</head><body>{body}</body></html>"


@pytest.fixture(scope="module")
def seo(spark):
    def words(n):
        return " ".join(["word"] * n)

    cases = {
        "t9": page("<title>" + "x" * 9 + "</title>"), "t10": page("<title>" + "x" * 10 + "</title>"),
        "t65": page("<title>" + "x" * 65 + "</title>"), "t66": page("<title>" + "x" * 66 + "</title>"), "t0": page("<title> </title>"),
        "d49": page(f'<meta name="description" content="{"y" * 49}">'), "d50": page(f'<meta name="description" content="{"y" * 50}">'),
        "d165": page(f'<meta name="description" content="{"y" * 165}">'), "d166": page(f'<meta name="description" content="{"y" * 166}">'),
        "w299": page(body=words(299)), "w300": page(body=words(300)), "skip": page(body="<h2>a</h2><h4>b</h4>"), "noskip": page(body="<h2>a</h2><h3>b</h3>"),
        "hidden": page("<!-- <title>No title here</title> -->", "<script>var a='<h1>x</h1>'</script>"),
    }
    ids = list(cases)
    df = spark.createDataFrame([(i, f"https://a.example.com/{k}", cases[k]) for i, k in enumerate(ids)], "page_id long, url string, html string")
    got = {}
    for r in R.audit(df, "seo").collect():
        got.setdefault(ids[r.page_id], set()).add((r.rule_id, r.passed))
    return got


@pytest.mark.parametrize("case,rule,passed", [
    ("t9", "title-length", False), ("t10", "title", True), ("t65", "title", True), ("t66", "title-length", False), ("t0", "title", False),
    ("d49", "meta-desc-length", False), ("d50", "meta-desc", True), ("d165", "meta-desc", True), ("d166", "meta-desc-length", False),
    ("w299", "thin-content", False), ("w300", "thin-content", True), ("skip", "heading-order", False), ("noskip", "heading-order", True),
    ("hidden", "title", False), ("hidden", "h1-missing", False),
])
def test_seo_boundaries(seo, case, rule, passed):
    assert (rule, passed) in seo[case]


def test_attributes_and_entities(spark):
    df = spark.createDataFrame([("<a title='href=no' HREF=\"q?a=1&amp;b=2\" hidden data-x=1>",)], "t string")
    r = df.select(M.attr(F.col("t"), "href").alias("h"), M.attr_or_null(F.col("t"), "alt").alias("n"), M.has_attr(F.col("t"), "hidden").alias("p"),
                  T.decode_entities(F.lit("&#233;&#xE9;&eacute;&nope; &amp;lt;")).alias("e")).first()
    assert (r.h, r.n, r.p, r.e) == ("q?a=1&b=2", None, True, "ééé&nope; &lt;")


@pytest.mark.parametrize("href,base,want", [
    ("http://Ex.com:80/a/b/../c?x=1", "https://x.com/", "http://ex.com/a/c?x=1"), ("../z.png", "https://x.com/p/q/r.html", "https://x.com/p/z.png"),
    ("//cdn.y.com/a", "https://x.com", "https://cdn.y.com/a"), ("htt p://broken url", "https://x.com/", None), ("?q=1", "https://x.com/a/b", "https://x.com/a/b?q=1"),
    ("c d", "https://x.com/a/b", "https://x.com/a/c%20d"), ("/für", "https://x.com/", "https://x.com/f%C3%BCr"),
])
def test_resolve(spark, href, base, want):
    df = spark.createDataFrame([(href, base)], "h string, b string")
    assert df.select(U.resolve(F.col("h"), F.col("b"))).first()[0] == want


def test_long_page_does_not_overflow(spark):
    body = "<p>some text</p><a href='/x'>y</a>" * 20000
    df = spark.createDataFrame([(1, "https://a.example.com/", page(body=body))], "page_id long, url string, html string")
    assert X.page_features(df).select("n_words").first()[0] > 20000
    assert X.tokens(df).agg(F.sum(F.length("token"))).first()[0] == len(page(body=body))


def test_near_duplicates_equal_brute_force(spark):
    base = [f"w{i}" for i in range(80)]
    docs = [(0, base)]
    docs += [(k, base[: 80 - k] + [f"n{k}x{i}" for i in range(k)]) for k in range(1, 12)]
    docs += [(20 + k, [f"z{k}q{i}" for i in range(40)]) for k in range(3)]
    rows = [(i, " ".join(w)) for i, w in docs]

    def sh(t):
        w = t.split(" ")
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for (a, ta), (b, tb) in itertools.combinations(rows, 2):
        sa, sb = sh(ta), sh(tb)
        if len(sa & sb) / len(sa | sb) >= 0.9:
            want.add((a, b))
    got = {(r.id_a, r.id_b) for r in D.near_duplicates(D.shingle_sets(spark.createDataFrame(rows, "id long, text string"))).collect()}
    assert want and got == want


def test_redirect_outcomes(spark):
    rows = [("a", 301, "b"), ("b", 302, "a"), ("c", 301, None), ("d", 301, "e"), ("e", 200, None), ("f", 301, "gone"), ("g", 404, None)]
    rows += [(f"h{i}", 301, f"h{i + 1}") for i in range(9)] + [("h9", 200, None)]
    got = {r.url: r.outcome for r in GR.redirect_chains(spark.createDataFrame(rows, "url string, status int, location string")).collect()}
    assert got["a"] == got["b"] == "loop" and got["c"] == "no-location" and got["d"] == "ok"
    assert got["f"] == "unknown" and got["g"] == "error" and got["h0"] == "too-many" and got["h2"] == "ok"


def test_next_run_clamps_month_end(spark):
    df = spark.createDataFrame([("monthly", "2024-01-31 08:00:00"), ("yearly", "2024-02-29 08:00:00")], "f string, t string")
    got = [str(r[0]) for r in df.select(H.next_run(F.col("f"), F.col("t").cast("timestamp"))).collect()]
    assert got == ["2024-02-29 08:00:00", "2025-02-28 08:00:00"]


def test_security_keeps_the_twelve_worst(spark):
    df = spark.createDataFrame([(1, "http://a.example.com/", page(), {"server": "x" * 30, "x-powered-by": "PHP"})],
                               "page_id long, url string, html string, headers map<string,string>")
    rows = [r for r in R.audit(df, "security_headers").collect() if not r.passed]
    assert len(rows) == 11 and rows[0].weight == 15


def test_page_audit_has_no_shuffle(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/", page())], "page_id long, url string, html string")
    plan = R.all_findings(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_passage_in_a_third_of_all_texts_makes_few_candidates(spark, monkeypatch):
    """Candidate pairs grow with the corpus, not with the square of the texts that share a passage."""
    from crawlsight.operators import duplicates as D

    made, stored = {}, D.stored

    def counted(df, name):
        out = stored(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(D, "stored", counted)
    passage = " ".join(f"p{i}" for i in range(60))
    sizes = []
    for n in (150, 600):
        texts = [f"{passage} " + " ".join(f"u{i}x{k}" for k in range(1 + i % 9)) if i % 3 == 0 else " ".join(f"w{i}x{k}" for k in range(50)) for i in range(n)]
        texts += [t + " end" for t in texts[:20:4]]
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        sets = D.shingle_sets(docs)
        found = {(r.id_a, r.id_b) for r in D.near_duplicates(sets, 0.9).collect()}
        words = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
        plain = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 10 * len(words[a] & words[b]) >= 9 * len(words[a] | words[b])}
        assert found == plain
        sizes.append((made["candidates"], len(plain)))
    assert sizes[1][0] <= 2 * sizes[1][1] + 600, sizes


def brute_force(rows, threshold):
    """(id_a, id_b, common) of the pairs of (id, text) with a similarity of at least ``threshold`` hundredths."""
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    common = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    return {(a, b, n) for (a, b), n in common.items() if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n)}


@pytest.mark.parametrize("threshold", [0.7, 0.9])
def test_near_duplicates_keep_less_than_their_sets(spark, tmp_path, monkeypatch, threshold):
    """A set of 8-byte hashes is larger than its text: what is stored stays in proportion to the texts."""
    monkeypatch.setattr(session, "shared_folder", lambda _: f"{tmp_path}/shared")
    rows = [(i, " ".join(f"w{i * k * k % 997}" for k in range(1, 600))) for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id_a, r.id_b) for r in D.near_duplicates(D.shingle_sets(docs), threshold).collect()}
    size = sum(x.stat().st_size for x in (tmp_path / "shared").rglob("*.parquet"))
    assert got == {(a, b) for a, b, _ in brute_force(rows, round(100 * threshold))}
    assert 0 < size < 8 * sum(len(t.split()) for _, t in rows)


@pytest.mark.parametrize("block", [300, 1 << 16])
def test_large_groups_are_checked_block_by_block(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    base = [f"w{i}" for i in range(60)]
    rows = [(100 - i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]  # a group of copies, each edited in its own way
    rows += [(200 + i, " ".join([f"y{i // 2}z{k}" for k in range(45)] + ["end"] * (i % 2))) for i in range(20)]  # and pairs
    docs = spark.createDataFrame([*rows, (7, None), (300, "")], "id long, text string")
    got = [(r.id_a, r.id_b, r.common) for r in D.near_duplicates(D.shingle_sets(docs), 0.7).select("id_a", "id_b", "common").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_force(rows, 70)


def test_findings_of_near_duplicates_do_not_move_texts(spark, monkeypatch):
    """``audit_duplicates``: of the texts only their keys and the places of those that nobody else has are dealt out again."""
    made, old = {}, D.stored
    monkeypatch.setattr(D, "stored", lambda df, name: made.setdefault(name, old(df, name)))
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base[:-1], "x"])), (4, " ".join([*base[:-1], "y"])), (5, "too short"), (6, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    none = spark.createDataFrame([], "id long, key string")
    got = sorted((r.rule_id, r.n) for r in D.audit_duplicates(none, none, docs).collect())
    assert got == [("duplicate-body-content", 1), ("near-duplicate-content", 1)]
    assert made["body-keys"].columns == ["id", "body_key", "batch", "place"]
