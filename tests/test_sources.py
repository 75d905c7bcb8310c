"""Projects, scan stores, sitemaps and reports as files; graphs of any depth; rules of users."""

import csv
import io
import json
import warnings
import zipfile

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from crawlsight.operators import custom as CU
from crawlsight.operators import generate as GE
from crawlsight.operators import graph as GR
from crawlsight.operators import report as RP
from crawlsight.operators import site_files as SI
from crawlsight.operators.page_rules import findings_of as RP_FINDINGS
from crawlsight.plans import registry_rest
from crawlsight.sources import projects as PJ
from crawlsight.sources import scan_store as STORE

FILES = {
    "shop/package.json": b'{"name":"shop"}',
    "shop/src/App.tsx": "<img src='ä'>".encode(),
    "shop/src/deep/er/a b+c%20d.vue": b"<p/>",
    "shop/bad.txt": b"\xff\xfe ok",
    "blog/index.html": b"<html></html>" * 100,
}


def test_a_folder_and_its_archives_give_the_same_rows(spark, tmp_path):
    tree, zips = tmp_path / "tree", tmp_path / "zips"
    zips.mkdir()
    for name, raw in FILES.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(raw)
    for project in ("shop", "blog"):
        with zipfile.ZipFile(zips / f"{project}.ZIP", "w", zipfile.ZIP_DEFLATED) as z:
            z.mkdir("src")
            for name, raw in FILES.items():
                if name.startswith(project):
                    z.writestr("./" + name.split("/", 1)[1], raw)
    (zips / "notes.txt").write_text("no archive")
    from_tree = sorted((r.project, r.path, r.size, r.content) for r in PJ.read_tree(spark, str(tree)).collect())
    from_zips = sorted((r.archive, r.path, r.size, r.content) for r in PJ.read_archives(spark, str(zips)).collect())
    assert from_tree == from_zips == sorted((n.split("/")[0], n.split("/", 1)[1], len(raw), raw.decode("utf-8", "replace")) for n, raw in FILES.items())
    assert PJ.read_tree(spark, f"file://{tree}", max_file_bytes=20).count() == 4


def archive(files):
    raw = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        warnings.simplefilter("ignore")
        for name, content in files:
            z.writestr(name, content)
    return raw.getvalue()


def test_archives_that_are_refused(spark):
    bomb = archive([("zeros", b"\0" * (8 << 20))])
    lying = bytearray(archive([("a", b"x" * 100)]))
    at = lying.index(b"PK\x01\x02")
    lying[at + 24 : at + 28] = (5).to_bytes(4, "little")  # the directory says five bytes
    rows = [("good", archive([("../../a", b"1"), ("..", b"2"), ("x\\y", b"3"), ("x/y", b"4")])), ("bomb", bomb), ("many", archive([(str(i), b"") for i in range(30)])), ("cut", bomb[:40]), ("none", None), ("lying", bytes(lying))]
    df = spark.createDataFrame(rows, "archive string, content binary").selectExpr("*", "1 AS path", "2 AS problem")
    got = PJ.archived_files(df, max_bytes=1 << 20, max_files=20).collect()
    assert {r.archive: r.problem for r in got if r.problem and r.archive != "lying"} == {"bomb": "too large", "many": "too many files", "cut": "BadZipFile", "none": "BadZipFile"}
    assert sorted((r.path, r.content) for r in got if r.archive == "good") == [("a", "1"), ("x/y", "3"), ("x/y", "4")]
    assert all(len(r.content or "") <= 5 for r in got if r.archive == "lying")
    assert PJ.archived_files(df.limit(0)).collect() == []


def test_descendants_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds, stored = [], GR.stored
    monkeypatch.setattr(GR, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    n = 5000
    chain = spark.range(n).selectExpr("id AS node", "nullif(id - 1, -1) AS parent")
    got = {r.node: r.n_descendants for r in GR.descendants(chain).collect()}
    assert got == {i: n - 1 - i for i in range(n)} and len(rounds) <= 15


def test_descendants_of_stars_forests_and_strays(spark):
    rows = [(0, None), *[(i, 0) for i in range(1, 50)], *[(i, 7) for i in range(50, 60)], (100, 999), (101, 100), (200, None)]
    got = {r.node: r.n_descendants for r in GR.descendants(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert got == {r[0]: 0 for r in rows} | {0: 59, 7: 10, 100: 1}
    assert GR.descendants(spark.createDataFrame([], "node long, parent long")).collect() == []


@pytest.mark.parametrize("ring", [[(1, 1)], [(1, 2), (2, 1)], [(0, None), (1, 3), (2, 1), (3, 2), (4, 3)]])
def test_a_cycle_is_an_error(spark, ring):
    with pytest.raises(ValueError, match="cycle"):
        GR.descendants(spark.createDataFrame(ring, "node long, parent long"))


def walked(hops, url, most):
    chain, cur = [], url
    for _ in range(most):
        st, loc = hops.get(cur, (None, None))
        if st is None:
            return len(chain), cur, st, "unknown"
        if not 300 <= st < 400:
            return len(chain), cur, st, "ok" if st < 400 else "error"
        if loc is None:
            return len(chain), cur, st, "no-location"
        if loc in [*chain, cur]:
            return len(chain), loc, st, "loop"
        chain, cur = [*chain, cur], loc
    return len(chain), cur, None, "too-many"


@pytest.mark.parametrize("most", [1, 3, 8])
def test_redirects_are_those_of_walking(spark, most):
    hops = {f"c{i}": (301, f"c{i + 1}") for i in range(20)} | {"c20": (200, None), "e": (404, None), "f": (302, "e"), "g": (301, None), "h": (301, "nowhere"), "i": (301, "i")}
    hops |= {"j": (301, "k"), "k": (307, "l"), "l": (301, "j"), "m": (301, "j"), "n": (200, "c1"), "o": (199, None)} | {f"hot{i}": (301, "c19") for i in range(40)}
    df = spark.createDataFrame([(u, s, loc) for u, (s, loc) in hops.items()], "url string, status int, location string")
    got = {r.url: tuple(r)[1:] for r in GR.redirect_chains(df, most).collect()}
    assert got == {u: walked(hops, u, most) for u in hops}


def scans(spark, rows):
    return spark.createDataFrame(rows, "scan_id string, at string, score int").selectExpr("scan_id", "cast(at as timestamp) created_at", "score")


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "scans")
    STORE.create(scans(spark, [("a", "2024-01-01 10:00:00", 1), ("b", "2024-01-01 11:00:00", 2), ("c", "2024-01-02 10:00:00", 3), ("a", "2024-01-01 09:00:00", 9)]), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "scans" / "day=2024-01-02").iterdir()}
    batch = scans(spark, [("b", "2024-01-03 08:00:00", 20), ("d", "2024-01-01 12:00:00", 4), ("a", "2024-01-01 10:00:00", 10)])
    want = [("a", "2024-01-01", 10), ("b", "2024-01-03", 20), ("c", "2024-01-02", 3), ("d", "2024-01-01", 4)]
    for _ in range(3):
        STORE.upsert(spark, path, batch)
        assert sorted((r.scan_id, str(r.day), r.score) for r in STORE.table(spark, path).collect()) == want
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "scans" / "day=2024-01-02").iterdir()} == before  # not touched
    STORE.merge(spark, path, scans(spark, [("a", "2024-01-09 10:00:00", 99), ("e", "2024-01-09 10:00:00", 5)]))
    assert sorted((r.scan_id, r.score) for r in STORE.table(spark, path).collect()) == [("a", 10), ("b", 20), ("c", 3), ("d", 4), ("e", 5)]


def test_the_last_scan_of_a_day_can_move(spark, tmp_path):
    path = str(tmp_path / "scans")
    STORE.create(scans(spark, [("a", "2024-01-01 10:00:00", 1)]), path)
    for day in ("2024-01-02", "2024-01-02", "2024-01-01"):
        STORE.upsert(spark, path, scans(spark, [("a", f"{day} 10:00:00", 7)]))
        assert [(r.scan_id, str(r.day)) for r in STORE.table(spark, path).collect()] == [("a", day)]


def test_a_look_up_reads_one_day(spark, tmp_path, capsys):
    path = str(tmp_path / "scans")
    STORE.create(scans(spark, [(f"s{i}", f"2024-01-0{1 + i % 5} 10:00:00", i) for i in range(50)]), path)
    found = STORE.lookup(spark, path, "2024-01-03", "s7")
    assert [r.score for r in found.collect()] == [7]
    found.explain()
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out


def test_sitemap_files_are_full_and_in_order(spark, tmp_path):
    pages = spark.createDataFrame([("big", f"https://big/{i:05}") for i in range(1003)] + [("small", "https://small/")], "site string, url string").repartition(7)
    lines = GE.sitemap_lines(pages, "2024-01-31", 100)
    got = sorted((r.site, r.file_no, r.url) for r in lines.collect())
    assert got == [("big", i // 100, f"https://big/{i:05}") for i in range(1003)] + [("small", 0, "https://small/")]
    assert sorted((r.site, r.file_no) for r in GE.sitemap_index(lines, "2024-01-31").collect()) == [("big", k) for k in range(11)] + [("small", 0)]
    GE.write_sitemaps(lines, str(tmp_path / "maps"))
    for k in range(11):
        (file,) = (tmp_path / "maps" / "site=big" / f"file_no={k}").glob("part-*")
        text = file.read_text().splitlines()
        assert text[0] == GE.SITEMAP and text[-1] == "</urlset>" and len(text) == 2 + (100 if k < 10 else 3)
        assert text[1:-1] == sorted(text[1:-1])


def test_reports_are_whole_documents(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    audited = registry_rest._audited(spark, sf)
    report = RP.Report(audited, RP_FINDINGS(audited), spark.createDataFrame([("seo", "title")], "category string, rule_id string"), "https://x.example.com/", "2024-01-31")
    texts = {}
    for kind in RP.FORMATS:
        RP.write(report, kind, str(tmp_path / kind))
        texts[kind] = "".join(f.read_text() for f in sorted((tmp_path / kind).glob("part-*")))
    whole = json.loads(texts["json"])
    assert len(whole["categories"]) == 6 and len(whole["pages"]) == audited.count() and whole["overall_score"] == round(sum(x["score"] for x in whole["categories"]) / 6)
    weights = [x["weight"] for x in whole["issues"]]
    assert weights == sorted(weights, reverse=True) and [p["url"] for p in whole["pages"]] == sorted(p["url"] for p in whole["pages"])
    rows = list(csv.reader(texts["csv"].splitlines()))
    assert len(rows) == len(texts["tsv"].splitlines()) and rows[2][:2] == ["Category", "Score"]
    order = [texts["markdown"].index(x) for x in ("# Audit report", "## Category scores", "## Issues", "## Passed checks", "## Per-page scores")]
    assert order == sorted(order) and texts["txt"].startswith("=" * 70 + "\nAUDIT REPORT") and texts["yaml"].count("\n  - ") == 6 + len(whole["issues"]) + len(whole["passed_checks"]) + len(whole["pages"])


def test_rules_that_fail_do_not_stop_others(spark):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, 0.0)], "id long, name string, x double")
    got = CU.row_rules(df, {"long": lambda r: len(r["name"]), "inverse": lambda r: 1 / r["x"] if r["x"] != 2.5 else None}, ["id"])
    assert got.dtypes[0] == ("id", "bigint")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "long", "1", None), (2, "inverse", None, "ZeroDivisionError: float division by zero"), (2, "long", None, "TypeError: object of type 'NoneType' has no len()")]


def test_rules_over_rows_move_them_in_batches(spark):
    """``udf_row_rules``: keys keep their values, whatever their types, and a rule sees what a Row of the table holds."""
    df = spark.sql("SELECT id, timestamp'2024-01-02 03:04:05' + make_dt_interval(0, 0, 0, id) AS at, cast(id as decimal(9,2)) AS price, "
                   "named_struct('x', array(id, null)) AS nested, if(id % 2 = 0, null, 'odd') AS word FROM range(2500)")
    rules = {"seen": lambda r: f"{r.at} {r.price} {r['nested'].x}" if r.id % 1000 == 1 else None, "fails": lambda r: r.word.upper() if r.id > 2497 else None}
    out = CU.row_rules(df, rules, ["nested", "at", "id"])
    assert out.columns == ["id", "at", "nested", "custom_rule", "found", "error"] and "UDTF" not in out._jdf.queryExecution().executedPlan().toString()
    rows = {r.id: r for r in df.collect()}
    want = [(i, "seen", f"{rows[i].at} {rows[i].price} {[i, None]}", None) for i in (1, 1001, 2001)]
    want += [(2498, "fails", None, "AttributeError: 'NoneType' object has no attribute 'upper'"), (2499, "fails", "ODD", None)]
    got = out.collect()
    assert sorted((r.id, r.custom_rule, r.found, r.error) for r in got) == want and all((r.at, r.nested) == (rows[r.id].at, rows[r.id].nested) for r in got)


def test_a_large_sitemap_is_read_entry_by_entry(spark, tmp_path):
    entries = "".join(f"<url>\n <loc>https://x.example.com/{i}?a=1&amp;b=2</loc><image:image><image:loc>no</image:loc></image:image><lastmod><![CDATA[2024-01-0{1 + i % 9}]]></lastmod></url>\n" for i in range(50_000))
    (tmp_path / "big.xml").write_text(f'<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">{entries}</urlset>')
    (tmp_path / "cut.xml").write_text("<urlset><url><loc>https://y.example.com/</loc></url><url><loc>https://y.example.com/cut")
    got = {(r["loc"], r["lastmod"]) for r in SI.read_sitemap_files(spark, str(tmp_path)).collect() if r["loc"]}
    want = {(f"https://x.example.com/{i}?a=1&b=2", f"2024-01-0{1 + i % 9}") for i in range(50_000)} | {("https://y.example.com/", None)}
    assert want <= got and len(got - want) <= 1
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "i.xml").write_text("<sitemapindex><sitemap><loc>https://x.example.com/1.xml</loc></sitemap><sitemap/></sitemapindex>")
    assert [r["loc"] for r in SI.read_sitemap_files(spark, str(tmp_path / "index"), "sitemap").collect() if r["loc"]] == ["https://x.example.com/1.xml"]
