"""Streams give the same rows however their input falls into batches."""

import pandas as pd
import pytest

import __spark_entry__  # noqa: F401  registers the queries
from crawlsight.plans import registry_rest as RR
from crawlsight.sources import given as G
from crawlsight.streaming import jobs as J

SF = "/root/testdata/sf0.001"
RUNS = {
    "str_seen_dedup": lambda s, f: J.append_to_table(J.seen_dedup(RR._crawled_twice(s, SF, f), ["site", "norm_url"]), J.work_folder(s)).select("site", "norm_url"),
    "str_scan_compare": lambda s, f: J.scan_compare(s, RR._scan_events(RR._stream(s, SF, "events", f)), J.work_folder(s)),
    "str_resume": lambda s, f: J.resume(s, RR._stream(s, SF, "pages", f), G.given_pages(s, SF).limit(20), J.work_folder(s)).select("page_id", "norm_url"),
    "str_progress": lambda s, f: J.replace_table(J.progress(RR._stream(s, SF, "events", f), "user_id"), J.work_folder(s)),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_and_eight_batches(spark, name):
    rows = [sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect()))) for df in (RUNS[name](spark, 1), RUNS[name](spark, 8))]
    assert rows[0] == rows[1] and rows[0]


def test_lines_without_a_line_feed_and_lines_that_are_no_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.ndjson").write_bytes(b'{"event_id":1,"event_type":"x"}\n\n{"event_id":2,"event_type":"y","more":1}')
    (tmp_path / "in" / "b.ndjson").write_bytes(b'{"event_id":3,"eve\r\n[1]\n{"event_id":"four"}\n  \n{"event_id":5,"event_type":"x"}\r\n')
    events, bad = J.route(spark, J.read_lines(spark, str(tmp_path / "in"), 1), "event_id long, event_type string", "event_type", J.work_folder(spark))
    assert sorted((r.event_id, r.event_type) for r in events.collect()) == [(1, "x"), (2, "y"), (5, "x")]
    assert sorted(r.bad.strip() for r in bad.collect()) == ['[1]', '{"event_id":"four"}', '{"event_id":3,"eve']


def test_a_later_batch_does_not_read_earlier_ones(spark):
    """Scans that arrive late change their own comparison and the next one's; keys that expire are met again."""
    rows = [("u", "site", f"s{d}", f"2024-01-0{d} 00:00:00", "seo", r) for d, r in ((1, "a"), (4, "c"), (2, "b"), (4, "a"), (3, "a"))]
    folder = J.work_folder(spark)
    for i, row in enumerate(rows):
        spark.createDataFrame([row], "url string, mode string, scan_id string, ts string, category string, rule_id string").selectExpr("url", "mode", "scan_id", "cast(ts as timestamp) ts", "category", "rule_id").write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in/0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    got = sorted(map(tuple, J.scan_compare(spark, stream, f"{folder}/run").collect()))
    assert got == [("s2", "seo", "a", "resolved"), ("s2", "seo", "b", "new"), ("s3", "seo", "a", "new"), ("s3", "seo", "b", "resolved"), ("s4", "seo", "c", "new")]


class Counted:
    """State in memory that counts the calls to it."""

    def __init__(self):
        self.kept, self.calls = {}, 0

    def called(self, result=None):
        self.calls += 1
        return result

    getValueState = getMapState = lambda self, name, *schemas: self
    exists = lambda self: self.called("order" in self.kept)
    get = lambda self: self.called(self.kept.get("order"))
    update = lambda self, value: self.called(self.kept.update(order=value))
    containsKey = lambda self, key: self.called(key in self.kept)
    getValue = lambda self, key: self.called(self.kept.get(key))
    updateValue = lambda self, key, value: self.called(self.kept.update({key: value}))


def test_a_site_asks_its_state_a_few_times_a_batch():
    """``str_scan_compare``: every call to the state is a message, so they do not grow with the scans a batch touches."""
    handle, scans, last = Counted(), J.SiteScans(), {}
    scans.init(handle)
    for batch in range(3):  # each scan's rules come in three batches
        rows = pd.DataFrame([(f"s{i:03}", i, "seo", f"r{(i * 7 + batch) % 5}") for i in range(150)], columns=["scan_id", "at", "category", "rule_id"])
        for out in scans.handleInputRows(("u", "site"), iter([rows]), None):
            for scan_id, changes in out.groupby("scan_id"):
                last[scan_id] = sorted((c, r) for c, r in zip(changes["change"], changes["rule_id"], strict=True) if c is not None)
    assert handle.calls <= 3 * 12
    found = [{f"r{(i * 7 + b) % 5}" for b in range(3)} for i in range(150)]
    assert last == {f"s{i:03}": [("new", r) for r in sorted(found[i] - found[i - 1])] + [("resolved", r) for r in sorted(found[i - 1] - found[i])] if i else [] for i in range(150)}
