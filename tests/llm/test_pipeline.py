"""The pipeline against its stages written down plainly, one document after the other."""

import collections
import os
import subprocess
import sys
import zlib
from array import array

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from crawlsight.llm import quality, secrets
from crawlsight.llm.jaccard import Similarity
from tests.llm.helpers import empty, odd
from tests.llm.test_jaccard import plain_components
from tests.llm.test_scans import plain_hits

SF = "/root/testdata/sf0.001"


def plain_quality(rows):
    """Rules evaluated by DuckDB over the features, EM over single documents."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE f (i int, {quality.FEATURES.replace(' long', ' bigint')})")
    con.executemany(f"INSERT INTO f VALUES ({', '.join('?' * (1 + len(quality.NAMES)))})", [(i, *quality.text_features(t)) for i, (_, t) in enumerate(rows)])
    votes = ", ".join(f"CASE WHEN n_words = 0 OR ({r.bad}) THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in quality.RULES)
    judged = con.execute(f"SELECT n_words < 50 OR 100 * n_repeat_words > 50 * n_words, {votes} FROM f ORDER BY i").fetchall()
    model = quality.fit_votes([(list(v[1:]), 1) for v in judged], len(quality.RULES))
    return [r for r, v in zip(rows, judged, strict=True) if not v[0] and model.log_odds(list(v[1:])) >= 0]


def test_run_is_what_its_stages_say(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = plain_quality(rows)
    rows = [r for r, (i, _, least) in zip(rows, plain_components(rows, Similarity(5, 80)), strict=True) if i == least]
    rows = [r for r, h in zip(rows, plain_hits(rows, items), strict=True) if h[2] == 0]
    rows = [(i, secrets.without(t, secrets.scanner().spans(t))) for i, t in rows]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or min(1024, len(ids)), len(ids) + 1, 1024)]
        want.update((i, k, a, b - a, zlib.crc32(array("I", ids[a:b]).tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    assert 0 < len(rows) < 200


def test_stages_take_odd_and_no_rows_and_keep_the_columns(spark):
    for docs in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == (odd(spark) if "row_no" in docs.columns else empty(spark)).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "decontamination", "secret scan", "best-fit packing"]


def test_the_rest_imports_without_the_package():
    """With the two folders hidden, the entry still imports and has the other queries only."""
    code = (
        "import importlib.util as u, sys\n"
        "real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n in ('crawlsight.llm', 'corpus_pipeline') else real(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and len(e.queries()) > 170\n"
        "assert not any(m.startswith('crawlsight.llm') for m in sys.modules)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


