"""Operators 3, 5, 9 and 10, and 6 against SQL."""

import base64
import collections
import hashlib
import json
import random
import re
import time
import zlib

import duckdb
import pytest

from crawlsight.llm import decontaminate, licenses, quality, queries, secrets, shards
from tests.llm.helpers import bag, empty, given, in_files, odd, resplit

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    res = con.execute(queries.ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    theirs = collections.Counter(tuple(repr(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert collections.Counter(tuple(repr(r[c]) for c in cols) for r in df.collect()) == theirs


# secrets

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def test_base_spans_are_those_of_plain_expressions():
    rnd, scan = random.Random(1), secrets.Scanner(secrets.BASE)
    parts = ["password", "PassWd", "SECRET", "token", "api_key", "ApiKey", "apikey", '"', "'", " ", "  ", ":", "=", "abcdef012345", "AKIA", "AKIAAKIA", "ABCDEFGH1234567890", "deadbeef", "é", "\n", "0" * 15, "0" * 16, "-", "tokentoken="]
    for _ in range(20000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        assert scan.spans(text) == base_spans(text), repr(text)


def checked(prefix, body):
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    return prefix + body + digits


def test_checksums_decide():
    good = checked("ghp_", "Zq" * 15)
    kinds = lambda text: [secrets.KINDS[i].name for _, i, _ in secrets.scanner().spans(text)]
    assert kinds(good) == ["github"] and kinds(good[:-1] + ("A" if good[-1] != "A" else "B")) == []
    assert kinds(checked("npm_", "Zz0" * 10)) == ["npm"]
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    assert kinds(f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.sig") == ["jwt"]
    assert kinds(f"{part({'typ': 'x'})}.{part({'sub': 1})}.sig") == []
    assert kinds("card: 4111 1111 1111 1111") == ["card"] and kinds("card: 4111 1111 1111 1112") == []
    der = base64.b64encode(b"\x30\x82\x01\x00" + b"x" * 256).decode()
    pem = "-----BEGIN RSA PRIVATE KEY-----\n%s\n-----END RSA PRIVATE KEY-----"
    assert "pem" in kinds(pem % der) and "pem" not in kinds(pem % base64.b64encode(b"nothing").decode())


def test_secrets_query_rows(spark):
    for row, text in zip(queries.op3_secret_scan(spark, SF).orderBy("doc_id").collect(), [r["text"] for r in given(spark).orderBy("doc_id").collect()], strict=True):
        spans = base_spans(text)
        names = [f"{('assign', 'access', 'hex')[i]}:{a}:{b}" for a, i, b in spans]
        assert row["base_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert set(names) <= set(row["spans"].split(","))


def test_secrets_of_odd_rows_and_redaction(spark):
    df = odd(spark)
    assert secrets.find_secrets(df).count() == 12 and secrets.find_secrets(empty(spark)).collect() == []
    assert bag(secrets.redacted(df).collect()) == bag(df.collect())  # no secrets, nothing changed
    one = spark.createDataFrame([(1, "x password=abcdef0123456789 y", 29)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redacted(one).collect()] == [(1, "x [SECRET] y", 12)]


# licences

MIT = "\n".join(["MIT License", "", licenses.SENTENCES["mit-grant"].replace("restriction, ", "restriction,\n"), "", licenses.SENTENCES["mit-notice"], "", licenses.SENTENCES["as-is"] + " " + licenses.SENTENCES["no-event"]])


def test_licences(spark):
    rows = [(1, MIT), (2, "code\nReleased under the MIT license\nmore"), (3, licenses.SENTENCES["mit-notice"]), (4, "SPDX-License-Identifier: Apache-2.0"), (5, "LICENSED UNDER CC BY-NC 4.0. Released under the MIT License."), (6, "A licence to kill.")]
    got = {r["doc_id"]: r["licences"] for r in licenses.licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "", 4: "Apache-2.0", 5: "MIT,CC-BY-NC-4.0", 6: ""}
    assert licenses.licences(odd(spark)).count() == 12 and licenses.licences(empty(spark)).collect() == []


APACHE = """Copyright [yyyy] [name of copyright owner]

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n"


def test_licences_in_their_published_layout(spark):
    spdx = {"GPL-2.0": "GPL-2.0", "GPL-2.0-only": "GPL-2.0", "GPL-2.0+": "GPL-2.0-or-later", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPL-3.0-only": "GPL-3.0", "GPL-3.0+": "GPL-3.0-or-later"}
    spdx |= {"LGPL-2.1-or-later": "LGPL-2.1-or-later", "LGPL-2.1+": "LGPL-2.1-or-later"} | {x: x for x in ("BSD-2-Clause", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")}
    spdx |= {"MIT OR Apache-2.0": "MIT,Apache-2.0", "(MIT AND (ISC OR BSD-3-Clause))": "MIT,BSD-3-Clause,ISC", "GPL-2.0-or-later WITH Classpath-exception-2.0": "GPL-2.0-or-later", "MIT": "MIT", "Unknown-1.0": "", "MIT */": "MIT"}
    want = [(APACHE, "Apache-2.0"), ("".join(f" * {x}\n" for x in APACHE.splitlines()), "Apache-2.0"), (MPL, "MPL-2.0")]
    want += [(f"// SPDX-License-Identifier: {k}\ncode", v) for k, v in spdx.items()]
    got = licenses.licences(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")).collect()
    assert [r["licences"] for r in sorted(got)] == [v for _, v in want]


BSD = """Copyright (c) 2024, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GNU = """This {work} is free software{semi} you can redistribute it and/or
modify it under the terms of the GNU {kind} as published by the Free Software Foundation{comma} either
version {version} of the License, or (at your option) any later version.

This {work} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
{kind} for more details.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""


def gnu(kind, version, work="program", comma=";"):
    return GNU.format(kind=kind, version=version, work=work, comma=comma, semi=";")


def published():
    """(text, its one licence)."""
    general, lesser = "General Public License", "Lesser General Public License"
    return [
        (MIT, "MIT"),
        (APACHE, "Apache-2.0"),
        (MPL, "MPL-2.0"),
        (ISC, "ISC"),
        (BSD.format(""), "BSD-2-Clause"),
        (BSD.format(ENDORSE), "BSD-3-Clause"),
        (gnu(general, "2"), "GPL-2.0-or-later"),
        (gnu(general, "3", comma=","), "GPL-3.0-or-later"),
        (gnu(lesser, "2.1", "library"), "LGPL-2.1-or-later"),
        (gnu(lesser, "3", "library"), "LGPL-3.0-or-later"),
        (gnu(lesser, "3", comma=","), "LGPL-3.0-or-later"),
        (gnu(lesser, "2", "library"), "LGPL-2.0-or-later"),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it.\n", "Unlicense"),
    ]


def test_every_published_text_gives_its_licence_alone(spark):
    texts = published()
    twice = [(BSD.format(ENDORSE) * 2, "BSD-3-Clause"), (BSD.format(ENDORSE) + BSD.format(""), "BSD-3-Clause,BSD-2-Clause"), (MIT + "\n" + ISC, "MIT,ISC")]
    rows = list(enumerate(texts + twice))
    docs = spark.createDataFrame([(i, t) for i, (t, _) in rows], "doc_id long, text string")
    got = licenses.licences(docs).collect()
    assert {r["doc_id"]: r["licences"] for r in got} == {i: v for i, (_, v) in rows}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in rows] + [(90, "x SPDX-License-Identifier: MIT OR (ISC AND GPL-2.0+)\n"), (91, None)])
    theirs = {r[0]: r[1:] for r in con.execute(licenses.oracle()).fetchall()}
    assert {r["doc_id"]: (r["n_known"], r["sentences"], r["licences"]) for r in got} == {i: theirs[i] for i, _ in rows}
    assert theirs[90][2] == "MIT,GPL-2.0-or-later,ISC" and theirs[91] == (0, "", "")


LONG_RUNS = [unit * (1_000_000 // len(unit)) for unit in (".", "eyJ", "a", "漢", "\n", "gpl-2.", "password", "-----BEGIN ", "; ", "SPDX-License-Identifier: MIT OR ")]


def test_long_runs_are_read_once(spark):
    scan = secrets.scanner()
    for text in LONG_RUNS:
        began = time.process_time()
        scan.spans(text)
        assert time.process_time() - began < 2, text[:20]
    for i, text in enumerate(LONG_RUNS):
        docs = spark.createDataFrame([(i, "licens " + text)], "doc_id long, text string")
        began = time.time()
        assert licenses.licences(docs).count() == len(licenses.licences(docs).collect()) == 1
        assert time.time() - began < 12, text[:20]  # two jobs, with their start


def test_hits_in_a_run_that_fails_are_left_out_rightly():
    rnd, kind = random.Random(8), next(k for k in secrets.KINDS if k.name == "jwt")
    scan, plain = secrets.Scanner((secrets.Kind("jwt", kind.keywords, kind.pattern, lambda m: True, kind.run),)), re.compile(kind.pattern)
    for _ in range(3000):
        text = "".join(rnd.choice(["eyJ", "eyJ", ".", "a", "eyJa.eyJb.", "..", " ", "-"]) for _ in range(rnd.randint(1, 14)))
        assert [(a, b) for a, _, b in scan.spans(text)] == [m.span() for m in plain.finditer(text)], text


def test_every_rule_has_an_anchor_and_no_python():
    for _, sequence in licenses.RULES:
        assert any(a in licenses.SENTENCES[s].lower() for s in sequence for a in licenses.ANCHORS)


def test_native_plans_have_no_python_and_licences_no_exchange(spark, capsys):
    licenses.licences(given(spark)).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan
    for df in (decontaminate.contamination(given(spark), spark.read.parquet(f"{SF}/benchmark.parquet")), shards.byte_shards(given(spark))):
        df.explain()
        plan += capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# decontamination


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for k, item in items:
            v = plain_words(item)
            for s in range(max(1, len(v) - 9) if v else 0):
                win = v[s : s + 10]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        found.add(str(k))
        out.append((i, len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Text of some WORDS"), (3, ""), (4, None), (5, "same"), (6, "never seen phrase"), (6, "of some")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 2])
def test_contamination_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    df = odd(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "'x' as win", "1 as term")
    got = decontaminate.contamination(df, items).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert bag((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got) == bag(plain_hits(rows, ITEMS))
    clean = decontaminate.clean_documents(df, items)
    assert clean.columns == df.columns
    want = [r for r, h in zip(rows, plain_hits(rows, ITEMS), strict=True) if h[2] == 0]
    assert bag((r["doc_id"], r["text"]) for r in clean.collect()) == bag(want)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 2])
def test_rows_keep_their_numbers_when_a_later_scan_splits_the_files_otherwise(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (block,))
    leak = "a b c d e f g h i j k l m n"
    docs = in_files(spark, tmp_path, [(i, f"{i} {leak}" if i % 3 == 0 else f"{i} others") for i in range(60)])
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    with resplit(spark, monkeypatch, decontaminate, "training-postings"):
        assert bag(r["doc_id"] for r in decontaminate.clean_documents(docs, items).collect()) == bag(i for i in range(60) if i % 3)
    with resplit(spark, monkeypatch, decontaminate, "training-postings"):
        got = decontaminate.contamination(docs, items).collect()
        assert bag((r["doc_id"], r["n_hit"]) for r in got) == bag((i, 14 if i % 3 == 0 else 0) for i in range(60))


def test_contamination_without_rows(spark):
    none, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r["n_hit"] for r in decontaminate.contamination(odd(spark), none).collect()} == {0}
    assert decontaminate.contamination(empty(spark), items).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha gamma beta delta"), (2, "alpha beta gamma delta"), (3, "alpha x x x beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {(r["doc_id"], r["exact"]) for r in decontaminate.matches(docs, items, slop=1).filter("start is not null").collect()}
    assert got == {(1, False), (2, True)}


# shards


def test_shards_of_odd_rows(spark):
    got = shards.byte_shards(odd(spark), 4).collect()
    assert len(got) == 12 and shards.byte_shards(empty(spark)).collect() == []
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= {0, 1, 2, 3}
    assert sum(r["size"] for r in got) == sum(len((r["text"] or "").encode()) + 1 for r in odd(spark).collect())


def test_shards_are_balanced_and_contiguous(spark):
    got = sorted((r["doc_id"], r["shard"], r["size"]) for r in shards.byte_shards(given(spark, "sf0.01")).collect())
    assert [s for _, s, _ in got] == sorted(s for _, s, _ in got)
    sizes = collections.Counter()
    for _, s, n in got:
        sizes[s] += n
    mean, largest = sum(sizes.values()) / 16, max(n for *_, n in got)
    assert len(sizes) == 16 and all(abs(n - mean) <= largest for n in sizes.values())


def test_one_key_with_a_third_of_the_rows_is_split(spark):
    rows = [(7, "same")] * 3000 + [(i, f"t{i}") for i in range(6000)]
    placed = shards.byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert collections.Counter((r["shard"]) for r in placed if r["doc_id"] == 7).most_common(1)[0][1] < 3001 and len(placed) == 9000


# quality


def plain_features(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    often = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dups = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(often)


def test_features_are_the_plain_ones(spark):
    rnd = random.Random(3)
    parts = ["a", "b", "c", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "#", "|", "é", "a b c a b c", "\n\n", "x y\nx y"]
    for text in [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(5000)), *[r["text"] for r in given(spark).collect()]]:
        assert quality.text_features(text)[:5] == plain_features(text), repr(text)


def test_votes_find_good_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in quality.quality_scores(given(spark, "sf0.01")).collect() if labels.get(r["doc_id"]) is not None and not r["base_failed"]]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.35 * len(bad)


def test_em_is_that_of_single_documents():
    """Weights from counted patterns equal those from the documents one by one."""
    rnd = random.Random(5)
    rows = [[rnd.choice((-1, 0, 1, 1)) for _ in range(3)] for _ in range(300)]
    one = quality.fit_votes([(v, 1) for v in rows], 3)
    counted = quality.fit_votes([(list(v), n) for v, n in collections.Counter(map(tuple, rows)).items()], 3)
    assert one.prior == pytest.approx(counted.prior) and one.for_bad == pytest.approx(counted.for_bad) and one.for_good == pytest.approx(counted.for_good)


def test_posterior_columns_are_the_models(spark):
    model = quality.VoteModel(0.3, tuple(0.1 * i for i in range(len(quality.RULES))), tuple(-0.2 * i for i in range(len(quality.RULES))))
    feats = quality.features(given(spark))
    rows = feats.select(*[quality.vote(r).alias(f"v{i}") for i, r in enumerate(quality.RULES)], quality.log_odds(model).alias("odds")).collect()
    for r in rows:
        assert r["odds"] == pytest.approx(model.log_odds(list(r)[:-1]))


def test_quality_of_odd_rows(spark):
    df = odd(spark)
    assert quality.quality_scores(df).count() == 12 and quality.quality_scores(empty(spark)).collect() == []
    kept = quality.good_documents(given(spark))
    assert bag(r["doc_id"] for r in kept.collect()) == bag(r["doc_id"] for r in quality.quality_scores(given(spark)).filter("kept").collect())
    assert quality.good_documents(df).columns == df.columns
