"""Operator 13 against a plain trie, and its parentheses against a stack."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from crawlsight.llm import queries, tries
from tests.llm.helpers import bag

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """The contract, conversation by conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append(((turn is not None, turn or 0), digest, role, text))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - c % 20, [])[:h] + t[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(ends[p])) for p, m in members.items()]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("seed", range(3))
def test_nodes_are_those_of_a_plain_trie(spark, seed):
    rnd = random.Random(seed)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a b", "c", "", None, "d e f"])) for c in range(0, 400) for t in range(rnd.choice([0, 1, 2, 3, 5, 8])) if rnd.random() < 0.9]
    assert bag(map(tuple, tries.prefix_trie(frame(spark, rows).repartition(5)).collect())) == bag(plain(rows))


def test_a_spines_members_are_hashed_chunk_by_chunk(monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 7)
    seq, ids = b"x" * 16, np.arange(3, 3000, 11)
    pieces = [b for b in tries.shard_nodes(4, [seq] * len(ids), np.ones(len(ids), int), ids, seq, None) if b.column("ids").null_count == 0]
    assert len(pieces) == -(-len(ids) // 7)
    (out,) = tries.hashed_ends(iter(pieces))
    assert out.column("sha").to_pylist() == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]


def test_one_hot_conversation_lies_in_many_shards(spark):
    rows = [(20 * c, t, "user", "same words") for c in range(300) for t in range(4)] + [(20 * c, 0, "user", f"own {c}") for c in range(300, 400)]
    rows += [(20 * c, t, "user", "same words" if t < 4 else f"on {c % 3}") for c in range(400, 500) for t in range(6)]
    assert bag(map(tuple, tries.prefix_trie(frame(spark, rows)).collect())) == bag(plain(rows))


def test_odd_turns(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "first"), (1, 3, None, None), (1, 3, None, None), (1, 2, "user", ""), (0, 5, "user", "head"), (-7, 1, "a", "b")]
    rows += [(2, 1, "user", "x"), (2, 1, "user", "y"), (40, 0, "r", "word " * 300_000), (3, 0, "", ""), (23, 0, "u", "turnless or not")]
    odd = frame(spark, rows)
    odd = odd.selectExpr("*", "1 AS shard", "2 AS kind", "3 AS seq", "4 AS base", "5 AS words")
    expected = plain([r for r in rows if r[0] is None or r[0] >= 0])
    got = [tuple(r) for r in tries.prefix_trie(odd.filter("conv_id >= 0 or conv_id is null")).collect()]
    assert bag(got) == bag(expected)
    assert tries.prefix_trie(odd).count() >= len(expected)
    assert tries.prefix_trie(odd.limit(0)).collect() == []


def test_a_deep_conversation(spark):
    rows = [(c, t, "user", str(t % 7)) for c in (0, 20, 40) for t in range(3000 + c)]
    got = {r["depth"]: r for r in tries.prefix_trie(frame(spark, rows)).collect()}
    assert len(got) == 3041 and got[3000]["n_convs"] == 3 and got[3001]["n_convs"] == 2 and got[0]["n_leaves"] == 1 and got[0]["saved_tokens"] == 6020


def test_find_close_is_that_of_a_stack():
    rnd = random.Random(5)
    for n in (1, 2, 31, 32, 33, 64, 500, 5000):
        for deep in (0.5, 0.7, 0.95):
            bits, depth, left = [], 0, n
            while left or depth:
                up = left and (depth == 0 or rnd.random() < deep)
                bits.append(1 if up else 0)
                depth += 1 if up else -1
                left -= bool(up)
            stack, close = [], {}
            for i, b in enumerate([1, *bits, 0]):
                if b:
                    stack.append(i)
                else:
                    close[stack.pop()] = i
            whole = np.array([1, *bits, 0], np.uint8)
            opens = np.flatnonzero(whole)
            assert tries.Parens(whole).find_close(opens).tolist() == [close[i] for i in opens.tolist()]


def test_query_covers_all_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert bag(map(tuple, queries.QUERIES["op13_prefix_trie"](spark, sf).collect())) == bag(plain(rows))
