"""Operators 1, 2 and 4 against the tokenizers library on whole texts."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from crawlsight.llm import packing, token_counts, token_files
from crawlsight.llm.common import scratch
from crawlsight.llm.vocab import encoder
from tests.llm.helpers import ODD, bag, empty, given, odd

LETTERS = ["a", "E", "É", "ß", "'", "'s", "'ll", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "1", "²", "٣", "我们", "ا", "́", "İ", "Σ", "ﬁ", "<|endoftext|>", "<|", ".", "!", "🙂", "\xad", "_", "​", "　", "が", "̣", "ſ", "\x00", "the", "ing", "aaaa"]


def library(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def texts(n):
    rnd = random.Random(n)
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 20))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_those_of_the_library(name):
    ids = library(name)
    for text in texts(8000):
        assert encoder(name).encode(text) == array("I", ids(text)).tobytes(), repr(text)


def test_chunk_maps_compose_to_the_librarys_count():
    ids, count, rnd = library("word_bpe_49k.json"), token_counts.counter("word_bpe_49k.json"), random.Random(0)
    for text in texts(8000):
        size = rnd.choice([1, 2, 3, 7, 100])
        maps = [count.chunk(text[a : a + size]) for a in range(0, len(text), size)]
        assert count.total(maps) == len(ids(text)), repr(text)


def test_composition_is_associative():
    count = token_counts.counter("word_bpe_49k.json")
    a, b, c = (count.chunk(x) for x in ("uncommon wo", "nderf", "ul things"))
    assert count.compose(count.compose(a, b), c) == count.compose(a, count.compose(b, c))


def test_states_are_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 50)
    count, ids = token_counts.Counter("word_bpe_49k.json"), library("word_bpe_49k.json")
    for text in ("hello wonderful world", "anticonstitutionnellement", "zzz"):
        assert count.total([count.chunk(text)]) == len(ids(text))


def test_token_counts(spark):
    ids = library("word_bpe_49k.json")
    for df in (given(spark), odd(spark)):
        want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(ids(r["text"])), n > 2048) for r in df.collect()]
        assert bag(tuple(r) for r in token_counts.token_counts(df, chunk=5000).collect()) == bag(want)
    assert token_counts.token_counts(empty(spark)).collect() == []


def test_token_files(spark):
    ids = library("word_bpe_49k.json")
    for df in (given(spark), odd(spark)):
        path = scratch(spark, "test-tokens")
        token_files.write_tokens(df, path)
        tokens = token_files.read_tokens(spark, path)
        got = token_files.token_index(tokens).collect()
        want = [(r["doc_id"], len(i := [*ids(r["text"]), 2]), crc(i)) for r in df.collect()]
        assert bag((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == bag(want)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
        rows = [r["doc_id"] for r in tokens.orderBy("part", "at").select("doc_id").collect()]
        assert rows == in_order
        assert [r["doc_id"] for r in tokens.filter("doc_id = 7").collect()] == [7]
    path = scratch(spark, "test-tokens")
    token_files.write_tokens(empty(spark), path)
    assert token_files.token_index(token_files.read_tokens(spark, path, tokens.schema)).collect() == []


def test_readers_of_some_documents_skip_by_metadata(spark, capsys):
    path = scratch(spark, "test-tokens")
    token_files.write_tokens(given(spark), path)
    token_files.read_tokens(spark, path).filter("doc_id = 17").explain("formatted")
    assert "EqualTo(doc_id,17)" in capsys.readouterr().out


def test_plan_places_every_length_once():
    rnd = random.Random(0)
    for gen in (lambda: rnd.randint(1, 1024), lambda: rnd.randint(300, 700), lambda: 1, lambda: 1024, lambda: rnd.choice([513, 511, 256, 128])):
        counts = Counter(gen() for _ in range(3000))
        patterns = packing.plan(dict(counts))
        placed = Counter()
        for lengths, n in patterns:
            assert n > 0 and sum(lengths) <= 1024
            for x in lengths:
                placed[x] += n
        assert placed == counts
    assert packing.plan({}) == []


def test_exact_complements_come_first():
    assert packing.plan({1000: 2, 24: 2}) == [((1000, 24), 2)]
    assert packing.plan({1000: 1, 14: 1, 10: 1}) == [((1000, 14, 10), 1)]
    assert packing.plan({1000: 1, 14: 1, 6: 1, 4: 1}) == [((1000, 14, 6, 4), 1)]
    assert packing.plan({512: 3}) == [((512, 512), 1), ((512,), 1)]


def test_packing(spark):
    ids = library("byte_bpe_50k.json")
    for df, slack in ((given(spark), 1.1), (odd(spark), 1.2)):
        rows = [(r["doc_id"], [*ids(r["text"]), 2]) for r in df.collect()]
        got = packing.packed(df).collect()
        pieces = defaultdict(list)
        for i, own in rows:
            first = len(own) % 1024 or min(1024, len(own))
            cuts = [0, *range(first, len(own) + 1, 1024)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                pieces[i, k, a, b - a, crc(own[a:b])].append(1)
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == Counter({k: len(v) for k, v in pieces.items()})
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in sequences.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 1024
        assert len(sequences) <= slack * -(-sum(len(own) for _, own in rows) // 1024) + 1
    assert packing.packed(empty(spark)).collect() == []


def test_odd_rows_are_all_there():
    assert len(ODD) == 12


def test_never_more_sequences_than_best_fit_alone():
    rnd = random.Random(6)
    for _ in range(25):
        top = rnd.choice([64, 300, 1024])
        counts = Counter(min(1024, max(1, int(rnd.lognormvariate(4, 1.3)) if rnd.random() < 0.7 else rnd.randint(1, top))) for _ in range(rnd.randint(1, 3000)))
        patterns = packing.plan(dict(counts))
        placed = Counter()
        for lengths, n in patterns:
            assert sum(lengths) <= 1024
            for x in lengths:
                placed[x] += n
        assert placed == counts
        n_best = sum(n for _, n in packing.best_fit(dict(counts), 1024))
        assert -(-sum(x * n for x, n in counts.items()) // 1024) <= sum(n for _, n in patterns) <= n_best


def test_the_given_documents_fill_their_sequences(spark):
    rows = packing.packed(given(spark, "sf0.01")).groupBy("sequence_id").sum("length").collect()
    total = sum(r[1] for r in rows)
    assert len(rows) <= 966 and -(-total // 1024) == 962
