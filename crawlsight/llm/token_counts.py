"""Token counts without token ids: the tokenizer as a finite-state transducer, texts as chunks whose maps compose.

A word's byte pairs are merged by a deterministic transducer. Its state after a prefix holds what later symbols can
still change: the longest end of the prefix with which some token begins, the last token of the best split at every
place in it, and how many tokens each of those splits has more or less than the whole prefix. A transition is annotated
with the tokens it emits, which is negative where symbols fuse into one token. States are built when they are first
reached and their number is bounded, as in a lazily determinised automaton.

White space brings every state back to the start. So a chunk's map from the entering state to the leaving state is known
from three things: the characters before its first white space (``head``), the tokens emitted between its first and its
last (``count``), and the characters after the last (``tail``, which name the state it leaves). Maps of neighbouring
chunks compose associatively, so a long text's chunks may be counted anywhere, in any order, and be joined by a scan.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.vocab import REMEMBERED, Words, lettered

CHUNK = 1 << 16
STATES = 200_000
#: Shifts a letter to its form at the end of a word.
AT_END = 0x1000
WORD_END = "</w>"


def symbols(token: str) -> str:
    """A token of the vocabulary as symbols: the last letter before the word-end mark in its end form."""
    return token[: -len(WORD_END) - 1] + chr(ord(token[-len(WORD_END) - 1]) + AT_END) if token.endswith(WORD_END) else token


class State:
    __slots__ = ("counts", "lasts", "next", "suffix")

    def __init__(self, suffix: str, lasts: tuple[str | None, ...], counts: tuple[int, ...]):
        self.suffix, self.lasts, self.counts = suffix, lasts, counts
        self.next: dict[str, tuple[State, int]] = {}  # symbol -> (state, tokens emitted)


class Transducer:
    """Counts the tokens that byte-pair merges make of one word."""

    def __init__(self, model: dict):
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.ranks = {(symbols(a), symbols(b)): i for i, (a, b) in enumerate(pairs)}
        self.tokens = {symbols(t) for t in model["vocab"]}
        self.begins = {t[:i] for t in self.tokens for i in range(len(t))}
        self.fits: dict[tuple[str, str], bool] = {}
        self.resets = 0
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("", (None,), (0,))

    def state(self, suffix: str, lasts: tuple[str | None, ...], counts: tuple[int, ...]) -> State:
        key = (suffix, lasts, counts)
        if key not in self.states:
            self.states[key] = State(*key)
        return self.states[key]

    def merged(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        """Two tokens in a row are what merging makes of their letters."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) > 4 * STATES:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def step(self, at: State, symbol: str) -> tuple[State, int]:
        """The split of a prefix ends in the one token that stays apart from the split before it."""
        text = at.suffix + symbol
        for begin in range(len(text)):
            token, before = text[begin:], at.lasts[begin]
            if token in self.tokens and (before is None or self.stay_apart(before, token)):
                break
        emitted = at.counts[begin] + 1
        keep = next(i for i in range(len(text) + 1) if text[i:] in self.begins)
        lasts = (*at.lasts, token)[keep:]
        counts = (*[c - emitted for c in at.counts], 0)[keep:]
        at.next[symbol] = found = (self.state(text[keep:], lasts, counts), emitted)
        return found

    def count(self, word: str) -> int:
        """Tokens of a word in the byte-level alphabet."""
        if len(self.states) > STATES:
            self.resets += 1
            self.reset()
        at, total = self.start, 0
        for symbol in word[:-1]:
            at, emitted = at.next.get(symbol) or self.step(at, symbol)
            total += emitted
        symbol = chr(ord(word[-1]) + AT_END)
        return total + (at.next.get(symbol) or self.step(at, symbol))[1]


class ChunkMap(NamedTuple):
    """What a chunk does to the transducer. ``whole``: it holds no white space and is all head."""

    head: str
    count: int
    tail: str
    whole: bool


class Counter:
    """Counts tokens of pieces without white space, and makes and composes maps of chunks."""

    def __init__(self, name: str):
        self.split = Words(name)
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            self.transducer = Transducer(json.load(f)["model"])
        self.by_piece: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self.by_word: dict[str, int] = {}

    def word(self, word: str) -> int:
        if len(self.by_word) > REMEMBERED:
            self.by_word.clear()
        n = self.by_word[word] = self.transducer.count(lettered(word))
        return n

    def piece(self, piece: str) -> int:
        n = self.older.get(piece)
        if n is None:
            if self.split.is_simple(piece):
                get = self.by_word.get
                n = sum([get(w) or self.word(w) for w in self.split.words(piece)])
            else:
                n = sum(1 if added else self.library_words(part) for part, added in self.split.parts(piece))
        if len(self.by_piece) > REMEMBERED:
            self.older, self.by_piece = self.by_piece, {}
        self.by_piece[piece] = n
        return n

    def library_words(self, part: str) -> int:
        """Words as the library's normaliser and splitter make them, in the byte-level alphabet."""
        tokenizer = self.split.tokenizer
        return sum(self.transducer.count(w) for w, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(part)))

    def chunk(self, text: str) -> ChunkMap:
        pieces = self.split.pieces(text)
        if len(pieces) == 1 and len(pieces[0]) == len(text):
            return ChunkMap(text, 0, "", True)
        first = 1 if pieces and text.startswith(pieces[0]) else 0
        last = len(pieces) - 1 if pieces and text.endswith(pieces[-1]) else len(pieces)
        get, new = self.by_piece.get, self.piece
        count = sum([get(p) or new(p) for p in pieces[first:last]])
        return ChunkMap("".join(pieces[:first]), count, "".join(pieces[last:]), False)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.whole:
            return ChunkMap(a.head + b.head, b.count, b.tail, b.whole)
        if b.whole:
            return a._replace(tail=a.tail + b.head)
        return ChunkMap(a.head, a.count + self.piece(a.tail + b.head) + b.count, b.tail, False)

    def total(self, maps: list[ChunkMap]) -> int:
        """The tokens of a text from its chunks' maps, neighbours composed pair by pair until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        if not maps:
            return 0
        return self.piece(maps[0].head) + maps[0].count + self.piece(maps[0].tail)


_counters: dict[str, Counter] = {}


def counter(name: str) -> Counter:
    if name not in _counters:
        _counters[name] = Counter(name)
    return _counters[name]


def chunk_maps(docs: DataFrame, vocabulary: str, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of every text: row (of the input), doc_id, chunk, n_bytes and the map. Empty texts have one."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row, count = TaskContext.get().partitionId() << 33, 0, counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out, of = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    text = text or ""
                    for k, begin in enumerate(range(0, max(1, len(text)), chunk)):
                        part = text[begin : begin + chunk]
                        out.append((own + row, k, len(part.encode("utf-8", "surrogatepass")), *(count.chunk(part) if part else ("", 0, "", False))))
                        of.append(i)
                    row += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_())
                names = ("row", "chunk", "n_bytes", "head", "count", "tail", "whole")
                columns = {n: pa.array([x[j] for x in out], t) for j, (n, t) in enumerate(zip(names, kinds, strict=True))}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(of, pa.int64()))} | columns)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, row long, chunk int, n_bytes long, head string, count long, tail string, whole boolean")


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", chunk: int = CHUNK, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    A null text is empty and has no tokens. Added tokens written in a text count as one each, as the library has it.
    Repeated rows and null ids are counted row by row; other columns are ignored. Only maps are shuffled, never texts;
    a text's maps meet in one task, one for every ``chunk`` of its characters.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    maps = chunk_maps(docs, vocabulary, chunk)
    chunks = F.sort_array(F.collect_list(F.struct("chunk", "head", "count", "tail", "whole"))).alias("chunks")
    grouped = maps.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), chunks)

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            sums = [count.total([ChunkMap(m["head"], m["count"], m["tail"], m["whole"]) for m in ms]) for ms in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": pa.array(sums, pa.int64())})

    counted = grouped.select("doc_id", "n_bytes", "chunks").mapInArrow(totals, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
