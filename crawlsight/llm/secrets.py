"""Secrets in texts: one keyword automaton, anchored regular expressions at its hits, checksums inside the matches.

An Aho-Corasick automaton over all keywords reads each text once. A kind's regular expression is only ever anchored at
a hit of one of its keywords. Kinds whose secrets carry a checksum (or another part that can be verified) keep a match
only if it holds.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from crawlsight.llm.common import in_arrow

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def any_case(word: str) -> Iterator[str]:
    """Every spelling of ``word`` in small and capital ASCII letters."""
    return map("".join, itertools.product(*[(c, c.upper()) if c.isalpha() else (c,) for c in word]))


def crc_base62(token: str, head: int, tail: int = 6) -> bool:
    """The last ``tail`` characters are the CRC-32 of what stands between ``head`` and them, in base 62."""
    body, check = token[head:-tail], token[-tail:]
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(tail):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == check


def jwt_header(token: str) -> bool:
    """The first part decodes to a JSON object that names an algorithm."""
    head = token.split(".", 1)[0]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, binascii.Error):
        return False
    return isinstance(value, dict) and "alg" in value


def luhn(token: str) -> bool:
    digits = [int(c) for c in token if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def der_block(token: str) -> bool:
    """A PEM block whose base64 body is a DER sequence of the length that its header states."""
    body = "".join(token.split("-----")[2].split())
    try:
        raw = base64.b64decode(body, validate=True)
    except binascii.Error:
        return False
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


@dataclass(frozen=True)
class Kind:
    """``keywords`` stand where a match starts; ``holds`` decides on a match; a failed one still takes its characters.

    Where there is no match, all of ``run`` from there on would fail in the same way and is left out, so that a long run
    of keywords is read once.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: str
    holds: Callable[[re.Match], bool]
    run: str | None = None


ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
BASE = (
    Kind(
        "assign",
        tuple(v for w in ASSIGN_WORDS for v in any_case(w)),
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda m: m.end(2) - m.start(2) >= 12,
    ),
    Kind("access", ("AKIA",), r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    # 16 hexadecimal digits in a row start with four of them
    Kind("hex", tuple(map("".join, itertools.product("0123456789abcdef", repeat=4))), r"[0-9a-f]+", lambda m: m.end() - m.start() >= 16),
)
CHECKED = (
    Kind("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc_base62(m[0], 4)),
    Kind("npm", ("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", lambda m: crc_base62(m[0], 4)),
    Kind("jwt", ("eyJ",), r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", lambda m: jwt_header(m[0]), "[A-Za-z0-9_-]+"),
    Kind("pem", ("-----BEGIN ",), r"-----BEGIN (?:RSA |EC |DSA |ENCRYPTED )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:RSA |EC |DSA |ENCRYPTED )?PRIVATE KEY-----", lambda m: der_block(m[0])),
    Kind("card", ("card=", "card:", "card number"), r"card(?: number)?[:=]?\x20*[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", lambda m: luhn(m[0])),
)
KINDS = BASE + CHECKED


class Scanner:
    """The automaton of ``kinds``, compiled once in a process."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.patterns = [re.compile(k.pattern) for k in kinds]
        self.runs = [k.run and re.compile(k.run) for k in kinds]
        owners: dict[str, list[int]] = {}
        for i, kind in enumerate(kinds):
            for word in kind.keywords:
                owners.setdefault(word, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for word, own in owners.items():
            self.automaton.add_word(word, (len(word), tuple(own)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of all secrets in code points, sorted; per kind leftmost and non-overlapping.

        The automaton gives hits by their ends; a kind's hits are tried in the order of their starts.
        """
        starts: list[list[int]] = [[] for _ in self.kinds]
        for end, (length, own) in self.automaton.iter(text):
            for i in own:
                starts[i].append(end - length + 1)
        out = []
        for i, at in enumerate(starts):
            free, match, holds, run = 0, self.patterns[i].match, self.kinds[i].holds, self.runs[i]
            for start in sorted(at):
                if start < free:
                    continue
                if m := match(text, start):
                    free = m.end()
                    if holds(m):
                        out.append((start, i, free))
                elif run and (m := run.match(text, start)):
                    free = m.end()
        return sorted(out)


_scanners: dict[tuple[str, ...], Scanner] = {}


def scanner(kinds: tuple[Kind, ...] = KINDS) -> Scanner:
    names = tuple(k.name for k in kinds)
    if names not in _scanners:
        _scanners[names] = Scanner(kinds)
    return _scanners[names]


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, found (array of kind, start, end, value).

    Spans are code points, end exclusive, ordered by start and kind. A null or empty text has none. Spans of different
    kinds may overlap. Rows are independent: repeated rows, ties and null ids need no rule, other columns are ignored.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def of(batch: pa.RecordBatch) -> dict:
        scan = scanner()
        found = []
        for text in batch.column("text").to_pylist():
            found.append([{"kind": KINDS[i].name, "start": s, "end": e, "value": text[s:e]} for s, i, e in scan.spans(text or "")])
        return {"doc_id": batch.column("doc_id"), "found": pa.array(found, pa.list_(span))}

    return in_arrow(docs.select("doc_id", "text"), of, f"doc_id {id_kind}, found array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def without(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every stretch that spans cover replaced once."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; where there is a column n_chars it is the new length.

    Null and empty texts stay as they are, a null n_chars stays null, and every row stays, repeated or not.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner()
        for batch in batches:
            texts = [t and without(t, scan.spans(t)) for t in batch.column(names.index("text")).to_pylist()]
            at = names.index("text")
            batch = batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))
            if "n_chars" in names:
                k = names.index("n_chars")
                old = batch.column(k).to_pylist()
                new = [len(t) if t is not None and o is not None else o for t, o in zip(texts, old, strict=True)]
                batch = batch.set_column(k, batch.schema.field(k).name, pa.array(new, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
