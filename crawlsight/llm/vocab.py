"""Token ids of whole texts, with the work per distinct piece instead of per occurrence.

Both vocabularies split a text before they merge, and no split depends on what stands across certain places. A text is
cut at those places, each distinct piece is encoded once and remembered, and a text's ids are its pieces' ids in a row.
Pieces of plain Latin letters are split here; all others go through the library's own normaliser and splitter, so ids
are the library's for every text (tests compare them on random Unicode).
"""

from __future__ import annotations

import os
import re
from array import array

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

from tokenizers import Tokenizer  # noqa: E402

#: Letters and digits of Latin-1, which no normal form changes.
L1 = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ"
N1 = "0-9²³¹¼-¾"
#: White space as Unicode has it. Python's split() takes U+001C to U+001F for white space too.
SPACE = "\t-\r \x85\xa0  -     　"
SEPARATORS = re.compile("[\x1c-\x1f]")
NOT_SPACES = re.compile(f"[^{SPACE}]+")
#: White space other than single spaces and line feeds between words.
UNEVEN = re.compile("[\t\x0b-\r\x85\xa0  -     　]")
LATIN1 = re.compile("[\x00-\xff]*").fullmatch
BETWEEN = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
#: Remembered pieces in a process; beyond it they are forgotten and encoded again. Bounds memory, not results.
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


def lettered(text: str) -> str:
    return text.encode().decode("latin-1").translate(BYTE_LETTERS)


class Words:
    """A vocabulary with word ends, lower case and no white space: pieces are what white space separates."""

    simple = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{L1}]+|[{N1}]|[^{SPACE}{L1}{N1}]+")
    #: What stands before every piece but a text's first.
    between = ""
    remembered = REMEMBERED

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")")

    def parts(self, piece: str) -> list[tuple[str, bool]]:
        """The stretches of a piece, and whether each is an added token."""
        return [(part, i % 2 == 1) for i, part in enumerate(self.added.split(piece)) if part]

    def pieces(self, text: str) -> list[str]:
        return NOT_SPACES.findall(text) if SEPARATORS.search(text) else text.split()

    def is_simple(self, piece: str) -> bool:
        return LATIN1(piece) is not None and "<|" not in piece

    def words(self, piece: str) -> list[str]:
        """What the splitter makes of a simple piece; added tokens start with <| and are never simple."""
        return self.simple.findall(piece.lower())


class Bytes:
    """A byte-level vocabulary that keeps white space: every piece but the first starts with the space before it."""

    between = " "
    remembered = 2 * REMEMBERED  # pieces are words with their line feeds, of which there are more

    simple = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{L1}]+| ?[{N1}]+| ?[^{SPACE}{L1}{N1}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

    def __init__(self, name: str):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))

    def pieces(self, text: str) -> list[str]:
        even = not ("  " in text or "\n " in text or " \n" in text or text[:1] == " " or text[-1:] == " " or UNEVEN.search(text))
        return text.split(" ") if even else BETWEEN.split(text)

    def is_simple(self, piece: str) -> bool:
        return LATIN1(piece) is not None and "<|" not in piece

    def words(self, piece: str) -> list[str]:
        return self.simple.findall(piece)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, remembered by piece and, below that, by word.

    What was not asked for since the memory last filled up is forgotten, so frequent pieces stay.
    """

    def __init__(self, split: Words | Bytes):
        self.split, self.model = split, split.tokenizer.model
        self.by_piece: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(lettered(word))]).tobytes()
        self.by_word[word] = ids
        return ids

    def ids(self, piece: str) -> bytes:
        if self.split.is_simple(piece):
            get = self.by_word.get
            return b"".join([get(w) or self.word(w) for w in self.split.words(piece)])
        return array("I", self.split.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        """Ids of a piece inside a text, remembered without what stands before it."""
        ids = self.older.get(piece) or self.ids(self.split.between + piece)
        self.by_piece[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null is empty."""
        if not text:
            return b""
        if len(self.by_piece) > self.split.remembered:
            self.older, self.by_piece = self.by_piece, {}
        if len(self.by_word) > REMEMBERED:
            self.by_word = {}
        get, new = self.by_piece.get, self.piece
        pieces = self.split.pieces(text)
        ids = [get(p) or new(p) for p in pieces]
        if self.split.between and pieces:
            ids[0] = self.ids(pieces[0])
        return b"".join(ids)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of a vocabulary file, one in each worker process."""
    if name not in _encoders:
        kind = Bytes if name.startswith("byte") else Words
        _encoders[name] = Encoder(kind(name))
    return _encoders[name]
