"""Exact and fast encoding with a tokenizer file: pieces are remembered, the library encodes what is new.

A text is cut where the tokenizer itself always cuts. For the word-end BPE layout (NFC, blanks to one blank,
lower case; runs of letters, single digits, runs of other signs) a run of ASCII blanks always ends a piece, so
``encode(text)`` is the concatenation of its words' ids. Words of plain letters, digits and signs are cut into the
layout's pieces here, and the library's model encodes each new piece. Words with any other character, or with an
added token in them, go through the whole library call. Files of another layout are encoded by the library text by
text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

# Pieces (and odd words) remembered per Python worker, in two halves: when the newer half is full, it becomes the
# older one, and what is met again moves to the newer half. Rare pieces leave, frequent ones stay.
MEMORY = 900_000
LONGEST_REMEMBERED = 64

# The layout's normaliser and piece pattern, as its files hold them.
LAYOUT_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
LAYOUT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

# Letters whose lower case, class and composed form are beyond doubt: ASCII and Latin-1 without its odd signs.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\x09-\\x0d\\x20{_LETTERS}0-9]+")
# A text without runs of signs and without apostrophes is cut by setting its signs and digits apart. As Latin-1 bytes: what
# is no sign, letters and blanks, and a table that turns every sign into "!" and all else into a blank.
_NO_SIGN = bytes(c for c in range(256) if re.match(f"[\\x09-\\x0d\\x20{_LETTERS}0-9]", chr(c)))
_QUIET = bytes(c for c in _NO_SIGN if not chr(c).isdigit())
_SIGNS = bytes(32 if c in _NO_SIGN else 33 for c in range(256))
_WORDS = re.compile("[^\\x20\\x09-\\x0d]+")


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if visible, else 256 and up."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(visible)]
    table = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def _pieces_of(text: str) -> list[str]:
    """The layout's pieces of a plain text in lower case."""
    try:
        codes = text.encode("latin-1")
    except UnicodeEncodeError:
        return _PIECES.findall(text)
    if b"'" in codes or b"!!" in codes.translate(_SIGNS):
        return _PIECES.findall(text)
    for sign in map(chr, set(codes.translate(None, _QUIET))):
        text = text.replace(sign, f" {sign} ")
    return text.split()


class _Remembered(dict):
    """What ``make`` gave for a key, up to ``memory`` keys; the dict itself is the newer half."""

    def __init__(self, make, memory: int):
        super().__init__()
        self.make, self.half = make, memory // 2
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers, special tokens not added."""

    def __init__(self, text: str, memory: int | None = None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        layout = json.loads(text)
        splits = (layout.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.fast = (
            layout.get("normalizer") == LAYOUT_NORMALIZER
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
            and splits[0].get("pattern") == {"Regex": LAYOUT_PATTERN}
            and (splits[0].get("behavior"), splits[0].get("invert")) == ("Removed", True)
            and not splits[1].get("add_prefix_space") and not splits[1].get("use_regex")
            and layout.get("post_processor") is None
        )
        self.added = [t["content"] for t in layout.get("added_tokens", [])]
        if any(_WORDS.fullmatch(t) is None for t in self.added):
            self.fast = False
        self._letters = _byte_letters()
        self._pieces = _Remembered(self._by_model, memory or MEMORY)
        self._words = _Remembered(self._by_library, memory or MEMORY)

    def _by_model(self, piece: str) -> bytes:
        # visible ASCII characters stand for themselves
        word = piece if piece.isascii() else "".join([self._letters[b] for b in piece.encode()])
        return np.array([t.id for t in self.library.model.tokenize(word)], "<u4").tobytes()

    def _by_library(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def forget(self) -> None:
        """Drop what is remembered: ids come out alike, pieces are encoded anew."""
        for remembered in (self._pieces, self._words):
            remembered.clear()
            remembered.older = {}

    def _plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.added)

    def encode(self, text: str) -> bytes:
        if not self.fast:
            return self._by_library(text)
        pieces = self._pieces
        if self._plain(text):
            return b"".join(map(pieces.__getitem__, _pieces_of(text.lower())))
        return b"".join(
            b"".join(map(pieces.__getitem__, _PIECES.findall(w.lower()))) if self._plain(w) else self._words[w]
            for w in _WORDS.findall(text)
        )


_encoders: dict[str, Encoder] = {}


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text for the executors, read once on the driver (a vocabulary: a few MB)."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(text: str, memory: int | None = None) -> Encoder:
    """This process' encoder for a tokenizer text, with what it remembers (up to ``memory`` pieces)."""
    key = f"{hashlib.sha256(text.encode()).hexdigest()} {memory}"
    if key not in _encoders:
        _encoders[key] = Encoder(text, memory)
    return _encoders[key]


def _give_back() -> None:
    for own in _encoders.values():
        own.forget()
    pa.default_memory_pool().release_unused()


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A task that gives memory back at its end: what its encoders remember and what Arrow keeps of its batches. Workers outlive
    tasks, and those that wait, or do something else next, would hold it beside those that encode."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            _give_back()

    return run
