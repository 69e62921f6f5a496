"""Byte-level BPE counts and ids, equal to those of the tokenizers library.

The library encodes a text pre-token by pre-token, so ids of pre-tokens may be
remembered and joined. Texts of characters whose class is beyond doubt are cut
into pre-tokens by the pattern here. Others are cut before each blank that comes
before a non-blank (one always starts a pre-token), and the library encodes the
pieces. Special strings are cut out first, as the library does. What is
remembered is bounded.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable
from itertools import chain

#: Pre-tokens that a worker process remembers.
REMEMBERED = 1_000_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: A character that is no known letter, ASCII digit, white space or sign.
_UNKNOWN = re.compile(rf"[^\t-\r\x20-\x7e\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf×÷‐-‧‰-⁞€{_LETTERS}]")
_PRETOKEN = re.compile(rf" ?[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf" ?[{_LETTERS}]+")
_CUT = re.compile(r" (?=[^\s\x1c-\x1f])")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(extra)
            extra += 1
    return letters


LETTERS = _byte_letters()
_TABLE = {b: LETTERS[b] for b in range(256)}


def byte_level(text: str) -> str:
    """A word, perhaps after a blank, in a byte-level vocabulary's letters."""
    raw = text.encode("utf-8").decode("latin-1")
    return "Ġ" + raw[1:] if raw[0] == " " and raw[1:].isascii() else raw.translate(_TABLE)


class Remembered(dict):
    """What make() gives for a key, in two generations: a full younger one replaces the older."""

    def __init__(self, make: Callable[[str], object], entries: int) -> None:
        super().__init__()
        self.make, self.entries, self.older = make, entries // 2, {}

    def __missing__(self, key: str) -> object:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteTokens:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        #: Fragment of a text (a pre-token, or several) to little-endian ids.
        self.known = Remembered(self._encode, REMEMBERED)

    def _encode(self, fragment: str) -> bytes:
        if _PLAIN.fullmatch(fragment):  # one pre-token: the model alone does
            return array("I", [t.id for t in self.model.tokenize(byte_level(fragment))]).tobytes()
        return self._library(fragment)

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> list[bytes]:
        if _UNKNOWN.search(text) is None:
            return list(map(self.known.__getitem__, _PRETOKEN.findall(text)))
        first, *later = _CUT.split(text)
        return [self.known[first], *(self.known[" " + x] for x in later)]

    def parts(self, text: str) -> list[bytes]:
        if not text:
            return []
        if self.special is None or not any(x in text for x in self.added):
            return self._plain(text)
        cut = self.special.split(text)
        return list(chain.from_iterable([array("I", [self.added[x]]).tobytes()] if x in self.added else self._plain(x) for x in cut if x))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(self.parts(text or ""))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text or ""))) // 4


_open: dict[str, ByteTokens] = {}


def tokens(path: str) -> ByteTokens:
    """One encoder for each worker process and file."""
    if path not in _open:
        _open[path] = ByteTokens(path)
    return _open[path]


def counter(path: str) -> Callable[[str | None], int]:
    return tokens(path).count
