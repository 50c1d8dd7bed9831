"""Whole texts to token ids with the `tokenizers` library, fast on text that repeats its words.

Both vocabularies cut a text at white space before merging bytes. A text is therefore split before
each single space or line feed and every distinct piece is encoded once per process; a text's ids
are its pieces' ids joined. Texts in which the split could move a token boundary (runs of white
space, other white-space characters) are encoded whole. Ids equal those of `Tokenizer.encode`.
"""

from __future__ import annotations

import functools
import re
from array import array

from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from cohortwise.llm.common import drop_between_operators

PIECES, WORDS = 400_000, 600_000
"""Entries of a process's caches of pieces and of the words in them; what is met after that is encoded each time."""

SAMPLE = "One two, three.\nFour It's 5.,\nÉté a b"
"""A vocabulary that does not encode this text piece by piece encodes every text whole."""

_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def _byte_characters() -> dict[int, int]:
    """Byte-level vocabularies write a byte as one printable character: itself where it is one, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_BYTE_CHARACTERS = _byte_characters()
_ODD = re.compile(r"[^\S \n]")


class Encoder:
    """`ids(text)`: the text's ids as little-endian unsigned 32-bit integers, joined in one `bytes`."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.spaced = isinstance(self.tokenizer.pre_tokenizer, ByteLevel)  # ids of a word depend on the space before
        self.pieces, self.words, self.stops = _Cache(self.piece, PIECES), _Cache(self._merged, WORDS), {}
        self.divides = True
        self.divides = self.ids(SAMPLE) == self.whole(SAMPLE)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str, spaced: bool = True) -> bytes | None:
        """Ids of a space and `piece`, or of a piece that starts with a line feed; None if white space is inside."""
        if piece[:1] == "\n":  # no letter joins a line feed
            rest = piece[1:]
            if rest.isalpha():
                return self._stops("\n") + self.piece(rest, False)
            return None if _ODD.search(rest) else self.whole(piece)
        word = piece.rstrip(".,")
        if not word.isalpha() or not (word.isascii() or _LATIN(word)):
            text = " " + piece if spaced else piece
            return None if _ODD.search(text) else self.whole(text)
        ids = self.words[word.lower() if not self.spaced else " " + word if spaced else word]
        return ids if word == piece else ids + self._stops(piece[len(word) :])

    def _merged(self, word: str) -> bytes:
        """Letters only, so one pre-token: the model merges its bytes without the steps before."""
        tokens = self.merge(word.encode().decode("latin-1").translate(_BYTE_CHARACTERS))
        return array("I", [t.id for t in tokens]).tobytes()

    def _stops(self, text: str) -> bytes:
        if text not in self.stops:
            self.stops[text] = self.whole(text)
        return self.stops[text]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.divides or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n":
            return self.whole(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.whole(first) + b"".join(map(self.pieces.__getitem__, rest))
        except TypeError:
            return self.whole(text)


class _Cache(dict):
    """A bounded cache in front of `encode`."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, text: str) -> bytes | None:
        ids = self.encode(text)
        if len(self) < self.most:
            self[text] = ids
        return ids


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The process's encoder for a vocabulary file."""
    return Encoder(path)


drop_between_operators(encoder.cache_clear)
