"""Token ids of whole texts by a public tokenizer file, with a cache of the ids of short pieces.

A byte-level tokenizer starts a new pre-token at any single space before a non-space, and a tokenizer that
drops white space starts one at each word, so the ids of a text are those of its pieces. Pieces repeat, and
each one is encoded by the library once per worker while the cache holds it; a piece of letters alone is one
pre-token and goes to the library's model directly. Texts where the rule could fail (special tokens' strings,
runs of white space) are encoded whole by the library.
"""

from __future__ import annotations

import unicodedata
from array import array
from functools import lru_cache
from string import punctuation

#: Distinct pieces that a worker keeps; beyond, the cache starts anew. Longer pieces seldom come again.
CACHE = {"byte": 900_000, "word": 400_000}
LONGEST = 11


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next free one."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class WholeText(Exception):
    """A text that has to be encoded in one call."""


def packed(ids) -> bytes:
    return array("I", ids).tobytes()


class Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; a missing one is encoded and kept.

    ``before``: what stands before each piece in its text, a space or nothing.
    """

    def __init__(self, library, kind: str, before: str, plain: Pieces | None = None):
        super().__init__()
        self.library, self.model, self.kind, self.before = library, library.model, kind, before
        self.plain = self if plain is None else plain
        self.letters = dict(enumerate(byte_letters()))

    def spelt(self, letters: str) -> str | None:
        """How the model's vocabulary spells a piece of letters; None where the library has to normalise it."""
        if self.kind == "word":
            if letters.isascii():
                return letters.lower()
            if "Σ" in letters or not unicodedata.is_normalized("NFC", letters):
                return None
            letters = letters.lower()
            return letters.encode().decode("latin-1").translate(self.letters) if letters.isalpha() else None
        if letters.isascii():
            return "\u0120" + letters if self.before else letters
        return (self.before + letters).encode().decode("latin-1").translate(self.letters)

    def __missing__(self, piece: str) -> bytes:
        if self.before and (not piece or piece[0].isspace()):
            raise WholeText
        made = spelt = None
        if piece.isalpha():
            spelt = self.spelt(piece)
        elif (core := piece.rstrip(punctuation)) is not piece and core.isalpha():
            made = self[core] + self.plain[piece[len(core) :]]
        else:
            line, end, more = piece.partition("\n")
            if end and line and more and not line[-1].isspace() and not more[0].isspace():
                return self[line] + self.plain[end] + self.plain[more]
        if spelt is not None:
            made = packed([x.id for x in self.model.tokenize(spelt)])
        elif made is None:
            made = packed(self.library.encode(self.before + piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            self[piece] = made
        return made


class Encoder:
    """one(text) -> its ids as bytes. kind: "byte" (a space starts a piece) or "word" (white space is dropped)."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), kind
        self.plain = Pieces(self.library, kind, "")
        self.spaced = Pieces(self.library, kind, " ", self.plain) if kind == "byte" else self.plain

    def one(self, text: str) -> bytes:
        if len(self.plain) + len(self.spaced) > CACHE[self.kind]:
            self.plain.clear()
            self.spaced.clear()
        if "<|" not in text:
            if self.kind == "word":
                text = text.replace("\n", " ")
            first, *rest = text.split(" ")
            try:
                return self.plain[first] + b"".join(map(self.spaced.__getitem__, rest))
            except WholeText:
                pass
        return packed(self.library.encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=2)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker and file."""
    return Encoder(path, kind)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
