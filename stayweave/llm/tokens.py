"""Token ids of whole texts by a tokenizer file, in Python workers.

Byte-pair vocabularies never merge across the cuts of their pre-tokenizer, so words are encoded once and looked up
afterwards. The cache is bounded and only saves time: what a word encodes to doesn't depend on it.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import lru_cache

import regex
from tokenizers import Tokenizer

from stayweave.llm.bytepairs import byte_letters, file_encoder

#: Entries of a word cache before it starts anew.
CACHE_WORDS = 500_000
#: Letters from here on take the tokenizer's own normaliser and cutter instead of the short way.
PLAIN_BELOW = "ɐ"

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as little-endian 32-bit integers")


class _Words(dict):
    """Piece of text to the little-endian 32-bit ids it encodes to."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class WordEncoder:
    """Encodes texts with a tokenizer file that drops white space; strings of added tokens get their ids, as the library does."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(open(path, encoding="utf-8").read())
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.tokens = _Words(self._token)
        self.pieces = _Words(self._cut)
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)))

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _token(self, token: str) -> bytes:
        if token.isascii() and token[1:].isalnum() and (token[0] == " " or token[0].isalnum()):
            letters = self.space + token[1:] if token[0] == " " else token
        else:
            letters = "".join(map(self.letters.__getitem__, token.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _cut(self, piece: str) -> bytes:
        if not piece:
            return b""
        if max(piece) >= PLAIN_BELOW:
            return self._whole(piece)
        return b"".join(map(self.tokens.__getitem__, self.pattern.findall(piece.lower())))

    def _ordinary(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a null text counts as an empty one."""
        if not text:
            return b""
        if self.marks.search(text) is None:
            return self._ordinary(text)
        out, at = [], 0
        for found in self.marks.finditer(text):
            out += [self._ordinary(text[at:found.start()]), self.added[found.group()]]
            at = found.end()
        return b"".join([*out, self._ordinary(text[at:])])


class ByteTokens:
    """Encodes texts with a byte-level tokenizer file; strings of added tokens get their ids."""

    def __init__(self, path: str):
        self.own = file_encoder(path, special=True)

    def encode(self, text: str | None) -> bytes:
        return self.own.encode(text).tobytes()


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder | ByteTokens:
    """One encoder per worker and file."""
    with open(path, encoding="utf-8") as file:
        drops_space = json.load(file)["normalizer"] is not None
    return WordEncoder(path) if drops_space else ByteTokens(path)
