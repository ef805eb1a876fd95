"""Operator 13, byte-level BPE encoding and decoding by the tiktoken library with a local rank file.

The library's pattern cuts a text into matches and merges bytes inside each. A long text is cut beforehand where a match
ends on any reading of the pattern (before white space behind a visible sign, between letters, digits and signs), so
neither the library nor a worker ever holds the tokens of more than one chunk besides the ids found. Runs of white space
overflow the stack of the pattern's look-ahead when they are long; they are cut as the pattern would and merged alone.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, text_of

#: The pattern of the rank files' vocabularies; a fixed value of the format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a chunk, and of a run of white space that is merged alone.
CHUNK, LONG_SPACE = 1 << 16, 256

_LETTER, _SIGN = "A-Za-z一-龥", "!-/:-@\\[-`{-~、。，"
_SAFE = re.compile(rf"(?<=\S)(?=[ \n\r\t])|(?<=[{_LETTER}])(?=[0-9{_SIGN}])|(?<=[0-9])(?=[{_LETTER}{_SIGN}])")
#: White space of the pattern, as ranges of code points; fixed values of its definition.
_SPACE_RANGES = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                 (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_SPACES = re.compile("[%s]{%d,}" % ("".join(f"{chr(a)}-{chr(b)}" for a, b in _SPACE_RANGES), LONG_SPACE))


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in chunks of ``size`` characters or, up to the next safe boundary, more."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if found is None or found.start() == len(text):
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def long_spaces_apart(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text, and whether a part is one match of white space alone."""
    at = 0
    for found in _SPACES.finditer(text):
        # before a visible sign the last white space is a match of its own or belongs to that sign's
        end = found.end() if found.end() == len(text) else found.end() - 1
        if found.start() > at:
            yield text[at:found.start()], False
        yield text[found.start():end], True
        at = end
    if at < len(text):
        yield text[at:], False


class ByteEncoder:
    """Encodes and decodes with ``ranks`` of byte strings; ``special`` strings in a text get their own ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, special: dict[str, int] | None = None):
        self.by_match = tiktoken.Encoding("matches", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})
        self.ranks = ranks
        self.special = set(special or ())
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if special else None
        self.names = dict(special or {})

    @cached_property
    def whole(self) -> tiktoken.Encoding:
        """Only long white space needs it, and it takes as much memory as the other."""
        return tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})

    def _ordinary(self, text: str, out: list[np.ndarray]) -> None:
        for chunk in safe_chunks(text):
            for part, alone in long_spaces_apart(chunk) if _SPACES.search(chunk) else ((chunk, False),):
                out.append(np.array((self.whole if alone else self.by_match).encode_ordinary(part), dtype="<u4"))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers; none for a null or empty one."""
        out: list[np.ndarray] = []
        if not text:
            return np.zeros(0, dtype="<u4")
        if self.cut is None:
            self._ordinary(text, out)
        else:
            at = 0
            for found in self.cut.finditer(text):
                if found.start() > at:
                    self._ordinary(text[at:found.start()], out)
                out.append(np.array([self.names[found.group()]], dtype="<u4"))
                at = found.end()
            if at < len(text):
                self._ordinary(text[at:], out)
        return out[0] if len(out) == 1 else np.concatenate(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, valid text or not. An id without an entry raises ``KeyError``."""
        return self.by_match.decode_bytes(ids.tolist())


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str = PATTERN) -> ByteEncoder:
    """From a rank file: a line per entry, its bytes in base 64 and its rank."""
    with open(rank_file, "rb") as lines:
        entries = [line.split() for line in lines if line.strip()]
    return ByteEncoder({base64.b64decode(token): int(rank) for token, rank in entries}, pattern)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable Latin-1 stands for itself, the rest
    follows from 256 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def byte_vocabulary(tokenizer_file: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Entries of a byte-level tokenizer file as bytes, and its added tokens.

    Only for files whose merges are ordered as their entries are: then ids are ranks.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = json.load(file)
    of_letter = {letter: b for b, letter in byte_letters().items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {k: i for k, i in spec["model"]["vocab"].items() if k not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("the merges are not in the order of the entries")
    return {bytes(map(of_letter.__getitem__, k)): i for k, i in vocabulary.items()}, special


@lru_cache(maxsize=2)
def file_encoder(tokenizer_file: str, special: bool = False) -> ByteEncoder:
    """From a byte-level tokenizer file; strings of added tokens are ordinary text unless ``special``."""
    ranks, added = byte_vocabulary(tokenizer_file)
    return ByteEncoder(ranks, PATTERN, added if special else None)


def encode_bytes(docs: DataFrame, rank_file: str, pattern: str = PATTERN, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``id, ids`` of each row: token ids of the whole text, special strings as plain text.

    Null and empty texts have an empty list. Repeated rows and null ids are encoded like others; an empty table gives
    none; other columns are not read. Texts go through in batches of some MB, long ones in chunks.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        for batch in batches:
            ids = [own.encode(text.as_py()) for text in batch.column(1)]
            ends = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate([*ids, np.zeros(0, dtype="<u4")]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col).alias(id_col), text_of(text_col).alias("_own_text"))
    return arrow(rows, encode, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode_bytes(encoded: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "bytes") -> DataFrame:
    """``encoded`` with the bytes of its ids in place of them; null ids count as none. Inverse of ``encode_bytes``: the
    bytes are the text's UTF-8, and cutting ids anywhere cuts them within characters without loss."""
    rows = encoded.select(*[c for c in encoded.columns if c != ids_col],
                          F.coalesce(ids_col, F.array().cast("array<int>")).alias("_own_ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            raw = pa.array([own.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], raw], names=[*batch.schema.names[:-1], out_col])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_own_ids")
    return arrow(rows, decode, f"{kept}, `{out_col}` binary")
