"""Operator 6, token counts: a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and one for pieces that go on. Failure links
lead from a node to where matching goes on after the longest pieces inside it are popped, and each link holds how many
pieces it pops. Links are folded into a transition table over bytes that also holds the counts, so a text is counted
in one pass, without building pieces. A batch of texts is cut at white space into lanes that step together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, text_of

SPACES = bytes([32, 9, 10, 11, 12, 13])
LANES = 4096
UNKNOWN = 255


class Automaton:
    """Transition table: entry ``state * 256 + byte`` is ``next state * 256``, with the popped pieces above bit 40."""

    def __init__(self, begin: list[bytes], inside: list[bytes]):
        child: list[dict[int, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, begin), (1, inside)):
            for piece in pieces:
                at = root
                for b in piece:
                    if b not in child[at]:
                        child[at][b] = len(child)
                        child.append({})
                        final.append(False)
                    at = child[at][b]
                final[at] = at > 1
        n = len(child)
        fail, pops = [-1] * n, [0] * n
        order = [0, 1]
        for at in order:  # breadth first: links of shorter nodes are known
            for b, to in child[at].items():
                order.append(to)
                if final[to]:
                    fail[to], pops[to] = 1, 1
                    continue
                z, popped = fail[at], pops[at]
                while z >= 0 and b not in child[z]:
                    popped += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[to], pops[to] = child[z][b], popped
        dead = n
        table = np.full((n + 1, 256), dead << 8, dtype=np.int64)
        end = np.full(n + 1, -1)
        # a node's link always leads to a node that stands for fewer bytes, so fill in that order
        for at in order:
            if fail[at] >= 0:
                table[at] = table[fail[at]] + (pops[at] << 40)
                table[at][(table[fail[at]] >> 8 & 0xFFFFFFFF) == dead] = dead << 8
            for b, to in child[at].items():
                table[at, b] = to << 8
            if at == 1:
                end[at] = 0
            elif fail[at] >= 0 and end[fail[at]] >= 0:
                end[at] = end[fail[at]] + pops[at]
        end[0] = 0
        for at in range(n + 1):
            table[at, list(SPACES)] = (UNKNOWN if end[at] < 0 else int(end[at])) << 40
        self.table = table.ravel()

    def pops(self, data: np.ndarray) -> np.ndarray:
        """Pieces popped at each byte; ``data`` ends with white space. ``UNKNOWN`` where a word without a match ends."""
        out = np.zeros(len(data), dtype=np.uint8)
        space = np.flatnonzero(np.isin(data, np.frombuffer(SPACES, dtype=np.uint8)))
        step = max(64, len(data) // LANES)
        marks = np.searchsorted(space, np.arange(step, len(data), step))
        cuts = np.unique(np.concatenate([[0], space[marks[marks < len(space)]] + 1, [len(data)]]))
        starts, sizes = cuts[:-1], np.diff(cuts)
        usual = sizes <= 2 * step
        for group in [np.flatnonzero(usual), *np.flatnonzero(~usual)[:, None]]:
            if not len(group):
                continue
            width = int(sizes[group].max())
            at = starts[group][None, :] + np.arange(width)[:, None]
            inside = np.arange(width)[:, None] < sizes[group][None, :]
            lanes = np.where(inside, data[np.minimum(at, len(data) - 1)], 32).astype(np.int64)
            state, found = np.zeros(len(group), dtype=np.int64), np.empty(lanes.shape, dtype=np.uint8)
            for k in range(width):
                got = self.table[state + lanes[k]]
                found[k] = got >> 40
                state = got & 0xFFFFFFFFFF
            out[at[inside]] = found[inside]
        return out

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces, words and words without a match of each text. Such a word counts as one piece."""
        raw = [t.encode() + b"\n" for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        found = self.pops(data)
        space = np.isin(data, np.frombuffer(SPACES, dtype=np.uint8))
        ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        unknown = found[ends] == UNKNOWN
        running = np.concatenate([[0], np.cumsum(np.where(found == UNKNOWN, 0, found), dtype=np.int64)])
        per_word = np.where(unknown, 1, np.diff(np.concatenate([[0], running[ends + 1]])))
        edges = np.searchsorted(ends, np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[edges])
        return total(per_word), np.diff(edges), total(unknown)


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    """From a SentencePiece file: pieces with the word mark begin a word, the others go on; control, unknown and byte
    pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    begin = [p[1:].encode() for p in pieces if p[0] == "▁" and len(p) > 1 and "▁" not in p[1:]]
    return Automaton(begin, [p.encode() for p in pieces if "▁" not in p])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_words, n_unknown`` for each row: greedy longest-match pieces of whole texts.

    Words are runs without ASCII white space. A word that greedy matching can't finish is one unknown token. Null and
    empty texts have no tokens; repeated rows and null ids are counted like others; an empty table gives none.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_tokens", "n_words", "n_unknown")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = automaton(vocabulary).count(batch.column(1).to_pylist()) if batch.num_rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts]], schema=schema)

    return arrow(docs.select(F.col(id_col).cast("bigint").alias("_id"), text_of(text_col).alias("_text")), count,
                 "doc_id bigint, n_tokens bigint, n_words bigint, n_unknown bigint")
