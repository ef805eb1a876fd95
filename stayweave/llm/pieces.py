"""Operator 4, SentencePiece encoding and decoding by a max-plus scan.

A segmentation is a path through the lattice of vocabulary pieces. In max-plus algebra a step adds the weight of the
piece and of the pair it makes with the piece before. For unigram models the weights are the pieces' scores and pairs
are free. For byte-pair models pieces are free and a pair weighs nothing or minus infinity: a sequence is what the
merges give if, and only if, no two pieces next to each other would merge otherwise on their own. So both kinds are
the same scan, and the path of the largest weight gives the ids of the library.

Giant documents are split into chunks. The piece that lies over a border is the state there; a chunk yields the matrix
of weights from the states at its begin to those at its end. Matrices are combined associatively, which tells each
chunk the states the best path has at its borders, and every chunk is traced back on its own.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayweave.llm.base import arrow, stored, text_of

MARK = "▁"
#: Characters of a chunk; longer documents are split.
CHUNK = 1 << 16
CACHE_WORDS = 400_000
_NEVER = float("-inf")


class _Pairs(dict):
    """Whether two pieces may stand next to each other."""

    def __init__(self, lattice: Lattice):
        super().__init__()
        self.lattice = lattice

    def __missing__(self, key: tuple[str, str]) -> bool:
        if len(self) >= CACHE_WORDS:
            self.clear()
        ok = self[key] = self.lattice.compatible(*key)
        return ok


class Lattice:
    """Pieces of one model file and the weights of steps between them."""

    def __init__(self, path: str, kind: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as file:
            spec.ParseFromString(file.read())
        if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave characters as they are")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dummy = spec.normalizer_spec.add_dummy_prefix
        self.bpe = (kind or ("bpe" if spec.trainer_spec.model_type == 2 else "unigram")) == "bpe"
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(size) if model.is_byte(i)}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        self.resets = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self.least = min(self.scores.values()) - 10.0
        self.written = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i)
                        else " ⁇ ".encode() if model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        self.valid = {p for p in self.ids if len(p) > 1 and (not self.bpe or self.merged(p) == [p])}
        self.pairs = _Pairs(self)
        #: Neighbouring characters that some piece holds: between any others every path has a border.
        self.joined = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        #: Length of the longest valid piece by its first two characters.
        self.reach: dict[str, int] = {}
        for p in self.valid:
            self.reach[p[:2]] = max(len(p), self.reach.get(p[:2], 1))
        self._splits: dict[str, tuple[str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces by merging: the adjacent pair of the highest score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = _NEVER, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def weight(self, piece: str) -> float:
        if not self.bpe:
            return self.scores.get(piece, self.least if len(piece) == 1 else _NEVER)
        return 0.0 if len(piece) == 1 or piece in self.valid else _NEVER

    def _halves(self, piece: str) -> tuple[str, str]:
        """What the last merge of a piece joined."""
        if piece not in self._splits:
            parts = list(piece)
            while len(parts) > 2:
                at = max(range(len(parts) - 1), key=lambda k: (self.scores.get(parts[k] + parts[k + 1], _NEVER), -k))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._splits[piece] = (parts[0], parts[-1])
        return self._splits[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` leaves the border between them. The two are taken apart again, latest merge
        first; a merge over the border counts if it comes before the merges that made its sides. Of equal merges the
        one further left comes first."""
        rank = lambda p: -self.scores[p] if len(p) > 1 else _NEVER
        limit, equal = float("inf"), False  # the latest merge that may happen over the border, itself included or not
        while True:
            over = self.scores.get(left + right)
            if over is not None and (-over < limit or equal and -over == limit):
                return False
            a, b = rank(left), rank(right)
            if a == b == _NEVER:
                return True
            if a > b:
                limit, equal, left = a, False, self._halves(left)[1]
            else:
                limit, equal, right = b, True, self._halves(right)[0]

    def pair(self, before: str | None, piece: str) -> float:
        if not self.bpe or before is None:
            return 0.0
        return 0.0 if self.pairs[before, piece] else _NEVER

    def paths(self, text: str, begin: int, before: str | None, stop: int) -> dict[int, tuple[float, int]]:
        """From position ``begin`` after the piece ``before``: for each position that can be reached, up to one piece
        beyond ``stop``, the largest weight and where its last piece begins."""
        best: dict[int, tuple[float, int]] = {begin: (0.0, -1)}
        limit = min(len(text), stop - 1 + self.longest) if stop < len(text) else len(text)
        for end in range(begin + 1, limit + 1):
            top, come = _NEVER, -1
            for start in range(end - 1, max(begin, end - self.longest) - 1, -1):
                known = best.get(start)
                if known is None or start >= stop:
                    continue
                piece = text[start:end]
                if end - start > 1 and piece not in self.ids:
                    continue
                own = self.weight(piece)
                if own == _NEVER:
                    continue
                last = before if start == begin else text[known[1]:start]
                total = known[0] + own + self.pair(last, piece)
                if total > top:
                    top, come = total, start
            if come >= 0:
                best[end] = (top, come)
        return best

    def ids_of(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        if got is not None:
            return [got]
        raw = piece.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unknown]

    def trace(self, text: str, best: dict[int, tuple[float, int]], begin: int, end: int) -> list[int]:
        pieces = []
        while end > begin:
            start = best[end][1]
            pieces.append(text[start:end])
            end = start
        return [i for p in reversed(pieces) for i in self.ids_of(p)]

    def segment(self, text: str) -> list[int]:
        """Ids of a text that needs no splitting."""
        if self.bpe:
            return self._short(text)
        return self.trace(text, self.paths(text, 0, None, len(text)), 0, len(text))

    def _short(self, text: str) -> list[int]:
        """``paths`` and ``trace`` where weights are 0 or nothing. One path at most leads to each position, so the longest
        piece is tried first, and a position without a way on is never entered again."""
        valid, pairs, reach, n = self.valid, self.pairs, self.reach, len(text)
        pieces: list[str] = []
        dead: set[int] = set()
        at, size = 0, reach.get(text[:2], 1)
        while at < n:
            last = pieces[-1] if pieces else None
            size = min(size, n - at)
            while size:
                piece = text[at:at + size]
                if (size == 1 or piece in valid) and at + size not in dead and (last is None or pairs[last, piece]):
                    break
                size -= 1
            if size:
                pieces.append(piece)
                at += size
                size = reach.get(text[at:at + 2], 1)
            else:
                dead.add(at)
                last = pieces.pop()
                at, size = at - len(last), len(last) - 1
        return [i for p in pieces for i in self.ids_of(p)]

    def written_as(self, text: str) -> str:
        """As the model sees it: word marks for spaces, one before the text."""
        return (MARK if self.dummy and text else "") + text.replace(" ", MARK)

    def decode(self, ids) -> str:
        """Inverse of encoding; a word mark in a text comes back as a space, as everywhere in such models."""
        raw = b"".join(map(self.written.__getitem__, ids))
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


class PieceEncoder:
    """Encodes texts word by word: no piece holds a word mark after another character, so paths always meet there."""

    def __init__(self, lattice: Lattice):
        self.lattice, self.words, self.units = lattice, {}, {}

    def _ids(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            ids = self.words[word] = b"".join(map(self._unit, self._cut(word)))
        return ids

    def _cut(self, word: str) -> list[str]:
        """Parts of a word between which no piece reaches, such as letters and the comma behind them."""
        joined, at, out = self.lattice.joined, 0, []
        for k in range(1, len(word)):
            if word[k - 1:k + 1] not in joined:
                out.append(word[at:k])
                at = k
        out.append(word[at:])
        return out

    def _unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            if len(self.units) >= CACHE_WORDS:
                self.units.clear()
            ids = self.units[unit] = array("I", self.lattice.segment(unit)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        written = self.lattice.written_as(text)
        if not self.lattice.resets:
            return array("I", self.lattice.segment(written)).tobytes()
        return b"".join(map(self._ids, split_words(written)))


def split_words(written: str) -> list[str]:
    """Cut before each word mark that follows another character, and around line breaks, which no piece holds."""
    rough = written.replace("\n", "\0\n\0").replace(MARK, "\0" + MARK).split("\0") if "\0" not in written else [written]
    out: list[str] = []
    for part in rough:
        if out and out[-1][-1:] == MARK and out[-1].strip(MARK) == "" and part[:1] not in ("\n", ""):
            out[-1] += part  # marks in a row stay with the word they precede
        elif part:
            out.append(part)
    return out


@lru_cache(maxsize=2)
def encoder(path: str, kind: str | None = None) -> PieceEncoder:
    return PieceEncoder(Lattice(path, kind))


# ---- giant documents -------------------------------------------------------------------------------------------

State = tuple[int, int]  # where the piece over a border begins and ends


def border_states(lattice: Lattice, text: str, at: int) -> list[State]:
    """Pieces that begin before ``at`` and end there or later."""
    out = []
    for start in range(max(0, at - lattice.longest), at):
        for end in range(at, min(len(text), start + lattice.longest) + 1):
            piece = text[start:end]
            if end - start == 1 or piece in lattice.ids and lattice.weight(piece) > _NEVER:
                out.append((start, end))
    return out


def transfer(lattice: Lattice, text: str, begin: int, end: int, entries: list[State | None]) -> list[tuple[State | None, State, float]]:
    """Weights from each state at ``begin`` to the states at ``end`` that can be reached from it."""
    out = []
    for entry in entries:
        at, before = (begin, None) if entry is None else (entry[1], text[entry[0]:entry[1]])
        if at >= end:
            out.append((entry, entry, 0.0))
            continue
        best = lattice.paths(text, at, before, end)
        out += [(entry, (come, to), weight) for to, (weight, come) in best.items() if to >= end and come >= 0 and come < end]
    return out


def combine(one: dict, two: dict) -> dict:
    """Max-plus product of two transfer matrices ``{from: {to: weight}}``."""
    out: dict = {}
    for a, row in one.items():
        for b, w in row.items():
            for c, v in two.get(b, {}).items():
                if w + v > out.setdefault(a, {}).get(c, _NEVER):
                    out[a][c] = w + v
    return out


def _scan(matrices: list[dict], entry) -> list:
    """States at all borders on the best path: products over a balanced tree, then down again."""
    if len(matrices) == 1:
        return []

    def down(lo: int, hi: int, first, last, out: list) -> None:
        if hi - lo == 1:
            return
        mid = (lo + hi) // 2
        left, right = tree(lo, mid)[first], tree(mid, hi)
        best = max((w + right[s][last], s) for s, w in left.items() if last in right.get(s, {}))[1]
        down(lo, mid, first, best, out)
        out.append((mid, best))
        down(mid, hi, best, last, out)

    known: dict = {}

    def tree(lo: int, hi: int) -> dict:
        if (lo, hi) not in known:
            known[lo, hi] = matrices[lo] if hi - lo == 1 else combine(tree(lo, (lo + hi) // 2), tree((lo + hi) // 2, hi))
        return known[lo, hi]

    ends = tree(0, len(matrices))[entry]
    borders: list = []
    down(0, len(matrices), entry, max(ends, key=lambda s: (ends[s], s)), borders)
    return [s for _, s in sorted(borders, key=lambda x: x[0])] + [max(ends, key=lambda s: (ends[s], s))]


def _giants(giants: DataFrame, path: str, kind: str | None, chunk: int) -> DataFrame:
    """``_row, ids`` of documents longer than a chunk."""
    schema = pa.schema([("_row", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("low", pa.int64()), ("begin", pa.int64()),
                        ("end", pa.int64()), ("text", pa.string())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = encoder(path, kind).lattice
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                written = lattice.written_as(text.as_py())
                n, parts = len(written), -(-len(written) // chunk)
                rows = []
                for k in range(parts):
                    begin, end = k * chunk, min(n, (k + 1) * chunk)
                    low = max(0, begin - lattice.longest)  # a piece may begin before the chunk and end behind it
                    rows.append({"_row": row, "part": k, "parts": parts, "low": low, "begin": begin, "end": end,
                                 "text": written[low:min(n, end + lattice.longest)]})
                    if len(rows) == 64 or k == parts - 1:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []

    chunks = stored(arrow(giants, split, "_row bigint, part int, parts int, low bigint, begin bigint, end bigint, text string")
                    .repartition("_row", "part"))
    edge = pa.schema([("_row", pa.int64()), ("part", pa.int32()), *[(n, pa.int64()) for n in ("a0", "a1", "b0", "b1")], ("w", pa.float64())])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = encoder(path, kind).lattice
        for batch in batches:
            for r in batch.to_pylist():
                low, begin, end, text = r["low"], r["begin"] - r["low"], r["end"] - r["low"], r["text"]
                entries = [None] if r["part"] == 0 else border_states(lattice, text, begin)
                found = transfer_by_words(lattice, text, begin, end, entries)
                yield pa.RecordBatch.from_pylist([
                    {"_row": r["_row"], "part": r["part"], "a0": -1 if a is None else a[0] + low, "a1": -1 if a is None else a[1] + low,
                     "b0": b[0] + low, "b1": b[1] + low, "w": w} for a, b, w in found], schema=edge)

    matrices = arrow(chunks, edges, "_row bigint, part int, a0 bigint, a1 bigint, b0 bigint, b1 bigint, w double")

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        parts: list[dict] = [{} for _ in range(int(pdf["part"].max()) + 1)]
        for part, a0, a1, b0, b1, w in pdf[["part", "a0", "a1", "b0", "b1", "w"]].itertuples(index=False):
            parts[part].setdefault((a0, a1), {})[b0, b1] = w
        start = (-1, -1)
        states = [start, *(_scan(parts, start) or [max(parts[0][start], key=lambda s: (parts[0][start][s], s))])]
        return pd.DataFrame([(pdf["_row"].iloc[0], k, *states[k], *states[k + 1]) for k in range(len(parts))],
                            columns=["_row", "part", "a0", "a1", "b0", "b1"])

    # a document is one row, so it has some ten thousand chunks at most, each with a few states
    chosen = matrices.groupBy("_row").applyInPandas(scan, "_row bigint, part int, a0 bigint, a1 bigint, b0 bigint, b1 bigint")
    out = pa.schema([("_row", pa.int64()), ("part", pa.int32()), ("ids", pa.binary())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, kind)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                text, low = r["text"], r["low"]
                at, before = (r["begin"] - low, None) if r["a0"] < 0 else (r["a1"] - low, text[r["a0"] - low:r["a1"] - low])
                rows.append({"_row": r["_row"], "part": r["part"], "ids": traced(words, text, at, before, r["end"] - low, r["b1"] - low)})
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    ids = arrow(chunks.join(chosen, ["_row", "part"]).select("_row", "part", "low", "begin", "end", "text", "a0", "a1", "b0", "b1"), back,
                "_row bigint, part int, ids binary")
    joined = F.expr("aggregate(transform(array_sort(parts), p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))")
    return ids.groupBy("_row").agg(F.collect_list(F.struct("part", "ids")).alias("parts")).select("_row", joined.alias("ids"))


def resets(text: str, begin: int, end: int) -> tuple[int, int]:
    """First and last position in a chunk where every path has a border, -1 if there is none."""
    first = last = -1
    at = begin
    while 0 <= (at := text.find(MARK, at)) <= end:
        if at > 0 and text[at - 1] != MARK:
            first = at
            break
        at += 1
    at = end + 1
    while first >= 0 and (at := text.rfind(MARK, first, at)) >= first:
        if at > 0 and text[at - 1] != MARK:
            last = at
            break
    return first, last


def transfer_by_words(lattice: Lattice, text: str, begin: int, end: int, entries: list) -> list:
    """As ``transfer``, but what lies between the first and the last reset weighs the same on every path and, for a
    path's choice, nothing: only the ends are walked."""
    first, last = resets(text, begin, min(end, len(text) - 1)) if lattice.resets else (-1, -1)
    if first < 0:
        return transfer(lattice, text, begin, end, entries)
    heads = []
    for entry in entries:
        at, before = (begin, None) if entry is None else (entry[1], text[entry[0]:entry[1]])
        if at == first:
            heads.append((entry, 0.0))
        elif at < first:
            got = lattice.paths(text[:first], at, before, first).get(first)
            if got:
                heads.append((entry, got[0]))
    if last == end:  # the border itself is a reset: whichever piece ends there
        tails = _last_piece(lattice, text, first, end)
    else:
        tails = [(exit_, w) for _, exit_, w in transfer(lattice, text, last, end, [None])]
    if first == last == end:
        return [t for t in transfer(lattice, text, begin, end, [e for e, _ in heads]) if t[1][1] == end]
    return [(entry, exit_, h + w) for entry, h in heads for exit_, w in tails]


def _last_piece(lattice: Lattice, text: str, first: int, end: int) -> list:
    start = end - 1
    while start > first and not (text[start] == MARK and text[start - 1] != MARK):
        start -= 1
    best = lattice.paths(text[:end], start, None, end)
    return [((best[end][1], end), best[end][0])] if end in best and end > first else []


def traced(words: PieceEncoder, text: str, at: int, before: str | None, end: int, stop: int) -> bytes:
    """Ids of the pieces from ``at`` to ``stop``, the state at the chunk's end."""
    lattice = words.lattice
    first, last = resets(text, at, min(stop, len(text) - 1)) if lattice.resets else (-1, -1)
    if first < 0 or stop < first:
        best = lattice.paths(text[:stop], at, before, stop)
        return array("I", lattice.trace(text, best, at, stop)).tobytes() if stop > at else b""
    head = lattice.paths(text[:first], at, before, first)
    middle = b"".join(map(words._ids, split_words(text[first:last])))
    # the piece over the border may end before the word does
    tail = lattice.paths(text[:stop], last, None, stop)
    return (array("I", lattice.trace(text, head, at, first)).tobytes() + middle
            + (array("I", lattice.trace(text, tail, last, stop)).tobytes() if stop > last else b""))


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", kind: str | None = None,
                  chunk: int = CHUNK, keep: str | None = None) -> DataFrame:
    """``id, ids`` (little-endian unsigned 32-bit ids) of each whole text, and the column ``keep``.

    Null and empty texts have no ids. Characters without a piece are written as bytes. Repeated rows and null ids are
    encoded like others; an empty table gives none; other columns are not read. ``kind`` reads the same file as a
    "unigram" or "bpe" model; by default it says itself which it is.
    """
    kept = [F.col(keep)] if keep else []
    rows = docs.select(F.col(id_col), *kept, text_of(text_col).alias("_own_text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, kind)
        for batch in batches:
            ids = pa.array([words.encode(t.as_py()) for t in batch.column(batch.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    short = arrow(rows.filter(F.length("_own_text") < chunk), encode, _fields(rows.drop("_own_text")) + ", ids binary")
    giants = stored(rows.filter(F.length("_own_text") >= chunk).withColumn("_row", F.monotonically_increasing_id()))
    found = _giants(giants.select("_row", "_own_text"), path, kind, chunk)
    return short.unionByName(giants.join(found, "_row").select(*short.columns))


def decode_pieces(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", kind: str | None = None,
                  keep: str | None = None) -> DataFrame:
    """``id, ids, text`` and the column ``keep``; null ids give a null text."""
    kept = [F.col(keep)] if keep else []
    rows = encoded.select(F.col(id_col), *kept, F.col(ids_col).alias("ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = encoder(path, kind).lattice
        for batch in batches:
            texts = [None if b is None else lattice.decode(array("I", b)) for b in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    return arrow(rows, decode, _fields(rows) + ", text string")
