"""Bit planes, packing, SentencePiece and longest-match counts against the libraries and brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SMALL
from tokenizers import Tokenizer

from stayweave.llm import bitplanes, packing, pieces, queries, wordpiece
from stayweave.llm.tokens import encoder

TEXTS = ["", " a", "a ", "a  b", "x\n\ny \n z", "a\tb c", "<|endoftext|> hi", "it's 'd x's", "ΑΣ ΟΔΟΣ. ς", "é ́x İ 日本 語\n語", "a\n b",
         "1 22 333,4.5", "\n", "don't\nI'll", "a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|> <|endoftext|><|endoftext|>Y ", "A b 　 c", "a\x1cb\x1f c"]
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def library(path):
    tokenizer = Tokenizer.from_file(path)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_encoder(spark, path):
    encode, own = library(path), encoder(path)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    assert [t for t in texts if own.encode(t) != raw(encode(t))] == []


@pytest.mark.parametrize("plane", ["bit", "byte"])
@pytest.mark.parametrize("top", [1, 2, 300, 70000, 2**32 - 1])
def test_planes_round_trip(plane, top):
    ids = np.random.default_rng(top).integers(0, top, 1003, dtype=np.uint64).astype("<u4")
    chunks, planes = bitplanes.pack_segment(ids, plane, 256)
    assert (bitplanes.unpack_range(chunks, planes, plane, 0, 1003) == ids).all()
    assert (bitplanes.unpack_range(chunks, planes, plane, 250, 20) == ids[250:270]).all()
    assert len(bitplanes.unpack_range(chunks, planes, plane, 5, 0)) == 0


def test_written_ids(spark, odd, tmp_path):
    path, encode = str(tmp_path / "ids"), library(WORD)
    bitplanes.write_ids(odd, path, WORD, segment=100, block=64, shards=3)
    got = sorted(bitplanes.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((r.doc_id, raw(encode(r.text) + [1])) for r in odd.collect())
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    whole = np.frombuffer(b"".join(bytes(r.ids) for r in got), dtype="<u4")
    assert (bitplanes.read_range(spark, path, 37, 500) == whole[37:537]).all()


def test_no_ids(spark, none, tmp_path):
    bitplanes.write_ids(none, str(tmp_path / "ids"), WORD)
    assert bitplanes.read_ids(spark, str(tmp_path / "ids")).count() == 0


def test_bit_plane_query(spark):
    encode, at = library(WORD), 0
    got = {r.doc_id: r for r in queries.QUERIES["op1_bit_planes"](spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect():
        ids = encode(r.text) + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(raw(ids)))
        at += len(ids)


@pytest.mark.parametrize("counts", [{600: 40, 5: 3, 64: 2}, {64: 9}, {1: 1}, {33: 50, 31: 50, 64: 1, 10: 7}, {}])
@pytest.mark.parametrize("cut", [True, False])
def test_layout(counts, cut):
    capacity = max([64, *counts]) if counts else 64
    layout, windows = packing.Layout(counts, capacity, cut), defaultdict(list)
    for n, c in counts.items():
        for places in layout.places(np.full(c, n), np.arange(c)):
            assert sum(p[1] for p in places) == n and (cut or len(places) == 1)
            for _, length, sequence, offset in places:
                windows[sequence].append((offset, length))
    assert sorted(windows) == list(range(layout.sequences))
    for pieces_ in windows.values():
        at = 0
        for offset, length in sorted(pieces_):
            assert offset == at
            at += length
        assert at <= capacity and (not cut or at in (capacity, at & -at))


def test_best_window_is_best():
    random.seed(5)
    for _ in range(60):
        counts = Counter(random.randint(1, 20) for _ in range(random.randint(1, 9)))
        found = packing.best_window(dict(counts), 20)
        reach = {max(counts)}
        for n in (counts - Counter([max(counts)])).elements():
            reach |= {r + n for r in reach if r + n <= 20}
        assert sum(n * m for n, m in found.items()) == max(reach)
        assert all(m <= counts[n] for n, m in found.items())


def test_pack(odd, none):
    encode = library(BYTE)
    got = packing.pack(odd, BYTE, capacity=64).collect()
    by_text = Counter(raw(encode(r.text) + [0]) for r in odd.collect())
    by_window, tokens = defaultdict(list), 0
    for r in got:
        assert len(r.ids) == 4 * r.length
        by_window[r.sequence_id].append((r.offset, r.length))
        tokens += r.length
    assert tokens == sum(len(t) // 4 * n for t, n in by_text.items())
    one = sorted((r for r in got if r.doc_id == 4), key=lambda r: r.start)
    assert b"".join(bytes(r.ids) for r in one) in by_text
    for pieces_ in by_window.values():
        ends = [o + n for o, n in sorted(pieces_)]
        assert [o for o, _ in sorted(pieces_)] == [0, *ends[:-1]] and ends[-1] & (ends[-1] - 1) == 0
    assert packing.pack(none, BYTE).count() == 0


def test_pieces_match_library(spark, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    want = Counter((r.doc_id, raw(model.encode(r.text or ""))) for r in rows.collect())
    for chunk in (pieces.CHUNK, 400):  # with the small chunks most documents are giant
        assert Counter((r.doc_id, bytes(r.ids)) for r in pieces.encode_pieces(rows, PIECE, chunk=chunk).collect()) == want
    back = pieces.decode_pieces(pieces.encode_pieces(rows, PIECE), PIECE).collect()
    assert Counter(r.text for r in back) == Counter(r.text or "" for r in rows.collect())
    assert pieces.encode_pieces(none, PIECE).count() == 0


def chunked(lattice, text, chunk):
    """The scan without Spark."""
    words, written = pieces.PieceEncoder(lattice), lattice.written_as(text)
    n, rows, matrices = len(written), [], []
    for begin in range(0, n, chunk):
        end, low = min(n, begin + chunk), max(0, begin - lattice.longest)
        part = written[low:min(n, end + lattice.longest)]
        entries = [None] if not begin else pieces.border_states(lattice, part, begin - low)
        matrix: dict = {}
        for a, b, w in pieces.transfer_by_words(lattice, part, begin - low, end - low, entries):
            matrix.setdefault((-1, -1) if a is None else (a[0] + low, a[1] + low), {})[b[0] + low, b[1] + low] = w
        rows.append((low, begin, end, part))
        matrices.append(matrix)
    start = (-1, -1)
    ends = matrices[0].get(start, {})
    states = [start, *(pieces._scan(matrices, start) or [max(ends, key=lambda s: (ends[s], s))])]
    out = b""
    for (low, begin, end, part), a, b in zip(rows, states, states[1:]):
        at, before = (begin - low, None) if a[0] < 0 else (a[1] - low, part[a[0] - low:a[1] - low])
        out += pieces.traced(words, part, at, before, end - low, b[1] - low)
    return np.frombuffer(out, dtype="<u4").tolist()


@pytest.mark.parametrize("chunk", [1, 3, 17, 64])
def test_scan_of_small_chunks(chunk):
    model, lattice = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.encoder(PIECE).lattice
    for text in [t for t in TEXTS if t] + ["aaaa aaaaaaa  aa", "    def f(x):\n        return x", "▁▁ a", "xyz" * 50]:
        assert chunked(lattice, text, chunk) == model.encode(text), text


def test_unigram_reading():
    lattice = pieces.Lattice(PIECE, "unigram")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for text in ["hello world", "the quick brown fox", "antidisestablishmentarianism again and again"]:
        written = lattice.written_as(text)
        best = [0.0] + [float("-inf")] * len(written)
        for end in range(1, len(best)):
            best[end] = max(best[start] + lattice.scores.get(written[start:end], float("-inf")) for start in range(end))
        weight = lambda ids: sum(model.get_score(i) for i in ids)
        assert weight(lattice.segment(written)) == pytest.approx(best[-1])
        for chunk in (2, 5, 9):
            got = chunked(lattice, text, chunk)
            assert weight(got) == pytest.approx(best[-1]) and model.decode(got) == text


def greedy(word, begin, inside):
    at, n = 0, 0
    while at < len(word):
        known = begin if not at else inside
        size = next((k for k in range(len(word) - at, 0, -1) if word[at:at + k] in known), 0)
        if not size:
            return 1, 1
        at, n = at + size, n + 1
    return n, 0


def test_longest_match(spark, odd, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    begin = {p[1:] for p in names if p[0] == "▁" and p.strip("▁")}
    inside = {p for p in names if "▁" not in p}
    rows = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"))
    known: dict = {}

    def count(text):
        words = [w for w in re.split(r"[ \t-\r]+", text or "") if w]
        got = [known.setdefault(w, greedy(w, begin, inside)) if len(w) < 4000 else greedy(w, begin, inside) for w in words]
        return sum(g[0] for g in got), len(words), sum(g[1] for g in got)

    assert Counter(tuple(r) for r in wordpiece.token_counts(rows, PIECE).collect()) == Counter((r.doc_id, *count(r.text)) for r in rows.collect())
    assert wordpiece.token_counts(none, PIECE).count() == 0


def test_automaton_by_brute_force():
    random.seed(3)
    for _ in range(40):
        make = lambda: {"".join(random.choices("ab", k=random.randint(1, 5))) for _ in range(6)}
        begin, inside = make(), make()
        automaton = wordpiece.Automaton([p.encode() for p in begin], [p.encode() for p in inside])
        words = ["".join(random.choices("abc", weights=[5, 5, 0.3], k=random.randint(1, 12))) for _ in range(60)]
        n, w, u = automaton.count(words)
        assert list(zip(n, u)) == [greedy(x, begin, inside) for x in words] and (w == 1).all()


def test_registered(spark):
    assert {k.split("_")[0] for k in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
